"""The smallest end-to-end question: naive vs seasonal-naive hourly forecasts and their blend.

events -> pooled hourly series -> clean -> lags 1 and 24 -> chronological split -> two
predictions on the test part -> tuned blend -> metrics -> comparison table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.functions.columns import floor_ts
from tsengine.operators import align, clean, features, metrics, split
from tsengine.sources import fixtures as fx


def flagship(spark: SparkSession, sf_dir: str, season: int = 24, test_size: float = 0.2) -> DataFrame:
    ev = fx.table(spark, sf_dir, "events")
    hourly = ev.groupBy(floor_ts("ts", "1 hour").alias("ts")).agg(F.sum("value").alias("y")).select(F.lit("all").alias("series_id"), "ts", "y")
    # one row per hour: the series length is bounded by the time span, not by the data volume,
    # so the per-series layout is known to fit one task and the size probe is skipped
    cleaned = clean.clean_series(hourly, ForecastConfig(layout="series"), value_cols=["y"])
    lagged = features.add_lags(cleaned, [1, season])
    flagged = split.split_chrono(lagged, test_size)
    test = flagged.filter((F.col("split") == "test") & F.col("y_lag_1").isNotNull() & F.col(f"y_lag_{season}").isNotNull())
    scored = test.select("series_id", "ts", F.col("y").alias("y_true"), F.col("y_lag_1").alias("pred_a"), F.col(f"y_lag_{season}").alias("pred_b"))
    weights = align.tune_blend(scored, points=101)
    blended = align.blend_tuned(scored, weights)
    m = metrics.forecast_metrics(blended, {"naive": "pred_a", "seasonal_naive": "pred_b", "hybrid": "hybrid_pred"})
    return metrics.compare_models(m)

"""Chart-ready frames instead of rendered images: tidy, down-sampled per series.

Each series' time span is cut into ``max_points`` equal time buckets (bounds from one grouped
aggregate, no ordered window), and every plotted line is reduced per bucket to its bucket start,
mean, min and max, with the stamps of both extremes, so a plot draws spikes where they were while the
row count stays bounded by ``series x lines x max_points`` whatever the input size. All lines are reduced
in one wide aggregate per bucket and become rows after it, so no row is multiplied before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.functions.columns import micros_between


def plot_frame(
    df: DataFrame,
    lines: Sequence[str] = ("y_true", "pred"),
    max_points: int = 500,
    bands: bool = False,
    band_cols: tuple[str, str] = ("low", "high"),
    series_col: str = "series_id",
    time_col: str = "ts",
) -> DataFrame:
    """``series_id, bucket, line, ts, value, v_min, v_max, ts_min, ts_max`` (``bands=True`` adds the band
    lines). ``ts_min`` and ``ts_max`` are the first stamps of a bucket's least and greatest value."""
    if max_points < 1:
        raise ValueError("max_points must be >= 1")
    names = list(lines) + (list(band_cols) if bands else [])
    t = F.col(time_col)
    bounds = df.groupBy(series_col).agg(F.min(time_col).alias("__t0"), F.max(time_col).alias("__t1"))
    joined = df.join(bounds, series_col, "left")
    span = micros_between("__t0", "__t1").cast("double") + F.lit(1.0)
    bucket = F.floor(micros_between("__t0", time_col).cast("double") * F.lit(float(max_points)) / span).cast("bigint")
    wide = joined.select(series_col, time_col, bucket.alias("bucket"), *[F.col(n).cast("double").alias(f"__{i}") for i, n in enumerate(names)])
    aggs = [F.min(t).alias("__ts")]
    for i in range(len(names)):
        v = F.col(f"__{i}")
        # one point each: the extreme value and its first stamp
        aggs += [
            F.avg(v).alias(f"__avg_{i}"),
            F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), t.alias("t")))).alias(f"__min_{i}"),
            F.min(F.when(v.isNotNull(), F.struct((-v).alias("v"), t.alias("t")))).alias(f"__max_{i}"),
        ]
    points = [
        F.struct(
            F.lit(n).alias("line"),
            F.col("__ts").alias("ts"),
            F.col(f"__avg_{i}").alias("value"),
            F.col(f"__min_{i}.v").alias("v_min"),
            (-F.col(f"__max_{i}.v")).alias("v_max"),
            F.col(f"__min_{i}.t").alias("ts_min"),
            F.col(f"__max_{i}.t").alias("ts_max"),
        )
        for i, n in enumerate(names)
    ]
    return wide.groupBy(series_col, "bucket").agg(*aggs).select(series_col, "bucket", F.inline(F.array(*points)))

"""End-to-end composition: clean once, tabular and probabilistic branches, align, blend, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.operators import align, clean, metrics, probabilistic, tabular, windows
from tsengine.plans.layout import pin_layout, resolve_layout
from tsengine.session import bucketed, materialize

SCORES = (*metrics.PREFERRED, "n")


def _checked(base: DataFrame, status: DataFrame, cfg: ForecastConfig) -> ForecastConfig:
    """Refuse what cannot be forecast, and pin the physical layout: both from one count per series."""
    s = cfg.series_col
    short = F.col("status") != "ok"
    seen = status.agg(
        F.count(F.lit(1)).alias("series"), F.min("rows").alias("fewest"), F.max("rows").alias("most"), F.sum("rows").alias("total"),
        F.min_by(s, "rows").alias("smallest"), F.count(F.when(short, 1)).alias("short"), F.min(F.when(short, F.col(s))).alias("one"),
    ).first()
    if not seen["series"]:
        raise ValueError("The input has no rows")
    if seen["fewest"] < 3:
        raise ValueError(f"Series {seen['smallest']!r} has {seen['fewest']} rows; at least 3 are needed")
    if seen["short"] and (cfg.on_short == "error" or seen["short"] == seen["series"]):
        raise ValueError(f"{seen['short']} of {seen['series']} series are too short for windows of {cfg.context_length} + {cfg.prediction_length} rows and a test part, such as {seen['one']!r}")
    return pin_layout(base.sparkSession, cfg, seen["most"], seen["total"])


def run_end_to_end(series: DataFrame, cfg: ForecastConfig = ForecastConfig(), cleaned: bool = False, tune_on: DataFrame | None = None) -> dict[str, DataFrame]:
    """Returns named DataFrames (cleaned, series_status, dataset, params, predictions_a, windows, bands,
    aligned, truth_gap, weights, blended, metrics, comparison) and the fitted ``model``.

    The clean frame and the aligned frame are stored in the shared checkpoint folder: both branches
    read the one (bucketed by series, so neither shuffles it again, unless a series is too large for one
    task or the frame came cleaned with its layout unknown), and weights, metrics and charts the other, so
    nothing is cut, sampled or predicted twice. ``tune_on`` (default: the scored aligned frame, as in the reproduced behaviour) is
    the frame the blend weight is tuned on.

    Raises on no rows, on series of fewer than three rows, on series too short for windows (unless
    ``cfg.on_short="skip"``; ``series_status`` then names them), on forecasts with no row in common, and
    on missing or non-finite values among the rows to score.
    """
    s, t, y = cfg.series_col, cfg.time_col, cfg.target
    if not cleaned:  # the one count that cleaning would take anyway
        cfg = resolve_layout(series, cfg)
    base = series if cleaned else clean.clean_series(series, cfg, value_cols=[c for c in series.columns if c not in (s, t)])
    # while no series is too large for one task, both branches read a table that is laid out by series
    base = bucketed(base, s, t) if cfg.layout == "series" else materialize(base)
    status = windows.series_status(base, cfg)
    cfg = _checked(base, status, cfg)

    # series too short for windows were refused above, or are to be left out
    win = windows.context_windows(base.select(s, t, y), cfg.with_(on_short="skip"), phases=("test",))
    paths = probabilistic.sample_paths(win, cfg)
    bands = probabilistic.prediction_bands(paths, cfg.confidence)
    pred_b = bands.select(s, F.col("ts").alias(t), F.col("y").alias("y_true_b"), F.col("median").alias("pred_b"), "low", "high")

    # the flagged feature frame is materialised inside tabular_dataset; the scaled frame is a
    # projection plus a small parameter join over it, so it is not written a second time
    ds, params, cols = tabular.tabular_dataset(base, cfg)
    model = tabular.GbtForecaster(cfg).fit(ds, cols)
    pred_a = model.predict(ds.filter(F.col("split") == "test"), params, keep=["y_raw"]).select(
        s, t, F.col("y_raw").alias("y_true_a"), F.col("prediction").alias("pred_a")
    )

    aligned = align.align_forecasts(pred_a, pred_b, s, t, cfg=cfg).withColumn("y_true", F.col("y_true_b"))
    # mean |truth_a - truth_b| over the aligned rows; above 1e-6 the two branches disagree on truth.
    # It and the counts of missing values are observed while the frame is written
    difference = F.avg(F.abs(F.col("y_true_a") - F.col("y_true_b"))).alias("truth_gap")
    aligned, seen = metrics.write_complete(aligned, ["y_true", "pred_a", "pred_b"], materialize, [difference])
    gap = aligned.sparkSession.createDataFrame([(seen["truth_gap"], seen["n"])], "truth_gap DOUBLE, n BIGINT")
    if cfg.auto_tune:
        weights = align.tune_blend(tune_on if tune_on is not None else aligned, points=cfg.search_points)
    else:
        weights = aligned.sparkSession.createDataFrame([(min(max(cfg.blend_weight, 0.0), 1.0), None)], "weight DOUBLE, rmse DOUBLE")
    blended = align.blend_tuned(aligned, weights)
    m = metrics.forecast_metrics(blended, {"gbt": "pred_a", "probabilistic": "pred_b", "hybrid": "hybrid_pred"}, y="y_true", metrics=SCORES)
    return {
        "cleaned": base,
        "series_status": status,
        "dataset": ds,
        "params": params,
        "predictions_a": pred_a,
        "windows": win,
        "bands": bands,
        "aligned": aligned,
        "truth_gap": gap,
        "weights": weights,
        "blended": blended,
        "metrics": m,
        "comparison": metrics.compare_models(m, extra=["n"]),
        "model": model,
    }

"""End-to-end run from a raw CSV: ``python -m tsengine --input data.csv --output out/``.

Lands the CSV (all columns as text), cleans it into one series (or many with ``--series-col``),
runs both forecasting branches, aligns and blends them, and writes metrics (JSON per model),
the comparison table (CSV), the fitted tree model, and chart-ready frames (Parquet).
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.operators import charts, clean
from tsengine.plans.end_to_end import run_end_to_end
from tsengine.plans.layout import resolve_layout
from tsengine.session import clear_scratch, ensure_checkpoint_dir
from tsengine.sources import artefacts, files, sinks


#: Settings of ForecastConfig that the command line takes, by the same names.
SETTINGS = (
    "test_size", "validation_ratio", "max_lag", "scaler", "context_length", "prediction_length", "on_short", "num_samples", "confidence", "season_length",
    "sampler", "blend_weight", "search_points", "seed", "max_iter", "patience", "step_size", "max_depth", "subsample", "feature_subset", "column_sample", "min_instances_per_node", "min_info_gain", "layout",
)
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="tsengine")
    p.add_argument("--input", required=True, help="raw CSV file or folder (any Hadoop path)")
    p.add_argument("--output", required=True, help="output folder")
    p.add_argument("--time-col", default="timestamp")
    p.add_argument("--target", default="value")
    p.add_argument("--series-col", default=None, help="column naming the series (default: one series)")
    p.add_argument("--time-format", action="append", help="pattern of the time column; may be repeated, the first that fits counts")
    for f in fields(ForecastConfig):
        if f.name in SETTINGS:
            p.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    p.add_argument("--no-auto-tune", action="store_true", help="blend with --blend-weight instead of tuning it")
    p.add_argument("--versioned", action="store_true", help="write a new version of all artefacts under <output>/artefacts instead of replacing the last run's")
    a = p.parse_args(argv)

    spark = SparkSession.builder.appName("tsengine").getOrCreate()
    ensure_checkpoint_dir(spark)
    out = a.output.rstrip("/")
    landed = files.land_csv(spark, a.input, f"{out}/landed")
    raw = files.read_series(spark, landed)
    files.require_columns(raw, [a.time_col, a.target])
    series = raw.withColumn("series_id", F.col(a.series_col).cast("string") if a.series_col else F.lit("all"))
    values = [c for c in raw.columns if c not in (a.time_col, a.series_col, files.INPUT_ORDER)]
    cfg = ForecastConfig(auto_tune=not a.no_auto_tune, **{name: getattr(a, name) for name in SETTINGS})
    cfg = resolve_layout(series, cfg)
    cleaned = clean.clean_series(series.select("series_id", a.time_col, files.INPUT_ORDER, *values), cfg, value_cols=values, time_raw=a.time_col, fmt=a.time_format or TIME_FORMATS)
    cleaned = cleaned.withColumnRenamed(a.target, cfg.target) if a.target != cfg.target else cleaned
    res = run_end_to_end(cleaned, cfg, cleaned=True)

    def write(out: str) -> None:
        sinks.write_metrics(res["metrics"], f"{out}/metrics")
        sinks.write_comparison(res["comparison"], f"{out}/model_comparison")
        res["model"].save(f"{out}/model")
        charts.plot_frame(res["blended"], ["y_true", "pred_a", "hybrid_pred"]).write.mode("overwrite").parquet(f"{out}/plot_forecast")
        charts.plot_frame(res["blended"], ["y_true", "pred_b"], bands=True).write.mode("overwrite").parquet(f"{out}/plot_probabilistic")

    if a.versioned:  # all of a run's artefacts become current together, or none
        artefacts.publish(spark, f"{out}/artefacts", write, {"input": a.input})
    else:
        write(out)
    clear_scratch(spark)
    return res


if __name__ == "__main__":
    main()

"""Wall time of the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line.

Each query is executed in full with the ``noop`` sink (no collect to the driver). Before timing,
every headline query runs once untimed on the smallest scale factor, so the timed runs measure
steady-state execution rather than JVM start-up, class loading and first-time code generation.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tsengine.plans.catalog import QUERIES  # noqa: E402
from tsengine.session import local_session  # noqa: E402

HEADLINE = [
    "flagship",
    "clean_series",
    "build_features",
    "build_features_blocks",
    "split_fit_val_test",
    "scaler_standard_apply",
    "context_windows",
    "prediction_bands",
    "sample_paths_bootstrap",
    "align_tail_fallback",
    "tune_blend_by_series",
    "forecast_metrics",
    "plot_frame_bands",
    "tail_n",
    "gbt_predict",
    "end_to_end",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="tsengine-bench", extra={"spark.sql.shuffle.partitions": str(max(8, int(cpus)))})
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    if os.path.isdir(warm_dir):
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times, errors = {}, {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and keep timing the others
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    tag = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(tag)
    except ValueError:
        sf = tag
    out = {"metric": "total_query_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

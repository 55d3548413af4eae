"""Hot-key stress check: every lineitem of a scale factor as ONE series (unique stamps from the
ship date plus order and line numbers). Builds features in the per-series layout and with the
"auto" rule (which splits this series into blocks), checks they agree, and prints both times.

usage: python tools/hot_series.py [sf_dir]
"""

from __future__ import annotations

import sys
import time

sys.path.insert(0, ".")

from pyspark.sql import functions as F  # noqa: E402

from tsengine.config import ForecastConfig  # noqa: E402
from tsengine.operators import features  # noqa: E402
from tsengine.plans.layout import resolve_layout  # noqa: E402
from tsengine.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hot = li.select(
        F.lit("all").alias("series_id"),
        F.timestamp_add("MICROSECOND", F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_shipdate").cast("timestamp_ntz")).alias("ts"),
        F.col("l_extendedprice").alias("y"),
    )
    cfg = ForecastConfig()
    chosen = resolve_layout(hot, cfg)
    print(f"rows={hot.count()} auto -> layout={chosen.layout} block_rows={chosen.block_rows}")
    out = {}
    for name, c in (("series", cfg.with_(layout="series")), ("auto", cfg), ("series", cfg.with_(layout="series")), ("auto", cfg)):
        t0 = time.perf_counter()
        row = features.build_features(hot, c).agg(F.count("*").alias("n"), F.sum("y_lag_336").alias("s")).first()
        out[name] = row
        print(f"{name:6s} {time.perf_counter() - t0:6.2f}s rows={row['n']}")
    same = out["series"]["n"] == out["auto"]["n"] and abs(out["series"]["s"] - out["auto"]["s"]) <= 1e-9 * abs(out["series"]["s"])
    print("same result:", same)


if __name__ == "__main__":
    main()

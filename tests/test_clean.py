import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import frame

from tsengine.config import ForecastConfig
from tsengine.operators import clean


def T(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


def test_interpolate_matches_pandas_time_method(spark):
    stamps = [T(0), T(1), T(3), T(4), T(7), T(8), T(9)]
    vals = [None, 1.0, None, 4.0, None, 10.0, None]
    got = clean.interpolate_time(frame(spark, [("a", t, v) for t, v in zip(stamps, vals)]), ["y"]).orderBy("ts").toPandas()
    s = pd.Series(vals, index=pd.DatetimeIndex(stamps), dtype="float64")
    exp = s.interpolate(method="time", limit_direction="both").to_numpy()
    np.testing.assert_allclose(got["y"].to_numpy(), exp, rtol=0, atol=1e-12)


def test_interpolate_is_per_series(spark):
    rows = [("a", T(0), 1.0), ("a", T(2), None), ("b", T(1), 100.0), ("a", T(4), 5.0)]
    got = clean.interpolate_time(frame(spark, rows), ["y"]).orderBy("series_id", "ts").collect()
    assert [r.y for r in got] == [1.0, 3.0, 5.0, 100.0]


def test_dedup_last_tie_break(spark):
    df = spark.createDataFrame([("a", T(0), 1, "x"), ("a", T(0), 5, "y"), ("a", T(1), 2, "z")], "series_id STRING, ts TIMESTAMP_NTZ, event_id INT, v STRING")
    got = {(r.ts, r.v) for r in clean.dedup_last(df, ["series_id", "ts"], ["event_id"]).collect()}
    assert got == {(T(0), "y"), (T(1), "z")}
    with pytest.raises(ValueError):
        clean.dedup_last(df, ["series_id", "ts"], [])


def test_coerce_numeric_pandas_rules(spark):
    vals = ["1.5", " 2 ", "1e3", "1.0d", "nan", "n/a", None, "-inf", ".5"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i INT, v STRING")
    got = [r.v for r in clean.coerce_numeric(df, ["v"]).orderBy("i").collect()]
    assert got[:3] == [1.5, 2.0, 1000.0]
    assert got[3] is None and got[4] is None and got[5] is None and got[6] is None
    assert got[7] == float("-inf") and got[8] == 0.5


def test_parse_ts_drops_unparseable(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "bad"), ("a", "2024-13-01 00:00:00")], "series_id STRING, raw STRING")
    out = clean.parse_ts(df, "raw", out="ts")
    assert out.count() == 1 and dict(out.dtypes)["ts"] == "timestamp_ntz"


def test_clean_series_all_null_column_modes(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", "1", "x"), ("a", "2024-01-01 01:00:00", "2", "y")], "series_id STRING, t STRING, y STRING, junk STRING")
    cfg = ForecastConfig()
    assert clean.clean_series(df, cfg, value_cols=["y", "junk"], time_raw="t").count() == 0  # reference behaviour
    kept = clean.clean_series(df, cfg, value_cols=["y", "junk"], time_raw="t", on_all_null="drop_column")
    assert kept.count() == 2 and "junk" not in kept.columns
    with pytest.raises(ValueError):
        clean.clean_series(df, cfg, value_cols=["y", "junk"], time_raw="t", on_all_null="error")


def test_fill_edges_ffill_then_bfill(spark):
    rows = [("a", T(0), None), ("a", T(1), 2.0), ("a", T(2), None), ("a", T(3), 4.0), ("a", T(4), None)]
    got = [r.y for r in clean.fill_edges(frame(spark, rows), ["y"]).orderBy("ts").collect()]
    assert got == [2.0, 2.0, 2.0, 4.0, 4.0]
    causal = [r.y for r in clean.fill_edges(frame(spark, rows), ["y"], mode="ffill").orderBy("ts").collect()]
    assert causal == [None, 2.0, 2.0, 4.0, 4.0]


def test_clean_blocks_layout_equals_series_layout(spark):
    import random

    rng = random.Random(5)
    rows = []
    for sid, n in (("a", 300), ("b", 40), ("c", 3)):
        for i in range(n):
            v = None if rng.random() < 0.3 else str(rng.uniform(0, 50))
            rows.append((sid, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:{rng.randint(0, 59):02d}:00", v, i))
    rows.append(("c", "2024-01-01 00:00:00", None, 999))
    df = spark.createDataFrame(rows, "series_id STRING, t STRING, y STRING, eid INT")
    for fill in ("both", "causal"):
        kw = dict(value_cols=["y"], time_raw="t", tie_break=["eid"], fill=fill)
        a = clean.clean_series(df, ForecastConfig(layout="series"), **kw).orderBy("series_id", "ts").toPandas()
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        try:
            b = clean.clean_series(df, ForecastConfig(layout="blocks"), **kw).orderBy("series_id", "ts").toPandas()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12)


def test_clean_series_plan_single_shuffle(spark):
    from tsengine.sources import fixtures as fx

    raw = fx.events_dirty(spark, "/root/testdata/sf0.001")
    out = clean.clean_series(raw, ForecastConfig(layout="series"), value_cols=["value_raw"], time_raw="ts_raw", tie_break=["event_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan

import datetime as dt
import random

import numpy as np
import pandas as pd
from conftest import frame
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.operators import features
from tsengine.plans import layout


def series_rows(n, sid="a", seed=0):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [(sid, t0 + dt.timedelta(hours=i), float(rng.randint(0, 100))) for i in range(n)]


def test_lag_steps_and_rolling_windows():
    assert len(features.lag_steps(48)) == 50
    assert features.lag_steps(2, (1, 2, 24)) == [1, 2, 24]
    assert features.rolling_windows(48) == [3, 6, 12, 24, 48]
    assert features.rolling_windows(2) == [3]


def test_lags_and_rolling_match_pandas(spark):
    rows = series_rows(60)
    df = frame(spark, rows)
    got = features.add_rolling(features.add_lags(df, [1, 5]), [3, 6]).orderBy("ts").toPandas()
    y = pd.Series([r[2] for r in rows])
    np.testing.assert_allclose(got["y_lag_5"].to_numpy(dtype=float), y.shift(5).to_numpy(), equal_nan=True)
    sh = y.shift(1)
    np.testing.assert_allclose(got["y_roll_mean_6"].to_numpy(dtype=float), sh.rolling(6, min_periods=6).mean().to_numpy(), equal_nan=True, atol=1e-9)
    np.testing.assert_allclose(got["y_roll_std_3"].to_numpy(dtype=float), sh.rolling(3, min_periods=3).std().to_numpy(), equal_nan=True, atol=1e-9)


def test_calendar_monday_zero(spark):
    df = frame(spark, [("a", dt.datetime(2024, 1, 1, 5), 1.0), ("a", dt.datetime(2024, 1, 6, 5), 1.0)])  # Mon, Sat
    got = features.add_calendar(df).orderBy("ts").collect()
    assert [r.day_of_week for r in got] == [0, 5] and [r.is_weekend for r in got] == [0, 1]
    assert dict(features.add_calendar(df).dtypes)["hour"] == "smallint"


def test_no_leakage_future_change_keeps_past_features(spark):
    rows = series_rows(80)
    changed = rows[:60] + [(s, t, v + 1000.0) for s, t, v in rows[60:]]
    cfg = ForecastConfig(max_lag=6, seasonal_anchors=(1, 12), rolling_candidates=(3, 6))
    a = features.build_features(frame(spark, rows), cfg).filter(F.col("ts") < rows[60][1]).orderBy("ts").toPandas()
    b = features.build_features(frame(spark, changed), cfg).filter(F.col("ts") < rows[60][1]).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_block_layout_equals_series_layout(spark):
    rows = series_rows(500, "a", 1) + series_rows(130, "b", 2) + series_rows(7, "c", 3)
    cfg = ForecastConfig(max_lag=12, seasonal_anchors=(1, 24), rolling_candidates=(3, 12))
    plain = features.build_features(frame(spark, rows), cfg.with_(layout="series")).orderBy("series_id", "ts").toPandas()
    blocked = features.build_features(frame(spark, rows), cfg.with_(layout="blocks", block_rows=40)).orderBy("series_id", "ts").toPandas()
    pd.testing.assert_frame_equal(plain, blocked[plain.columns])


def test_range_positions_match_row_number(spark):
    rows = series_rows(300, "a", 1) + series_rows(50, "b", 2)
    df = frame(spark, rows)
    got = layout.range_positions(df, "series_id", "ts", out="pos", num_partitions=7).toPandas()
    got = got.sort_values(["series_id", "ts"])
    exp = got.groupby("series_id").cumcount().to_numpy()
    assert (got["pos"].to_numpy() == exp).all()


def test_build_features_plan_has_one_exchange_and_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("y"))
    plan = features.build_features(df, ForecastConfig(layout="series"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "ArrowEval" not in plan


def test_tail_n(spark):
    out = features.tail_n(frame(spark, series_rows(10) + series_rows(2, "b")), 3)
    assert out.groupBy("series_id").count().orderBy("series_id").collect()[0]["count"] == 3
    assert out.count() == 5


def test_range_positions_inside_a_union(spark):
    """Task partition ids are shifted inside a union; positions must not depend on them."""
    a = frame(spark, series_rows(120, "a", 1) + series_rows(40, "b", 2))
    b = frame(spark, series_rows(90, "c", 3))
    pa = layout.range_positions(a, "series_id", "ts", out="pos", num_partitions=5)
    pb = layout.range_positions(b, "series_id", "ts", out="pos", num_partitions=4)
    got = pb.unionByName(pa).toPandas().sort_values(["series_id", "ts"])
    assert (got["pos"].to_numpy() == got.groupby("series_id").cumcount().to_numpy()).all()


def test_resolve_layout_fair_share_rule(spark):
    par = spark.sparkContext.defaultParallelism
    many = frame(spark, [r for k in range(20) for r in series_rows(30, f"s{k}", k)])
    cfg = ForecastConfig(min_split_rows=50)
    assert layout.resolve_layout(many, cfg).layout == "series"  # 30 rows each, below the split floor
    hot = frame(spark, series_rows(600, "hot", 1) + series_rows(20, "cold", 2))
    got = layout.resolve_layout(hot, cfg)
    assert got.layout == "blocks" and got.block_rows == max(1, min(cfg.block_rows, -(-600 // (4 * par))))
    assert layout.resolve_layout(hot, cfg.with_(layout="series")).layout == "series"  # pinned stays

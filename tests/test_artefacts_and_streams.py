import datetime as dt
import os
import random

import numpy as np
import pytest
from conftest import SF001, frame
from pyspark.sql import functions as F

from tsengine import session
from tsengine.config import ForecastConfig
from tsengine.operators import charts, clean, features, metrics, probabilistic, windows
from tsengine.plans.end_to_end import run_end_to_end
from tsengine.sources import artefacts
from tsengine.sources import fixtures as fx
from tsengine.streaming import stream_clean_lags

DAY = dt.datetime(2024, 1, 1)


# ------------------------------------------------------------------ versions


def test_a_failing_version_leaves_the_one_before(spark, tmp_path):
    root = str(tmp_path / "metrics")
    with pytest.raises(FileNotFoundError):
        artefacts.current(spark, root)
    first = artefacts.publish(spark, root, lambda p: spark.range(3).write.parquet(p), {"rows": 3})

    def half(path):
        spark.range(5).write.parquet(f"{path}/a")
        spark.range(5).select(F.raise_error(F.lit("no")).alias("x")).write.parquet(f"{path}/b")

    with pytest.raises(Exception, match="no"):
        artefacts.publish(spark, root, half)
    assert artefacts.current(spark, root) == first and spark.read.parquet(first).count() == 3
    assert sorted(os.listdir(root)) == sorted(["_versions", first.rsplit("/", 1)[1]])  # nothing is left behind
    second = artefacts.publish(spark, root, lambda p: spark.range(4).write.parquet(p))
    assert artefacts.current(spark, root) == second
    assert [(v["number"], v.get("rows")) for v in artefacts.versions(spark, root)] == [(1, 3), (2, None)]


def test_names_are_taken_once_and_half_written_ones_do_not_count(spark, tmp_path):
    root = str(tmp_path / "a")
    first = artefacts.publish(spark, root, lambda p: spark.range(1).write.parquet(p))
    (tmp_path / "a" / "_versions" / "0000000002.json").write_text("")  # another writer is about to name its version
    assert artefacts.current(spark, root) == first
    third = artefacts.publish(spark, root, lambda p: spark.range(1).write.parquet(p))
    assert [v["number"] for v in artefacts.versions(spark, root)] == [1, 3] and artefacts.current(spark, root) == third
    assert artefacts.drop_versions(spark, root, keep=1) == 1 and not os.path.exists(first)
    assert artefacts.current(spark, root) == third
    with pytest.raises(ValueError):
        artefacts.drop_versions(spark, root, keep=0)


# ------------------------------------------------------------------ arriving rows

SCHEMA = "series_id STRING, ts TIMESTAMP_NTZ, y DOUBLE, place BIGINT"


def arriving(n=300, seed=4):
    r = random.Random(seed)
    rows, t = [], DAY
    for i in range(n):
        t += dt.timedelta(minutes=r.randrange(20))
        rows.append((r.choice(["a", "b", None]), t - dt.timedelta(minutes=r.choice([0, 0, 0, 30, 55])), None if r.random() < 0.2 else float(i), i))
        if r.random() < 0.1:
            rows.append((*rows[-1][:2], float(-i), 10_000 + i))  # the same stamp again, later
    rows.append(("a", None, 1.0, 99_999))
    return rows


def emitted(spark, dst):
    return sorted((tuple(r) for r in spark.read.parquet(dst).collect()), key=str)


def test_two_batches_equal_one_and_the_batch_operators(spark, tmp_path):
    rows, steps = arriving(), [1, 3]
    late = ("b", rows[149][1] - dt.timedelta(minutes=40), 5.0, 50_000)  # behind the newest row of the first batch
    batches = [rows[:150], [late, *rows[150:]]]
    results = []
    for name, parts in (("two", batches), ("one", [batches[0] + batches[1]])):
        src, dst = str(tmp_path / name / "src"), str(tmp_path / name / "dst")
        for part in parts:
            frame(spark, part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
            stream_clean_lags(spark, src, dst, SCHEMA, steps, "1 hour", "place")
        results.append(emitted(spark, dst))
    assert results[0] == results[1]
    everything = frame(spark, batches[0] + batches[1], SCHEMA).filter("ts IS NOT NULL")
    limit = everything.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    cleaned = clean.clean_series(everything, ForecastConfig(layout="series"), value_cols=["y"], tie_break=["place", "y"], fill="causal")
    want = features.add_lags(cleaned, steps).filter(F.col("ts") <= F.lit(limit))
    assert sorted((tuple(r) for r in want.collect()), key=str) == results[0]
    assert any(r[1] == late[1] and r[0] == "b" for r in results[0])


def test_rows_behind_the_watermark_and_silent_series(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    hour = lambda h: DAY + dt.timedelta(hours=h)
    for part in ([("a", hour(0), 1.0, 0), ("b", hour(1), 2.0, 1), ("a", hour(9), 3.0, 2)], [("a", hour(2), 7.0, 3), ("a", hour(20), 4.0, 4)]):
        frame(spark, part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream_clean_lags(spark, src, dst, SCHEMA, [1], "1 hour", "place")
    # b never came again, but its row is final; the row of hour 2 came when hour 8 was passed
    assert emitted(spark, dst) == [("a", hour(0), 1.0, None), ("a", hour(9), 3.0, 1.0), ("b", hour(1), 2.0, None)]
    with pytest.raises(ValueError):
        stream_clean_lags(spark, src, dst, SCHEMA, [], "1 hour", "place")


# ------------------------------------------------------------------ loaded scorer


def test_the_model_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")
    inner = probabilistic.seasonal_analog_model(4, 6, 5)

    def factory():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return inner()

    rows = [("s", i, [float(v) for v in range(n)], [(DAY, 0.0)] * 6) for i, n in enumerate([0, 4, 5, 12, 20, 30] * 20)]
    win = spark.createDataFrame(rows, "series_id STRING, window_id LONG, ctx ARRAY<DOUBLE>, horizon ARRAY<STRUCT<ts: TIMESTAMP_NTZ, y: DOUBLE>>").repartition(12)
    cfg = ForecastConfig(context_length=20, prediction_length=6, season_length=5, num_samples=4)
    out = probabilistic.sample_paths(win, cfg, method="model", factory=factory, batch_size=3)
    got = {r.window_id: r.samples for r in out.collect()}
    assert {r.window_id: r.samples for r in probabilistic.sample_paths(win, cfg, method="analog").collect()} == got
    out.collect()  # 24 tasks and 80 batches later
    pids = open(log).read().split()
    assert len(pids) == len(set(pids)) <= spark.sparkContext.defaultParallelism * 2
    with pytest.raises(ValueError):
        probabilistic.sample_paths(win, cfg, method="model")


def test_a_model_of_the_wrong_shape_is_refused(spark):
    win = spark.createDataFrame([("s", 0, [1.0, 2.0])], "series_id STRING, window_id LONG, ctx ARRAY<DOUBLE>")
    cfg = ForecastConfig(context_length=2, prediction_length=6, num_samples=4)
    with pytest.raises(Exception, match="must return 1 x 4 x 6"):
        probabilistic.sample_paths(win, cfg, method="model", factory=lambda: lambda c, n: np.zeros((len(c), 4, 5))).collect()


# ------------------------------------------------------------------ stored layout, observed guards

PIPE = ForecastConfig(max_lag=3, seasonal_anchors=(1,), rolling_candidates=(3,), max_iter=2, patience=1, max_depth=2, context_length=60, prediction_length=10, season_length=7, min_info_gain=0.0)


def shuffles(df):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning(series_id")


def test_both_branches_read_the_stored_layout_without_a_shuffle(spark):
    raw = fx.lineitem_daily(spark, SF001)
    base = session.bucketed(clean.clean_series(raw, PIPE.with_(layout="series"), value_cols=["y", "x_qty", "x_disc"]), "series_id", "ts")
    assert base.count() == raw.count()
    cfg = PIPE.with_(layout="series")
    assert shuffles(features.build_features(base, cfg)) == 0
    assert shuffles(windows.context_windows(base.select("series_id", "ts", "y"), cfg.with_(on_short="skip"))) == 0
    assert shuffles(windows.series_status(base, cfg)) == 0
    assert shuffles(features.build_features(session.materialize(base), cfg)) == 1  # what a checkpoint costs
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("tsengine_")}
    assert tables()
    session.clear_scratch(spark)
    assert not tables()


def test_guards_are_observed_while_the_frame_is_written(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    sc = spark.sparkContext

    def jobs(f):
        sc.setJobGroup("counted", "")
        before = len(sc.statusTracker().getJobIdsForGroup("counted"))
        f()
        sc.setJobGroup("other", "")
        return len(sc.statusTracker().getJobIdsForGroup("counted")) - before

    plain = jobs(lambda: session.materialize(df))
    seen = {}
    observed = jobs(lambda: seen.update(metrics.write_complete(df, ["a", "b"], session.materialize, [F.avg(F.col("b") - F.col("a")).alias("gap")])[1]))
    assert plain == observed and seen == {"a": 0, "b": 0, "n": 2, "gap": 1.5}
    for bad, text in ((df.limit(0), "No rows"), (df.withColumn("a", F.lit(float("nan"))), "missing or non-finite"), (df.filter("a > 9"), "No rows")):
        with pytest.raises(ValueError, match=text):
            metrics.write_complete(bad, ["a", "b"], session.materialize)

    monkeypatch.setattr(metrics, "assert_complete", None)  # not called any more
    out = run_end_to_end(fx.lineitem_daily(spark, SF001), PIPE)
    gap = out["truth_gap"].first()
    assert gap.n == out["aligned"].count() and gap.truth_gap == pytest.approx(0, abs=1e-9)


def test_extremes_keep_their_stamps(spark):
    minute = dt.timedelta(minutes=1)
    values = [5.0, 1.0, None, 9.0, 1.0, 9.0, 4.0]
    df = frame(spark, [("s", DAY + i * minute, v) for i, v in enumerate(values)])
    r = charts.plot_frame(df, ["y"], max_points=1).collect()[0]
    assert (r.ts, r.v_min, r.ts_min, r.v_max, r.ts_max) == (DAY, 1.0, DAY + minute, 9.0, DAY + 3 * minute)
    empty = charts.plot_frame(df.withColumn("y", F.lit(None).cast("double")), ["y"], max_points=1).collect()[0]
    assert (empty.value, empty.v_min, empty.ts_min) == (None, None, None)
    plan = charts.plot_frame(df, ["y"], bands=True, band_cols=("y", "y"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("HashAggregate" if "HashAggregate" in plan else "Aggregate")  # lines become rows after it

"""Inputs that must be refused, and values that must not depend on session, layout or batch."""

import datetime as dt

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from tsengine import session
from tsengine.config import ForecastConfig
from tsengine.operators import align, clean, features, metrics, probabilistic, scale, windows
from tsengine.plans.end_to_end import run_end_to_end
from tsengine.plans.layout import range_positions
from tsengine.sources import files
from tsengine.streaming import land_stream

T0 = dt.datetime(2024, 1, 1)
SMALL = ForecastConfig(
    max_lag=3, seasonal_anchors=(1, 7), rolling_candidates=(3,), context_length=28, prediction_length=7, season_length=7, num_samples=4, max_iter=2, patience=1, max_depth=2, step_size=0.1, min_info_gain=0.0,
)


def rows_for(n, sid="a"):
    return [(sid, T0 + dt.timedelta(days=i), float((i * 7919) % 101)) for i in range(n)]


def test_empty_and_tiny_inputs(spark):
    with pytest.raises(ValueError, match="no rows"):
        run_end_to_end(frame(spark, []), SMALL, cleaned=True)
    with pytest.raises(ValueError, match="at least 3"):
        run_end_to_end(frame(spark, rows_for(2)), SMALL, cleaned=True)
    with pytest.raises(ValueError, match="no rows"):
        files.require_rows(frame(spark, []), "series_id")


def test_short_series_stop_the_pipeline_or_are_named(spark):
    df = frame(spark, rows_for(200) + rows_for(20, "b"))
    with pytest.raises(ValueError, match="too short"):
        run_end_to_end(df, SMALL, cleaned=True)
    out = run_end_to_end(df, SMALL.with_(on_short="skip"), cleaned=True)
    assert {r.series_id: r.status for r in out["series_status"].collect()} == {"a": "ok", "b": "too short for windows"}
    assert {r.n for r in out["comparison"].collect()} == {out["aligned"].count()}


def test_other_column_names_through_the_pipeline(spark):
    cfg = SMALL.with_(series_col="sensor", time_col="at", target="load")
    names = {"series_id": "sensor", "ts": "at", "y": "load"}
    df = frame(spark, rows_for(120) + rows_for(150, "b")).withColumnsRenamed(names)
    plain = run_end_to_end(frame(spark, rows_for(120) + rows_for(150, "b")), SMALL, cleaned=True)
    for layout in ("series", "blocks"):
        out = run_end_to_end(df, cfg.with_(layout=layout, block_rows=40), cleaned=True)
        assert {"sensor", "at"} <= set(out["aligned"].columns)
        assert out["aligned"].count() == plain["aligned"].count()
        got, expected = (sorted((r.series, r.t, round(r.pred_b, 9)) for r in o["aligned"].select(F.col(s).alias("series"), F.col(t).alias("t"), "pred_b").collect()) for o, s, t in ((out, "sensor", "at"), (plain, "series_id", "ts")))
        assert got == expected


def test_nothing_to_score(spark):
    df = spark.createDataFrame([("a", 1.0, None)], "series_id STRING, y_true DOUBLE, p DOUBLE")
    with pytest.raises(ValueError, match="missing"):
        metrics.assert_complete(df, ["y_true", "p"])
    with pytest.raises(ValueError, match="nothing in common"):
        metrics.assert_complete(df.limit(0), ["p"])
    for odd in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(ValueError, match="non-finite"):
            metrics.assert_complete(spark.createDataFrame([(odd,)], "p DOUBLE"), ["p"])
    with pytest.raises(ValueError):
        metrics.compare_models(df, order=())


def test_models_are_scored_and_blended_on_shared_rows(spark):
    rows = [(float(i), float(i) + 1, float(i) - 1 if i < 5 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "y_true DOUBLE, pred_a DOUBLE, pred_b DOUBLE")
    got = {(r.model, r.metric): r.value for r in metrics.forecast_metrics(df, ["pred_a", "pred_b"], metrics=("rmse", "n")).collect()}
    assert got == {("pred_a", "rmse"): 1.0, ("pred_a", "n"): 5.0, ("pred_b", "rmse"): 1.0, ("pred_b", "n"): 5.0}
    best = align.tune_blend(df).first()
    assert best.weight == 0.5 and best.rmse == pytest.approx(0.0, abs=1e-9)


def test_tuned_weight_equals_a_direct_scan(spark):
    r = np.random.default_rng(3)
    y, a, b = r.normal(size=(3, 200))
    a, b = y + a, y - 0.5 * b
    df = spark.createDataFrame([(float(p), float(q), float(s)) for p, q, s in zip(y, a, b, strict=True)], "y_true DOUBLE, pred_a DOUBLE, pred_b DOUBLE")
    grid = align.weight_grid(101)
    direct = [float(np.sqrt(np.mean((y - (w * a + (1 - w) * b)) ** 2))) for w in grid]
    best = align.tune_blend(df).first()
    assert best.weight == grid[int(np.argmin(direct))] and best.rmse == pytest.approx(min(direct))


def test_scaler_refuses_non_finite_values(spark):
    for odd in (float("inf"), float("nan")):
        df = frame(spark, [("a", T0, 1.0), ("a", T0 + dt.timedelta(days=1), odd)])
        for kind in ("standard", "minmax"):
            with pytest.raises(Exception, match="no scaler fits"):
                scale.fit_scaler(df, ["y"], kind, where=None).collect()


def test_zero_parameters_are_refused(spark):
    df = frame(spark, rows_for(100))
    w = windows.context_windows(df, SMALL)
    with pytest.raises(ValueError):
        probabilistic.sample_paths(w, SMALL, num_samples=0)
    with pytest.raises(ValueError):
        probabilistic.sample_paths(w, SMALL, season_length=0)
    with pytest.raises(ValueError, match="no season"):
        probabilistic.sample_paths(w, SMALL, season_length=29)
    for name in ("context_length", "prediction_length", "stride"):
        with pytest.raises(ValueError):
            windows.context_windows(df, SMALL, **{name: 0})
        with pytest.raises(ValueError):
            windows.context_windows(df, SMALL.with_(**{name: 0}))


def test_stamps_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    raw = spark.createDataFrame([("a", f"2015-03-08 0{h}:30:00", str(h)) for h in (1, 2, 3)], "series_id STRING, t STRING, y STRING")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 02:30 does not exist there
        got = [(str(r.ts), r.y) for r in clean.clean_series(raw, value_cols=["y"], time_raw="t", tie_break=["y"]).orderBy("ts").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [(f"2015-03-08 0{h}:30:00", float(h)) for h in (1, 2, 3)]


def test_time_patterns(spark):
    raw = spark.createDataFrame([("a", "2024-01-01T00:00:00", "1"), ("a", "2024-01-02", "2"), ("a", "x", "3")], "series_id STRING, t STRING, y STRING")
    with pytest.raises(ValueError, match="time format"):
        clean.clean_series(raw, value_cols=["y"], time_raw="t")
    both = clean.clean_series(raw, value_cols=["y"], time_raw="t", fmt=["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"])
    assert sorted(r.y for r in both.collect()) == [1.0, 2.0]
    early = clean.parse_ts(spark.createDataFrame([("1899-12-31 23:59:59",), ("9999-12-31 00:00:01",)], "t STRING"), "t")
    assert sorted(str(r.ts) for r in early.collect()) == ["1899-12-31 23:59:59", "9999-12-31 00:00:01"]


def test_the_last_line_of_a_file_wins(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("t,y\n2024-01-01 00:00:00,10\n2024-01-01 00:00:00,9\n2024-01-01 00:00:00,3\n2024-01-02 00:00:00,5\n")
    landed = spark.read.parquet(files.land_csv(spark, str(tmp_path / "raw.csv"), str(tmp_path / "landed")))
    out = clean.clean_series(landed.withColumn("series_id", F.lit("all")), value_cols=["y"], time_raw="t")
    assert sorted(r.y for r in out.collect()) == [3.0, 5.0]


def test_land_stream_goes_on_without_a_named_checkpoint(spark, tmp_path):
    src, dst = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.csv").write_text("x\n1\n2\n")
    land_stream(spark, str(src), dst, "x INT")
    (src / "b.csv").write_text("x\n3\n4\n5\n")
    land_stream(spark, str(src), dst, "x INT")
    land_stream(spark, str(src), dst, "x INT")
    assert sorted(r.x for r in spark.read.parquet(dst).collect()) == [1, 2, 3, 4, 5]


def test_both_layouts_give_the_same_values(spark):
    rows = [(s, T0 + dt.timedelta(hours=i), None if i % 13 == 5 else float("nan") if i % 17 == 3 else float(i), None if i % 5 == 0 else 9_007_199_254_740_993 + i) for s, n in (("a", 300), ("b", 40), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id STRING, ts TIMESTAMP_NTZ, y DOUBLE, big BIGINT")
    small = ForecastConfig(max_lag=3, seasonal_anchors=(1,), rolling_candidates=(3,), block_rows=16)
    show = lambda d: sorted(map(str, d.collect()))
    for make in (
        lambda layout: features.build_features(df, small.with_(layout=layout), drop_nulls=False),
        lambda layout: features.with_position(df, layout=layout),
        lambda layout: clean.interpolate_time(df, ["y"], cfg=small.with_(layout=layout)),
        lambda layout: clean.fill_edges(df, ["y"], cfg=small.with_(layout=layout)),
        lambda layout: clean.fill_edges(df, ["y"], mode="ffill", cfg=small.with_(layout=layout)),
    ):
        assert show(make("series")) == show(make("blocks").select(make("series").columns))
    plan = range_positions(df, "series_id", "ts")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_plugin_results_do_not_depend_on_the_batch(spark):
    rows = [(f"s{i}", i, [float(x) for x in range(n)]) for i, n in enumerate([0, 3, 7, 8, 15, 30, 100])]
    df = spark.createDataFrame(rows, "series_id STRING, window_id LONG, ctx ARRAY<DOUBLE>")
    fn = probabilistic.seasonal_analog_plugin(7)
    cfg = SMALL.with_(context_length=100)
    got = [{r.series_id: r.samples for r in probabilistic.sample_paths(df.repartition(n), cfg, method="plugin", fn=fn, num_samples=3).collect()} for n in (1, 16)]
    assert got[0] == got[1] and [len(got[0][f"s{i}"]) for i in range(7)] == [0, 0, 1, 1, 2, 3, 3]
    for bad in (lambda c, h, n, s: np.zeros((len(c), 2, h + 1)), lambda c, h, n, s: np.zeros((len(c) + 1, 2, h))):
        with pytest.raises(Exception, match="plugin"):
            probabilistic.sample_paths(df, cfg, method="plugin", fn=bad).collect()


def test_scratch_tables_go_and_nothing_else(spark):
    import os

    session.clear_scratch(spark)
    path = session.scratch_path(spark, "scratch-test")
    spark.range(3).write.parquet(path)
    other = f"{session.ensure_checkpoint_dir(spark)}/kept-{os.getpid()}"
    spark.range(3).write.mode("overwrite").parquet(other)
    session.scratch_path(spark, "never-written")
    assert session.clear_scratch(spark) == 1 and session.clear_scratch(spark) == 0
    assert not os.path.exists(path) and spark.read.parquet(other).count() == 3


def test_no_folder_is_invented_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())

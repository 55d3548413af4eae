"""Edge cases from the tiny in-memory fixture: n=1, all-null, constant, zero targets, duplicate
stamps, even/odd sample counts."""

import datetime as dt

import numpy as np
from conftest import frame

from tsengine.config import ForecastConfig
from tsengine.operators import align, clean, features, metrics, probabilistic, split, windows

T0 = dt.datetime(2024, 1, 1)


def h(i):
    return T0 + dt.timedelta(hours=i)


def test_single_row_series_everywhere(spark):
    df = frame(spark, [("one", h(0), 5.0)])
    assert [r.split for r in split.split_chrono(df, 0.2).collect()] == ["test"]
    assert features.build_features(df, ForecastConfig(max_lag=1, seasonal_anchors=(1,), rolling_candidates=(3,))).count() == 0
    assert windows.context_windows(df, ForecastConfig(context_length=1, prediction_length=1, on_short="skip")).count() == 0
    assert clean.interpolate_time(df, ["y"]).first().y == 5.0


def test_all_null_series_is_dropped_others_kept(spark):
    rows = [("dead", h(i), None) for i in range(3)] + [("live", h(i), float(i) if i != 1 else None) for i in range(3)]
    out = clean.drop_incomplete(clean.interpolate_time(frame(spark, rows), ["y"]))
    assert sorted((r.series_id, r.y) for r in out.collect()) == [("live", 0.0), ("live", 1.0), ("live", 2.0)]


def test_constant_and_zero_targets_metrics(spark):
    rows = [("s", h(i), 0.0, 0.0, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "series_id STRING, ts TIMESTAMP_NTZ, y_true DOUBLE, exact DOUBLE, off DOUBLE")
    m = {(r.model, r.metric): r.value for r in metrics.forecast_metrics(df, ["exact", "off"]).collect()}
    assert m[("exact", "r2")] == 1.0 and m[("off", "r2")] == 0.0
    eps = np.finfo(np.float64).eps
    assert m[("exact", "mape")] == 100.0 * abs(eps - 0.0) / eps  # zero truth replaced by eps
    assert m[("off", "mape")] == 100.0 * abs(eps - 1.0) / eps


def test_duplicate_stamps_keep_latest_id(spark):
    df = spark.createDataFrame(
        [("s", "2024-01-01 00:00:00", "1", 1), ("s", "2024-01-01 00:00:00", "2", 7), ("s", "2024-01-01 01:00:00", "n/a", 3)],
        "series_id STRING, t STRING, v STRING, eid INT",
    )
    out = clean.clean_series(df, ForecastConfig(), value_cols=["v"], time_raw="t", tie_break=["eid"]).orderBy("ts").collect()
    assert [r.v for r in out] == [2.0, 2.0]  # later id wins; the unparseable value is back-filled


def _bands_for(spark, n_samples):
    rows = [("s", h(i), float((i * 37) % 11)) for i in range(400)]
    cfg = ForecastConfig(context_length=8 * n_samples, prediction_length=4, season_length=8, num_samples=n_samples)
    w = windows.context_windows(frame(spark, rows), cfg, phases=("test",))
    return probabilistic.sample_paths(w, cfg), probabilistic.prediction_bands(probabilistic.sample_paths(w, cfg), 0.9)


def test_even_and_odd_sample_counts_lower_median(spark):
    for n in (2, 3, 4, 5):
        paths, bands = _bands_for(spark, n)
        p = paths.first()
        s = np.array(p.samples)
        assert s.shape[0] == n
        b = bands.filter(f"window_id = {p.window_id}").orderBy("step").collect()
        for step, r in enumerate(b):
            col = np.sort(s[:, step])
            assert r.median == col[(n - 1) // 2]
            assert abs(r.low - np.quantile(col, 0.05)) < 1e-12 and abs(r.high - np.quantile(col, 0.95)) < 1e-12
            if n != 2:
                assert r.low <= r.median <= r.high


def test_tune_blend_identical_models_picks_zero_weight(spark):
    rows = [("s", h(i), float(i), float(i) + 1, float(i) + 1) for i in range(10)]
    df = spark.createDataFrame(rows, "series_id STRING, ts TIMESTAMP_NTZ, y_true DOUBLE, pred_a DOUBLE, pred_b DOUBLE")
    got = align.tune_blend(df).first()
    assert got.weight == 0.0 and abs(got.rmse - 1.0) < 1e-12

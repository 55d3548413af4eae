import datetime as dt

import pandas as pd
import pytest
from conftest import SF001, frame
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tsengine.config import ForecastConfig
from tsengine.operators import align, clean, features, windows
from tsengine.sources import fixtures as fx


def _canon(df):
    pdf = df.toPandas()
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


@pytest.mark.parametrize("parts", ["1", "4", "16"])
def test_partition_invariance(spark, parts):
    cfg = ForecastConfig(max_lag=6, seasonal_anchors=(1, 24), rolling_candidates=(3, 6), context_length=48, prediction_length=6)

    def results():
        hourly = fx.events_hourly_by_type(spark, SF001)
        raw = fx.events_dirty(spark, SF001)
        return [
            _canon(features.build_features(hourly, cfg)),
            _canon(windows.context_windows(hourly, cfg).selectExpr("series_id", "window_id", "split", "aggregate(ctx, 0D, (a, x) -> a + x) AS s")),
            _canon(clean.clean_series(raw, cfg, value_cols=["value_raw"], time_raw="ts_raw", tie_break=["event_id"])),
        ]

    base = results()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        other = results()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for a, b in zip(base, other):
        pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12)


def _direct(series, C, H, S, t=0.2):
    n = len(series)
    cut = min(max(int(n * (1.0 - t)), C + H), n - 1)
    if cut < C + H or n - cut < H:
        return {}
    out = {("train", e): series[e - C : e] + series[e : e + H] for e in range(C, cut - H + 1, S)}
    out.update({("test", e): series[e - C : e] + series[e : e + H] for e in range(cut, n - H + 1, S)})
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 120), C=st.integers(1, 30), H=st.integers(1, 12), S=st.integers(1, 15))
def test_windows_property(spark, n, C, H, S):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=i), float(i * 3 % 17)) for i in range(n)]
    cfg = ForecastConfig(context_length=C, prediction_length=H, stride=S, on_short="skip")
    got = {(r.split, r.window_id): list(r.ctx) + [h.y for h in r.horizon] for r in windows.context_windows(frame(spark, rows), cfg).collect()}
    assert got == _direct([r[2] for r in rows], C, H, S)


def test_tuned_rmse_not_worse_than_either_model(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=i), float(i % 7), float(i % 5), float((i * 3) % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "series_id STRING, ts TIMESTAMP_NTZ, y_true DOUBLE, pred_a DOUBLE, pred_b DOUBLE")
    best = align.tune_blend(df).first().rmse
    ends = [align.tune_blend(df.selectExpr("series_id", "ts", "y_true", f"{c} AS pred_a", f"{c} AS pred_b")).first().rmse for c in ("pred_a", "pred_b")]
    assert best <= min(ends) + 1e-12


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    gaps=st.lists(st.integers(1, 180), min_size=1, max_size=40),
    mask=st.lists(st.booleans(), min_size=40, max_size=40),
    vals=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=40, max_size=40),
)
def test_interpolation_matches_pandas(spark, gaps, mask, vals):
    import numpy as np

    t0 = dt.datetime(2024, 1, 1)
    stamps, t = [], t0
    for g in gaps:
        t = t + dt.timedelta(minutes=g)
        stamps.append(t)
    ys = [None if m else v for m, v in zip(mask, vals)][: len(stamps)]
    got = clean.interpolate_time(frame(spark, [("a", s, y) for s, y in zip(stamps, ys)]), ["y"]).orderBy("ts").toPandas()["y"]
    exp = pd.Series(ys, index=pd.DatetimeIndex(stamps), dtype="float64").interpolate(method="time", limit_direction="both").ffill().bfill()
    np.testing.assert_allclose(got.to_numpy(dtype=float), exp.to_numpy(), rtol=1e-9, atol=1e-6, equal_nan=True)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=60), w=st.integers(3, 12), k=st.integers(1, 15))
def test_lag_rolling_match_pandas(spark, vals, w, k):
    import numpy as np

    t0 = dt.datetime(2024, 1, 1)
    df = frame(spark, [("a", t0 + dt.timedelta(hours=i), v) for i, v in enumerate(vals)])
    got = features.add_rolling(features.add_lags(df, [k]), [w]).orderBy("ts").toPandas()
    y = pd.Series(vals, dtype="float64")
    np.testing.assert_allclose(got[f"y_lag_{k}"].to_numpy(dtype=float), y.shift(k).to_numpy(), equal_nan=True)
    sh = y.shift(1).rolling(w, min_periods=w)
    np.testing.assert_allclose(got[f"y_roll_mean_{w}"].to_numpy(dtype=float), sh.mean().to_numpy(), equal_nan=True, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got[f"y_roll_std_{w}"].to_numpy(dtype=float), sh.std().to_numpy(), equal_nan=True, rtol=1e-6, atol=1e-6)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50), st.integers(-50, 50)), min_size=1, max_size=30),
    points=st.integers(1, 60),
    same=st.booleans(),
)
def test_blend_candidates_equal_full_grid_scan(spark, rows, points, same):
    import numpy as np

    data = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(y), float(p), float(p if same else q)) for i, (y, p, q) in enumerate(rows)]
    df = spark.createDataFrame(data, "series_id STRING, ts TIMESTAMP_NTZ, y_true DOUBLE, pred_a DOUBLE, pred_b DOUBLE")
    got = align.tune_blend(df, points=points).first()
    y, a, b = (np.array([r[k] for r in data]) for k in (2, 3, 4))
    e, d = y - b, a - b
    ee, ed, dd = np.mean(e * e), np.mean(e * d), np.mean(d * d)
    best = (float("inf"), 0.5)
    for w in align.weight_grid(points):
        r = float(np.sqrt(max(ee - 2 * w * ed + w * w * dd, 0.0)))
        best = min(best, (r, w))
    assert got.weight == best[1] and abs(got.rmse - best[0]) < 1e-12

import datetime as dt

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.operators import probabilistic, windows


def rows_for(n, sid="a"):
    t0 = dt.datetime(2024, 1, 1)
    return [(sid, t0 + dt.timedelta(minutes=30 * i), float((i * 7919) % 101)) for i in range(n)]


def direct(series, C, H, stride, test_size=0.2):
    """Windows cut by plain index slicing, anchored like the reproduced behaviour."""
    n = len(series)
    split = min(max(int(n * (1.0 - test_size)), C + H), n - 1)
    out = []
    for e in range(C, split - H + 1, stride):
        out.append(("train", e, series[e - C : e], series[e : e + H]))
    for e in range(split, n - H + 1, stride):
        out.append(("test", e, series[e - C : e], series[e : e + H]))
    return out


@pytest.mark.parametrize("C,H,S", [(24, 6, 6), (20, 6, 4), (10, 4, 7), (5, 8, 1)])
def test_windows_match_direct_slicing(spark, C, H, S):
    rows = rows_for(157) + rows_for(90, "b")
    cfg = ForecastConfig(context_length=C, prediction_length=H, stride=S)
    got = windows.context_windows(frame(spark, rows), cfg).collect()
    got = {(r.series_id, r.split, r.window_id): (list(r.ctx), [h.y for h in r.horizon]) for r in got}
    exp = {}
    for sid in ("a", "b"):
        ys = [r[2] for r in rows if r[0] == sid]
        for split, e, c, h in direct(ys, C, H, S):
            exp[(sid, split, e)] = (c, h)
    assert got == exp


def test_windows_block_layout_and_superblocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "SUPERBLOCK_BLOCKS", 8)
    rows = rows_for(400)
    cfg = ForecastConfig(context_length=30, prediction_length=6, layout="blocks")
    got = {(r.split, r.window_id): list(r.ctx) for r in windows.context_windows(frame(spark, rows), cfg).collect()}
    ys = [r[2] for r in rows]
    assert got == {(s, e): c for s, e, c, _ in direct(ys, 30, 6, 6)}


def test_short_series_skip_or_error(spark):
    df = frame(spark, rows_for(20))
    cfg = ForecastConfig(context_length=16, prediction_length=4)
    assert windows.context_windows(df, cfg.with_(on_short="skip")).count() == 0
    with pytest.raises(ValueError):
        windows.context_windows(df, cfg)
    status = windows.series_status(df.unionByName(frame(spark, rows_for(200)).withColumn("series_id", F.lit("long"))), cfg).collect()
    assert {r.series_id: r.status for r in status}["long"] == "ok" and {r.status for r in status} == {"ok", "too short for windows"}


def test_bands_lower_median_and_order(spark):
    rows = rows_for(300)
    cfg = ForecastConfig(context_length=200, prediction_length=6, season_length=8, num_samples=10)
    w = windows.context_windows(frame(spark, rows), cfg)
    paths = probabilistic.sample_paths(w, cfg)
    bands = probabilistic.prediction_bands(paths, 0.9)
    for r in bands.collect():
        assert r.low <= r.median <= r.high
    one = paths.first()
    s = np.array(one.samples)
    assert s.shape == (10, 6)
    col = np.sort(s[:, 0])
    b0 = [r for r in bands.collect() if r.window_id == one.window_id and r.step == 0][0]
    assert b0.median == col[(len(col) - 1) // 2]
    assert abs(b0.low - np.quantile(col, 0.05)) < 1e-9 and abs(b0.high - np.quantile(col, 0.95)) < 1e-9


def test_bootstrap_is_deterministic_and_plugin_runs(spark):
    cfg = ForecastConfig(context_length=100, prediction_length=5, season_length=10, num_samples=7)
    w = windows.context_windows(frame(spark, rows_for(200)), cfg)
    a = [r.samples for r in probabilistic.sample_paths(w, cfg, method="bootstrap").orderBy("window_id").collect()]
    b = [r.samples for r in probabilistic.sample_paths(w.repartition(3), cfg, method="bootstrap").orderBy("window_id").collect()]
    assert a == b and len(a[0]) == 7
    p = probabilistic.sample_paths(w, cfg, method="plugin", fn=probabilistic.seasonal_analog_plugin(10))
    q = probabilistic.sample_paths(w, cfg, method="analog")
    assert [r.samples for r in p.orderBy("window_id").collect()] == [r.samples for r in q.orderBy("window_id").collect()]
    with pytest.raises(ValueError):
        probabilistic.prediction_bands(p, 1.5)


def test_test_phase_only_equals_filtered(spark):
    rows = rows_for(157) + rows_for(90, "b")
    cfg = ForecastConfig(context_length=20, prediction_length=6, stride=4)
    both = windows.context_windows(frame(spark, rows), cfg).filter("split = 'test'")
    only = windows.context_windows(frame(spark, rows), cfg, phases=("test",))
    key = lambda r: (r.series_id, r.window_id)
    assert sorted(both.collect(), key=key) == sorted(only.collect(), key=key)
    with pytest.raises(ValueError):
        windows.context_windows(frame(spark, rows), cfg, phases=("later",))


def test_single_series_blocks_plan_has_no_single_partition(spark):
    from conftest import SF01

    from tsengine.sources import fixtures as fx

    cfg = ForecastConfig(layout="blocks")
    w = windows.context_windows(fx.events_30min(spark, SF01), cfg)
    w.count()
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    plain = windows.context_windows(fx.events_30min(spark, SF01), ForecastConfig(layout="series"))
    key = lambda r: (r.split, r.window_id)
    assert sorted(w.collect(), key=key) == sorted(plain.collect(), key=key)


def test_bootstrap_values_are_base_plus_a_seasonal_residual(spark):
    S = 10
    cfg = ForecastConfig(context_length=100, prediction_length=7, season_length=S, num_samples=9)
    w = windows.context_windows(frame(spark, rows_for(260)), cfg)
    for r in probabilistic.sample_paths(w, cfg, method="bootstrap").collect():
        ctx = np.array(r.ctx)
        L = len(ctx)
        residuals = {round(float(ctx[t] - ctx[t - S]), 9) for t in range(S, L)}
        for path in r.samples:
            for step, v in enumerate(path):
                assert round(v - float(ctx[L - S + step % S]), 9) in residuals

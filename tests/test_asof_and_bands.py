import datetime as dt
import random

import pandas as pd
import pytest
from conftest import frame
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.operators import asof, probabilistic

DAY = dt.datetime(2024, 1, 1)


def sides(spark, n=400, seed=1):
    r = random.Random(seed)
    stamp = lambda: DAY + dt.timedelta(minutes=r.randrange(3000))
    a = [(r.choice("xyz"), stamp(), float(i)) for i in range(n)]
    b = [(r.choice("xyw"), stamp(), float(i)) for i in range(n // 4)]
    return a, b, frame(spark, a), frame(spark, b, "series_id STRING, ts TIMESTAMP_NTZ, p DOUBLE")


def expected(a, b, minutes):
    out = []
    for s, t, y in a:
        near = [(u, p) for k, u, p in b if k == s and u <= t]
        u, p = max(near) if near else (None, None)
        if u is None or (minutes is not None and t - u > dt.timedelta(minutes=minutes)):
            u, p = None, None
        out.append((s, t, y, p, u))
    return sorted(out, key=str)


@pytest.mark.parametrize("layout", [None, "series", "blocks"])
@pytest.mark.parametrize("minutes", [None, 45, 0])
def test_asof_takes_the_last_earlier_row(spark, layout, minutes):
    a, b, fa, fb = sides(spark)
    cfg = ForecastConfig(layout=layout) if layout else None
    got = asof.align_asof(fa, fb, None if minutes is None else dt.timedelta(minutes=minutes), cfg=cfg)
    assert got.columns == ["series_id", "ts", "y", "p", "ts_b"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(a, b, minutes)
    inner = asof.align_asof(fa, fb, None if minutes is None else dt.timedelta(minutes=minutes), how="inner", cfg=cfg)
    assert inner.count() == sum(r[4] is not None for r in expected(a, b, minutes))


@pytest.mark.parametrize("layout", ["series", "blocks"])
def test_asof_nulls_ties_repeats_and_empty_sides(spark, layout):
    cfg = ForecastConfig(layout=layout)
    t = DAY
    a = [("x", t, 1.0), ("x", t, 1.0), (None, t, 2.0), ("x", None, 3.0), ("y", t, 4.0)]
    b = [("x", t, 5.0), ("x", t, 7.0), (None, t, 9.0), ("x", None, 9.0), ("y", t + dt.timedelta(seconds=1), 9.0)]
    fa, fb = frame(spark, a), frame(spark, b, "series_id STRING, ts TIMESTAMP_NTZ, p DOUBLE")
    got = sorted((tuple(r) for r in asof.align_asof(fa, fb, cfg=cfg).collect()), key=str)
    assert got == sorted([("x", t, 1.0, 7.0, t), ("x", t, 1.0, 7.0, t), (None, t, 2.0, None, None), ("x", None, 3.0, None, None), ("y", t, 4.0, None, None)], key=str)
    assert asof.align_asof(fa, fb.limit(0), cfg=cfg).filter("p IS NOT NULL").count() == 0
    assert asof.align_asof(fa.limit(0), fb, cfg=cfg).count() == 0
    with pytest.raises(ValueError):
        asof.align_asof(fa, fa, cfg=cfg)
    with pytest.raises(ValueError):
        asof.align_asof(fa, fb, how="outer")


def test_asof_in_blocks_splits_one_series_over_tasks(spark):
    a = [("x", DAY + dt.timedelta(seconds=i), float(i)) for i in range(4000)]
    b = [("x", DAY + dt.timedelta(seconds=i), float(i)) for i in (3, 2500)]  # most blocks have no row of b
    out = asof.align_asof(frame(spark, a), frame(spark, b, "series_id STRING, ts TIMESTAMP_NTZ, p DOUBLE"), cfg=ForecastConfig(layout="blocks"))
    got = {r.y: r.p for r in out.collect()}
    assert got == {float(i): (None if i < 3 else 3.0 if i < 2500 else 2500.0) for i in range(4000)}


def windows(spark, samples):
    rows = [("s", i, [(DAY + dt.timedelta(hours=h), float(h)) for h in range(3)], paths) for i, paths in enumerate(samples)]
    return spark.createDataFrame(rows, "series_id STRING, window_id LONG, horizon ARRAY<STRUCT<ts: TIMESTAMP_NTZ, y: DOUBLE>>, samples ARRAY<ARRAY<DOUBLE>>")


def test_long_bands_equal_the_array_form(spark):
    r = random.Random(2)
    samples = [[[r.choice([r.random(), 0.5]) for _ in range(3)] for _ in range(n)] for n in (1, 2, 3, 8, 31, 32)] + [[]]
    paths = windows(spark, samples)
    for confidence in (0.5, 0.9):
        keys = ["window_id", "step"]
        want = probabilistic.prediction_bands(paths, confidence).toPandas().sort_values(keys).reset_index(drop=True)
        rows = probabilistic.sample_rows(paths).repartition(5, "sample")
        got = probabilistic.prediction_bands_long(rows, confidence).toPandas().sort_values(keys).reset_index(drop=True)
        pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False, rtol=1e-12)


def test_sketches_merge_and_keep_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("part"), (F.xxhash64("id") % 100_000).cast("double").alias("value"))
    parts = probabilistic.band_sketches(rows, ["g", "part"], k=400)
    merged = probabilistic.bands_from_sketches(probabilistic.merge_sketches(parts, ["g"]), 0.8)
    values = rows.toPandas()
    for r in merged.collect():
        mine = values[values.g == r.g].value
        assert r.n == len(mine)
        for q, x in ((0.1, r.low), (0.5, r.median), (0.9, r.high)):
            assert abs((mine <= x).mean() - q) <= 2 * probabilistic.sketch_error(400)
    assert probabilistic.sketch_error(200) == pytest.approx(0.0133, abs=1e-4)


def test_sketches_of_groups_without_samples(spark):
    paths = windows(spark, [[], [[1.0, 2.0, 3.0]]])
    rows = probabilistic.sample_rows(paths)
    parts = probabilistic.band_sketches(rows)
    got = {(r.window_id, r.step): (r.n, r.median, r.low, r.high) for r in probabilistic.bands_from_sketches(parts).collect()}
    assert got == {(0, h): (0, None, None, None) for h in range(3)} | {(1, h): (1, h + 1.0, h + 1.0, h + 1.0) for h in range(3)}
    whole = probabilistic.bands_from_sketches(probabilistic.merge_sketches(parts.filter("window_id = 0"), ["window_id"])).collect()
    assert [(r.n, r.median) for r in whole] == [(0, None)]

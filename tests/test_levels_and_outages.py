import datetime as dt
import random

import pytest
from conftest import frame
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.operators import clean, metrics

DAY = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def test_hierarchy_equals_each_level_alone(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice(["x", "y", None]), r.gauss(5, 2), r.gauss(5, 2), r.choice([None, 1.0, 4.0])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g STRING, series_id STRING, y_true DOUBLE, p DOUBLE, q DOUBLE")
    levels = [["g", "series_id"], ["series_id"], [], ["g"]]
    got = metrics.metrics_hierarchy(df, ["p", "q"], levels, metrics=[*metrics.PREFERRED, "n"]).collect()
    for i, level in enumerate(levels):
        want = metrics.forecast_metrics(df, ["p", "q"], by=level, metrics=[*metrics.PREFERRED, "n"]).collect()
        key = lambda x, level=level: (*(str(x[c]) for c in level), x.model, x.metric)
        mine = sorted((x for x in got if x.level == i), key=key)
        want = sorted(want, key=key)
        assert [key(x) for x in mine] == [key(x) for x in want]
        assert [x.value for x in mine] == pytest.approx([x.value for x in want], rel=1e-9)
        assert all(x[c] is None for x in mine for c in ("g", "series_id") if c not in level)


def test_hierarchy_of_nothing_and_refusals(spark):
    df = spark.createDataFrame([], "g STRING, y_true DOUBLE, p DOUBLE")
    out = metrics.metrics_hierarchy(df, ["p"], [["g"], []], metrics=["mse", "n"]).collect()
    assert all(x.level == 1 for x in out)
    assert [x.value for x in metrics.metrics_hierarchy(df, ["p"], [[]], metrics=["n"]).collect()] == [0.0]
    for levels in ([], [["g"], ["g"]]):
        with pytest.raises(ValueError):
            metrics.metrics_hierarchy(df, ["p"], levels)


def test_hierarchy_is_one_shuffle(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0)], "g STRING, series_id STRING, y_true DOUBLE, p DOUBLE")
    plan = metrics.metrics_hierarchy(df, ["p"], [["g", "series_id"], ["g"], []])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Expand") == 1


def series(spark, n=300, seed=2):
    r = random.Random(seed)
    rows, t = [], DAY
    for i in range(n):
        t += HOUR * r.choice([1, 1, 1, 1, 2, 9])
        rows.append((r.choice("ab"), t, None if r.random() < 0.4 else float(i)))
    return rows, frame(spark, rows)


def outages(rows, hours):
    """Plain version: known neighbours further apart than the limit leave a row empty."""
    out = {}
    for s in {s for s, *_ in rows}:
        mine = sorted((t, y) for k, t, y in rows if k == s and t is not None)
        mine = [(t, y) for t, y in mine]
        known = [(t, y) for t, y in mine if y is not None]
        for t, y in mine:
            before, after = [k for k in known if k[0] <= t], [k for k in known if k[0] >= t]
            if y is None and before and after:
                (pt, pv), (nt, nv) = before[-1], after[0]
                y = pv + (nv - pv) * ((t - pt) / (nt - pt)) if nt - pt <= HOUR * hours else None
            elif y is None and before:
                y = before[-1][1] if t - before[-1][0] <= HOUR * hours else None
            elif y is None and after:
                y = after[0][1] if after[0][0] - t <= HOUR * hours else None
            out[s, t] = y
    return out


@pytest.mark.parametrize("layout", ["series", "blocks"])
@pytest.mark.parametrize("hours", [1, 3, 1000])
def test_interpolation_does_not_bridge_outages(spark, layout, hours):
    rows, df = series(spark)
    got = clean.interpolate_time(df, ["y"], max_gap=HOUR * hours, cfg=ForecastConfig(layout=layout))
    want = outages(rows, hours)
    mine = {(r.series_id, r.ts): r.y for r in got.collect()}
    assert mine.keys() == want.keys()
    for k, y in want.items():
        assert mine[k] == (None if y is None else pytest.approx(y))


@pytest.mark.parametrize("layout", ["series", "blocks"])
def test_segments_are_numbered_over_block_edges(spark, layout):
    rows, _ = series(spark, n=2000, seed=3)
    rows += rows[:20] + [("a", None, 1.0), (None, DAY, 1.0), (None, DAY + 5 * HOUR, 1.0)]  # repeats, no stamp, no series
    got = clean.outage_segments(frame(spark, rows), HOUR * 2, cfg=ForecastConfig(layout=layout)).collect()
    assert len(got) == len(rows)
    want = {}
    for s in {s for s, *_ in rows}:
        last, segment = None, 0
        for t in sorted(t for k, t, _ in rows if k == s and t is not None):
            segment += last is not None and t - last > HOUR * 2
            want[s, t], last = segment, t
    assert all(r.segment == want.get((r.series_id, r.ts)) for r in got)
    assert max(want.values()) > 100
    assert clean.outage_segments(frame(spark, rows).limit(0), HOUR, cfg=ForecastConfig(layout=layout)).count() == 0

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.llm import hard_negatives as hn

SCHEMA = "vec_id LONG, label INT, embedding ARRAY<FLOAT>, rank STRING, size STRING, VECTOR STRING"


def brute(rows, positives=5, negatives=5):
    own = []
    for vec_id, label, x, *_ in rows:
        if vec_id is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        row = (vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(c)))) for c in x))
        if row not in own:
            own.append(row)
    out = []
    for a, label, x in own:
        if a % 100:
            continue
        score = [(-sum(p * q for p, q in zip(x, y, strict=True)), b, other) for b, other, y in own if b != a and len(x) == len(y)]
        for s, p, _ in sorted(r for r in score if r[2] == label)[:positives]:
            window = sorted(r for r in score if r[2] != label and -80 * s <= -100 * r[0] <= -100 * s)
            out += [(a, p, rank, b, -s, -t) for rank, (t, b, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def table(seed, n=900, size=12, near=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, size))
    rows = []
    for i in range(n):
        x = centres[int(r.integers(4))] + near * r.normal(size=size)
        rows.append((i, int(r.integers(0, 4)), (x / np.linalg.norm(x)).astype(np.float32).tolist(), "x", "y", "z"))
    return rows


@pytest.fixture()
def tiny(monkeypatch):
    """Many blocks, chunks and passes from little data."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", 70)
    monkeypatch.setattr(hn, "GROUP_BYTES", 400)
    monkeypatch.setattr(hn, "GROUP_CHUNKS", 2)


def test_equals_brute_force(small):
    rows = table(1)
    want = brute(rows)
    assert len(want) > 100 and got(hn.digest(small(rows, SCHEMA))) == want


def test_blocks_and_passes_do_not_matter(small, tiny):
    rows = table(2)
    assert got(hn.digest(small(rows, SCHEMA).repartition(5))) == brute(rows)


def test_nulls_ties_repeated_rows_lengths_and_one_hot_label(small):
    r = random.Random(3)
    x = [0.5, 0.25, -0.125, 0.75]
    rows = [(i, 3 if i % 3 else r.randrange(3), x if i % 2 else [c + r.choice([0, 0.01]) for c in x], "x", "y", "z") for i in range(400)]
    rows += rows[:50]  # repeated rows
    rows += [(100, 3, [0.1, 0.9, 0.4, 0.2], "x", "y", "z")]  # another row of an anchor's id
    rows += [(None, 3, x, "x", "y", "z"), (401, None, x, "x", "y", "z"), (402, 3, None, "x", "y", "z"), (403, 3, [0.5, None, 0.1, 0.1], "x", "y", "z")]
    rows += [(404, 2, [0.5, float("nan"), 0.1, 0.1], "x", "y", "z"), (500, 2, [float("inf"), 0.1, 0.1, 0.1], "x", "y", "z")]
    rows += [(i, i % 3, [1.0, 0.5 + i / 1000], "x", "y", "z") for i in range(600, 640)]  # another length
    rows += [(i, i % 3, [], "x", "y", "z") for i in range(700, 720)]  # no components: all scores are 0
    assert got(hn.digest(small(rows, SCHEMA))) == brute(rows)


def test_negative_scores_have_empty_windows(small):
    rows = [(0, 1, [1.0, 0.0], "x", "y", "z"), (1, 2, [-1.0, 0.0], "x", "y", "z"), (2, 2, [-0.9, 0.0], "x", "y", "z"), (3, 3, [-0.95, 0.0], "x", "y", "z")]
    assert got(hn.digest(small(rows, SCHEMA))) == brute(rows) == []


def test_empty_table(small):
    assert got(hn.digest(small([], SCHEMA))) == []


def test_large_integers_are_exact_or_refused(small):
    r = np.random.default_rng(5)
    rows = [(i, i % 2, r.integers(-(1 << 29), 1 << 29, 3).tolist()) for i in range(300)]
    df = small(rows, "vec_id LONG, label INT, vector ARRAY<LONG>")
    rows = [(v, x, [c / 256 for c in y]) for v, x, y in rows]
    want = []
    for a, label, x in rows:
        if a % 100 == 0:
            x = [round(256 * c) for c in x]
            score = sorted((-sum(p * round(256 * q) for p, q in zip(x, y, strict=True)), b, o) for b, o, y in rows if b != a)
            for s, p, _ in [q for q in score if q[2] == label][:5]:
                inside = [(t, b) for t, b, o in score if o != label and -80 * s <= -100 * t <= -100 * s]
                want += [(a, p, n, b, -s, -t) for n, (t, b) in enumerate(inside[:5], 1)]
    assert got(hn.mine(df, F.col("vec_id") % 100 == 0)) == sorted(want)
    with pytest.raises(ValueError, match="64 bits"):
        hn.mine(small([(0, 1, [1 << 40])], "vec_id LONG, label INT, vector ARRAY<LONG>"), F.lit(True))


def test_bounds_prune_before_all_dimensions_are_read():
    r = np.random.default_rng(6)
    columns = r.normal(size=(64, 500)) * 0.01
    columns[:, :5] += 1
    anchor, read = np.sort(np.abs(r.normal(size=64))) + 0.1, []

    def keep(least, most):
        read.append(len(least))
        return most >= (hn.kth(least, 3) if len(least) >= 3 else -np.inf)

    at, score = hn.bond(columns, columns.min(axis=1), columns.max(axis=1), anchor, np.ones(500, bool), keep)
    assert set(np.argsort(-(anchor @ columns))[:3]) <= set(at.tolist())
    assert np.allclose(score, (anchor @ columns)[at]) and read[-1] < read[0]

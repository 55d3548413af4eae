import math
import time

import numpy as np
import pytest

from tsengine.llm import embedding_dedup

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>"


def brute(rows, cosine=0.95):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.asarray(v, np.float32).astype(float)
    ids = sorted(good)
    near = {a: [b for b in ids if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine * np.linalg.norm(good[a]) * np.linalg.norm(good[b])] for a in ids}
    component = {}
    for a in ids:
        if a not in component:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in component:
                    component[x] = a
                    todo += near[x]
    return sorted(((i, len(near.get(i, [])), component.get(i, i), i is not None and component.get(i, i) == i) for i, _ in rows), key=str)


def vectors(seed, n=300, size=32):
    r = np.random.default_rng(seed)
    rows, at = [], 0
    while len(rows) < n:
        v = r.normal(size=size)
        for _ in range(int(r.choice([1, 1, 2, 5, 40]))):
            rows.append((at * 7 % 1013, (v + r.normal(size=size) * r.choice([0.0, 0.05, 0.12])).tolist()))
            at += 1
    return rows


def run(small, rows):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(small(rows, SCHEMA)).collect()), key=str)


def test_recall_and_precision(small, monkeypatch):
    rows = vectors(1, size=64)
    for block in (512, 16):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got, expected = run(small, rows), brute(rows)
        found, there = sum(r[1] for r in got), sum(r[1] for r in expected)
        assert found >= 0.98 * there > 1000
        assert all(g[1] <= e[1] for g, e in zip(got, expected, strict=True))


@pytest.mark.parametrize("size", [32, 64, 384, 768, 1500])
def test_recall_by_length(small, size):
    r = np.random.default_rng(size)
    rows = []
    for _ in range(60):
        v = r.normal(size=size)
        rows += [(len(rows) + i, (v + r.normal(size=size) * x).tolist()) for i, x in enumerate(r.uniform(0.0, 0.3, 8))]
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    got, expected = run(small, rows), brute(rows)
    found, there = sum(x[1] for x in got), sum(x[1] for x in expected)
    assert there > 300 and found >= 0.95 * there, (found, there)
    assert all(g[1] <= e[1] for g, e in zip(got, expected, strict=True))


def test_equal_vectors_are_one_class(small):
    r = np.random.default_rng(3)
    v = r.normal(size=16)
    near, far = (v + 0.01 * r.normal(size=16)).tolist(), r.normal(size=16).tolist()
    rows = small([(0, v.tolist())], SCHEMA).selectExpr("explode(sequence(1, 20000)) AS i", "embedding").selectExpr("CAST(i AS LONG) AS vec_id", "embedding")
    rows = rows.unionByName(small([(50_000, near), (50_001, near), (60_000, far)], SCHEMA))
    begin = time.time()
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_duplicates(rows).collect()}
    assert time.time() - begin < 180 and len(got) == 20_003
    assert got[7] == (20_001, 1, False) and got[1] == (20_001, 1, True) and got[50_001] == (20_001, 1, False) and got[60_000] == (0, 60_000, True)


def test_one_stray_long_vector_and_many_lengths(small):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=n).tolist()) for i, n in enumerate([1, 2, 3, 5, 17, 64, 70, 100_000])]
    rows += [(100 + i, v) for i, v in rows]
    assert run(small, rows) == brute(rows)


def test_a_cosine_that_the_tables_cannot_serve_is_refused(small):
    assert embedding_dedup.needed_radius(0.95) < embedding_dedup.RADIUS + 0.5 < embedding_dedup.needed_radius(0.93)
    with pytest.raises(ValueError):
        embedding_dedup.near_duplicates(small([], SCHEMA), cosine=0.8)


def test_edges(small):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (3, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 3.0]), (8, [1.0, float("nan"), 3.0]), (9, [1.0, float("inf"), 3.0]), (None, v), (10, [*v, 0.0]), (11, [*v, 0.0]), (2, v), (12, [1e30, 2e30, 3e30]), (13, [1e-30, 2e-30, 3e-30])]
    assert run(small, rows) == brute(rows)
    assert run(small, []) == []

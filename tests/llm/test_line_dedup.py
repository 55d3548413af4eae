import hashlib
import random
from collections import Counter

import numpy as np

from tsengine.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_docs, min_chars=1):
    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= max(min_chars, 1) and found[key(x)] >= min_docs)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(small, rows, **options):
    out = line_dedup.dedup_lines(small(rows, "doc_id LONG, text STRING"), **options).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out), key=str)


def corpus(seed):
    r = random.Random(seed)
    lines = [r.choice(["", " ", "A", "ä", "Zz"]) + f"line {i}" + r.choice(["", "\t", "\r"]) for i in range(300)]
    rows = [(d, "\n".join(r.choice([str.upper, str.lower, str])(r.choice(lines)) for _ in range(r.randrange(1, 30)))) for d in range(120)]
    return rows + [(500, None), (501, ""), (502, "\n\n"), (None, "line 1"), (3, rows[3][1]), (3, rows[3][1]), (503, "x\n" * 50_000), (504, "É\né"), (505, " line 1")]


def test_equals_brute_force(small):
    rows = corpus(3)
    for options in ({"min_docs": 2}, {"min_docs": 5, "min_chars": 7}):
        expected = brute(rows, **options)
        assert sum(x[2] for x in expected) > 50
        assert run(small, rows, **options) == expected


def test_shards_in_groups(small, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    rows = corpus(4)
    assert run(small, rows, min_docs=3, group_bytes=1000) == brute(rows, 3)


def test_empty_and_other_columns(small):
    assert line_dedup.dedup_lines(small([], "doc_id LONG, text STRING")).count() == 0
    rows = [(i, "same\nown", f"n{i}", i) for i in range(12)]
    out = line_dedup.dedup_lines(small(rows, "doc_id LONG, text STRING, n_lines STRING, h1 INT")).collect()
    assert {(r.text, r.n_lines, r.n_dropped) for r in out} == {("", 2, 2)} and sorted(r.h1 for r in out) == list(range(12))


def test_perfect_hash_is_minimal_and_tells_strangers():
    r = np.random.default_rng(0)
    h = r.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    h[:50, 0] = h[50:100, 0]  # equal halves
    n = np.arange(3000) + 10
    seeds, prints, counts = line_dedup.build_shard(h, n)
    row = type("R", (), {"shard": 0, "n": len(h), "seeds": seeds.tobytes(), "prints": prints.tobytes(), "counts": counts.tobytes()})
    probe = line_dedup.Probe([row], 1)
    assert probe.count(h).tolist() == n.tolist()
    assert not probe.count(r.integers(0, 1 << 63, (100_000, 2)).astype(np.uint64)).any()

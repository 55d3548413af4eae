import hashlib
import random
import re

from tsengine.llm import substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, words):
    """Straight from the definition, over (doc_id, text)."""
    seen = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - words + 1):
                k = tuple(w[i : i + words])
                seen[k] = min(seen.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - words + 1):
                if seen[tuple(w[i : i + words])] < d:
                    gone.update(range(i, i + words))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60, vocabulary=30, longest=200):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "é", "longer", "x y"]) + str(r.randrange(vocabulary))
    passages = [[word() for _ in range(r.randrange(5, 90))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = []
        while len(w) < r.randrange(1, longest):
            w += r.choice(passages)[r.randrange(3) :] if r.random() < 0.5 else [word() for _ in range(r.randrange(1, 40))]
        rows.append((d * 7 % 61, r.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 30, 3)]  # whole copies
    return rows


def run(small, rows, words):
    df = substring_dedup.dedup_substrings(small(rows, "doc_id LONG, text STRING"), words, bits=1 << 20)
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect()), key=str)


def test_equals_brute_force(small):
    for seed, words in ((1, 50), (2, 11)):
        rows = corpus(seed)
        expected = brute(rows, words)
        assert sum(x[2] for x in expected) > 100
        assert run(small, rows, words) == expected


def test_edges(small):
    long = " ".join(f"w{i}" for i in range(5000))
    same = "a " * 300
    rows = [(1, None), (2, ""), (3, "  \n"), (None, long), (None, long), (5, long), (4, long), (4, long), (9, same), (8, same), (7, "a " * 49), (6, "b" * 100_000)]
    assert run(small, rows, 50) == brute(rows, 50)
    assert substring_dedup.dedup_substrings(small([], "doc_id LONG, text STRING")).count() == 0


def test_other_columns_pass(small):
    rows = [(1, "a " * 60, "x", 5.0), (2, "a " * 60, None, None)]
    out = substring_dedup.dedup_substrings(small(rows, "doc_id LONG, text STRING, n_words STRING, extra DOUBLE"), bits=1 << 16)
    assert sorted(out.columns) == ["doc_id", "extra", "n_removed", "n_words", "text"]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.extra) for r in out.collect()) == [(1, 60, 0, 5.0), (2, 60, 60, None)]


def test_doubling_ends_when_no_candidates_survive(small):
    w = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(w)), (2, "x " + " ".join(w[:45]) + " y"), (3, " ".join(w[50:75])), (4, " ".join(w)), (5, "none of them")]
    got = {r.doc_id: r.longest for r in substring_dedup.longest_repeats(small(rows, "doc_id LONG, text STRING"), 10, bits=1 << 16).collect()}
    assert got == {2: 40, 3: 20, 4: 160}


def test_levels_read_survivors_only(small):
    w = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(w)), (2, "x " + " ".join(w[:45]) + " y"), (3, " ".join(w[50:75])), (4, " ".join(w))]
    rows += [(10 + i, " ".join(f"{i}-{k}" for k in range(300))) for i in range(40)]  # shared by nobody
    read = [(words, docs.count()) for words, docs, _ in substring_dedup.levels(small(rows, "doc_id LONG, text STRING"), 10, bits=1 << 20)]
    assert read == [(10, 44), (20, 4), (40, 4), (80, 3), (160, 2), (320, 2)]


def test_repeated_rows_are_linear(small):
    import time

    text = " ".join(f"w{i}" for i in range(62))
    begin = time.time()
    got = run(small, [(1, text)] + [(2, text)] * 20_000 + [(3, text[5:])] * 50, 50)
    assert time.time() - begin < 180
    assert [x[2] for x in got] == [0] + [62] * 20_000 + [got[-1][2]] * 50 and got[-1][2] > 50

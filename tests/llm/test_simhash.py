import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from tsengine.llm import groups, simhash


def brute(rows):
    prints = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            members[find(i)].append(d)
    return sorted(((d, f"{p:016x}", min(members[find(i)], default=None)) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["Ab", "é", "THE", "x"]) + str(r.randrange(40))
    rows = []
    for d in range(150):
        w = [word() for _ in range(r.randrange(0, 200))]
        for _ in range(r.randrange(1, 6)):
            rows.append((len(rows) * 13 % 1009, " ".join(w)))
            for _ in range(r.randrange(0, 4)):
                if w:
                    w[r.randrange(len(w))] = word()
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (None, rows[0][1]), (None, "alone here now"), (rows[5][0], rows[5][1]), (2003, "One"), (2004, "one  "), (2005, "a b " * 30_000)]


def test_equals_brute_force(small, monkeypatch):
    rows = corpus(5)
    for block in (512, 4):  # small blocks: groups are cut and met across blocks
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = simhash.digest(small(rows, "doc_id LONG, text STRING").withColumn("component_id", __import__("pyspark").sql.functions.lit(1)))
        assert sorted(((x.doc_id, x.fingerprint, x.component_id) for x in got.collect()), key=str) == brute(rows)


def test_chains_find_all_pairs_within_three_bits():
    r = random.Random(1)
    for _ in range(400):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randrange(0, 5)):
            b ^= 1 << bit
        x, y = np.asarray([a], np.uint64), np.asarray([b], np.uint64)
        found = []
        for i in range(4):
            for half in range(2):
                key = lambda v: ((v >> 16 * i) & 0xFFFF, (v >> ((i + 1) % 4 * 16 + 8 * half)) & 0xFF)
                found.append(key(a) == key(b) and bool(simhash.chain_links(x, y, i, 3)[0, 0]))
        assert any(found) == ((a ^ b).bit_count() <= 3)


def test_dedup_keeps_one_of_each_component(small):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text, "c"), (2, text, "b"), (9, "something else entirely", "d"), (2, text, "b"), (None, text, "n"), (4, None, None), (5, "", None)]
    out = simhash.dedup(small(rows, "doc_id LONG, text STRING, first STRING")).collect()
    assert sorted(str(x.doc_id) for x in out) == ["2", "4", "9", "None"]


def test_dedup_judges_each_text_of_a_shared_number(small):
    text, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = [(5, other, "x"), (5, text, "y"), (2, text, "z"), (5, other, "a"), (7, other, "b")]
    out = simhash.dedup(small(rows, "doc_id LONG, text STRING, first STRING")).collect()
    again = simhash.dedup(small(rows[::-1], "doc_id LONG, text STRING, first STRING").repartition(3)).collect()
    assert sorted((x.doc_id, x.text) for x in out) == [(2, text), (5, other)]
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))  # of equal rows the same one, however they lie


def test_empty(small):
    assert simhash.digest(small([], "doc_id LONG, text STRING")).count() == 0


def test_components_of_paths_and_hubs(small):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7000, 6999)]
    got = {r.node: r.component for r in groups.connected_components(small(edges, "a LONG, b LONG")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)} | {7000: 6999}

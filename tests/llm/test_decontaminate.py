import hashlib
import random
import re

from pyspark.sql import functions as F

from tsengine.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    grams = []
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        grams += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for item, g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found.add(item)
        found.discard(None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["A", "b", "É", "zz", "9"]) + str(r.randrange(12))
    items = [(i, r.choice([" ", ", ", "-"]).join(word() for _ in range(r.choice([1, 2, 3, 7, 10, 11, 30, 60])))) for i in range(40)]
    rows = []
    for d in range(150):
        w = [word() for _ in range(r.randrange(0, 60))]
        if r.random() < 0.6:
            x = words(r.choice(items)[1])
            a = r.randrange(len(x))
            w[len(w) // 2 : len(w) // 2] = x[a : a + r.randrange(1, 40)] * r.choice([1, 1, 3])
        rows.append((d, r.choice([" ", "; ", "\n"]).join(w)))
    items += [(100, None), (101, ""), (102, "!!!"), (7, items[8][1]), (None, "none of these ids"), (103, items[3][1].upper())]
    return rows + [(500, None), (501, ""), (None, rows[3][1]), (3, rows[3][1]), (3, "other text"), (502, items[6][1] * 3000), (503, "none of these ids")], items


def run(small, rows, items):
    docs = small(rows, "doc_id LONG, text STRING").withColumn("n_words", F.lit("x"))
    return sorted((tuple(r) for r in decontaminate.digest(docs, small(items, "item_id LONG, text STRING")).collect()), key=str)


def test_equals_brute_force(small):
    rows, items = corpus(1)
    expected = brute(rows, items)
    assert sum(x[5] for x in expected) > 20
    assert run(small, rows, items) == expected


def test_empty_tables(small):
    rows, items = corpus(2)
    assert run(small, [], items) == []
    assert run(small, rows[:20], []) == brute(rows[:20], [])


def test_repeated_items_and_windows(small):
    head = "one two three four five six seven eight nine ten"
    items = [(1, head + " a b"), (1, head + " a b"), (2, "red green blue"), (2, "Red, green, blue"), (3, head + " c"), (3, head + " d"), (None, "no id at all"), (None, "no id at all"), (4, "once only here")]
    rows = [(1, "x " + head + " y"), (2, "red green blue"), (3, "two three four five six seven eight nine ten c"), (4, "so no id at all"), (5, "once only here"), (6, "clean")]
    assert [x[5] for x in brute(rows, items)] == [True, True, True, True, True, False]
    assert run(small, rows, items) == brute(rows, items)
    out = decontaminate.decontaminate(small(rows, "doc_id LONG, text STRING"), small(items, "item_id LONG, text STRING"))
    assert [r.doc_id for r in out.collect()] == [6]


def test_clean_documents_stay(small):
    item = [(1, "one two three four five six seven eight nine ten eleven twelve")]
    rows = [(1, "x One two, three four five six seven eight nine ten y", "a"), (2, "one two three four five", "b"), (2, "one two three four five", "b"), (3, None, None), (None, "eleven", "c")]
    out = decontaminate.decontaminate(small(rows, "doc_id LONG, text STRING, h STRING"), small(item, "item_id LONG, text STRING")).collect()
    assert sorted(str(r.doc_id) for r in out) == ["2", "2", "3", "None"]

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tsengine.llm import toxicity as x

SF01 = "/root/testdata/sf0.1"


def use(text, forms):
    found, matched, clauses = x.matches(x.Lexicon(forms).symbols(text), x.machine())
    return dict(found), matched, clauses


def test_clauses_not_words():
    forms = {"idiot": "insult", "kill": "threat"}
    assert use("You are an idiot. He is no idiot; she said he was an idiot!", forms) == ({("idiot", "aimed"): 1, ("idiot", "negated"): 1, ("idiot", "reported"): 1}, 3, 4)
    assert use("I will kill it", forms)[0] == {("kill", "plain"): 1}
    assert use("kill you", forms)[0] == {("kill", "aimed"): 1}
    assert use("they kill time", forms)[0] == {} and use("never will kill", forms)[0] == {("kill", "negated"): 1}
    assert use("Idiotisch, IDIOTEN", forms)[0] == {("idiot", "plain"): 1}
    assert use("not. idiot", forms)[0] == {("idiot", "plain"): 1}
    assert use("", forms) == ({}, 0, 1)


def test_reported_speech_and_negation():
    forms = {"idiot": "insult", "kill": "threat", "ass": "insult"}
    for text in ('she said: "you idiot"', "she said: you idiot", 'she said "fine. you idiot. really"', "he called you an idiot", "they wrote “you idiot”", 'he said "you will kill him"'):
        assert {u for _, u in use(text, forms)[0]} == {"reported"}, text
    for text in ('she said: fine. you idiot', 'she said "fine" and you idiot', "she said it\nyou idiot", '"you idiot"'):
        assert use(text, forms)[0] == {("idiot", "aimed"): 1}, text
    for text in ("you won't be an idiot", "you don’t look like an idiot", "you cannot be idiot", "du bist kein idiot", "tu n'es pas idiot", "you werent an idiot", "never an idiot"):
        assert {u for _, u in use(text, forms)[0]} == {"negated"}, text
    assert use("passing class, you ass", forms)[0] == {("ass", "aimed"): 1}  # short forms are whole words


def enumerated(symbols):
    """Uses of a text's insults and threats, straight from the rules."""
    out, clauses, here = set(), [], []
    for i, s in enumerate(symbols):
        here.append(i)
        if s in ("break", "line", "colon", "quote"):
            clauses.append(here)
            here = []
    clauses.append(here)
    found = []
    for clause in clauses:
        got = set()
        inside = [i for i in clause if symbols[i] not in ("break", "line", "colon", "quote")]
        for i in inside:
            before = [symbols[j] for j in inside if j < i]
            mark = "negated" if "negation" in before[-5:] else "reported" if told(symbols, i) else ""
            use = mark or ("aimed" if "target" in before[-6:] else "plain")
            if symbols[i] == "insult":
                got.add((i, use))
            if symbols[i] == "threat":
                back = before[-3:][::-1]
                near = back.index("modal") if "modal" in back else None
                if near is not None and "threat" not in back[:near]:
                    got.add((i, use))
                    continue
                after = [symbols[j] for j in inside if j > i][:3]
                near = after.index("target") if "target" in after else None
                if near is not None and not {"threat", "modal"} & set(after[:near]):
                    got.add((i, mark or "aimed"))
        found += sorted(got)
    return found


def told(symbols, at):
    """Is the symbol in reported speech?"""
    line = max([j for j in range(at) if symbols[j] == "line"], default=-1)
    quoted, level = False, 0
    for j in range(line + 1, at):
        s = symbols[j]
        if s == "quote":
            quoted, level = not quoted, 0 if quoted else (3 if level else 0)
        elif s == "break" and level != 3:
            level = 0
        elif s == "colon" and level == 1:
            level = 2
        elif s == "report":
            level = max(level, 1)
    return level > 0


def test_machine_equals_enumeration():
    r = random.Random(6)
    kinds = ["insult", "threat", "modal", "target", "negation", "report", "other", "break", "line", "colon", "quote"]
    weights = [3, 3, 2, 3, 2, 2, 5, 1, 0.4, 0.7, 0.9]
    run = x.machine()
    for _ in range(6000):
        symbols = r.choices(kinds, weights, k=r.randrange(1, 16))
        named = [(s, str(i)) if s in ("insult", "threat") else (s, "") for i, s in enumerate(symbols)]
        want = Counter((str(i), u) for i, u in enumerated(symbols))
        assert x.matches(named, run)[0] == want, symbols


def test_composition_reaches_few_states():
    run, r = x.machine(), random.Random(1)
    symbols = ["insult", "threat", "modal", "target", "negation", "report", "other", "break", "line", "colon", "quote"]
    state = run.start
    for _ in range(50_000):
        state, _ = run.step(state, r.choice(symbols))
    assert len(run.table) < 60_000


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, x.fit(docs, labels)


def test_held_out_accuracy(learned):
    docs, labels, grammar = learned
    rows = x.score_documents(docs.select("doc_id", "text"), grammar).filter(x.held_out()).join(labels, "doc_id").select("doc_id", "score", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(not r.toxic for r in rows)
    assert right > 0.97 and caught > 0.85 and wrong < 0.01


def test_held_out_labels_are_not_used(learned):
    docs, labels, grammar = learned
    other = labels.withColumn("toxic", F.when(x.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = x.fit(docs, other)
    assert (again.weights, again.factors) == (grammar.weights, grammar.factors)


def test_edges(small):
    labels = small([(i, i % 2, None) for i in range(40)] + [(1, None, 1), (None, 1, 0), (3, 1, 1)], "doc_id LONG, toxic INT, quality INT")
    rows = [(i, "you idiot, you moron" if i % 2 else "a kind word", "x") for i in range(40)] + [(100, None, None), (101, "", "y"), (None, "idiot", "z"), (1, "you idiot", "x"), (102, "fine " * 100_000, None)]
    docs = small(rows, "doc_id LONG, text STRING, score STRING")
    out = x.digest(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in out)
    assert {r.predicted for r in out if r.doc_id in (1, 3, 5)} == {1} and {r.predicted for r in out if r.doc_id in (2, 100, 101, 102)} == {0}
    assert x.digest(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.predicted for r in x.digest(docs, labels.limit(0)).collect()} == {0, 1}  # the seeds alone

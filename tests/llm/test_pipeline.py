"""The pipeline against plain Python versions of its stages, over a small fixture."""

import os
import random

import corpus_pipeline
from tsengine.llm import toxicity

from . import test_decontaminate, test_line_dedup, test_packing, test_simhash


def fixture():
    r = random.Random(4)
    word = lambda: r.choice(["stone", "river", "Hill", "é"]) + str(r.randrange(300))
    item = " ".join(word() for _ in range(25))
    rows = []
    for d in range(120):
        text = "\n".join(" ".join(word() for _ in range(r.randrange(3, 40))) for _ in range(r.randrange(1, 6)))
        if d % 10 < 3:
            text += "\nAll rights reserved."
        if d % 9 == 0:
            text = "You idiot, you worthless moron. " + text
        if d % 17 == 0:
            text += "\nas in " + item + " it said"
        rows.append((d, text, "en", "s", len(text)))
    rows += [(200 + d, rows[d][1] + " x", "en", "s", 1) for d in range(1, 20)] + [(300, rows[5][1], None, None, None), (301, None, None, None, None), (302, "", "en", "s", 0), (None, "no id", "en", "s", 5)]
    labels = [(d, 1, int(d % 9 == 0)) for d in range(120)]
    return rows, labels, [(1, item), (2, "too short")]


def test_stages_equal_plain_versions(spark, tmp_path):
    rows, labels, items = fixture()
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(os.path.join(sf, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(os.path.join(sf, "labels.parquet"))
    spark.createDataFrame(items, "item_id LONG, text STRING").write.parquet(os.path.join(sf, "benchmark.parquet"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    at = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if i < 4:
            assert docs.columns == names
            docs.write.parquet(f"{sf}/{name}")
            docs = spark.read.parquet(f"{sf}/{name}")
        at[name] = docs.collect()
    texts = lambda name: sorted(((r.doc_id, r.text) for r in at[name]), key=str)

    grammar = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    lexicon = toxicity.Lexicon({f: k for f, (k, _) in grammar.weights.items()})
    clean = [(d, t) for d, t, *_ in rows if toxicity.score(toxicity.signs(*toxicity.matches(lexicon.symbols(t or ""), toxicity.machine()), grammar), grammar) < 0.5]
    assert texts("toxicity") == sorted(clean, key=str)
    assert {d for d, t in clean if t and "idiot" in t} == set() and len(clean) > 100

    found = {}
    for _, t in clean:
        for k in {test_line_dedup.key(x) for x in (t or "").split("\n")}:
            found[k] = found.get(k, 0) + 1
    lines = [(d, "\n".join(x for x in (t or "").split("\n") if not test_line_dedup.key(x) or found[test_line_dedup.key(x)] < 10)) for d, t in clean]
    assert texts("line_dedup") == sorted(lines, key=str) and lines != clean
    assert all(r.n_chars == len(r.text) for r in at["line_dedup"])

    firsts = {d for d, _, c in test_simhash.brute(lines) if d == c}
    kept = [(d, t) for d, t in lines if d is None or d in firsts]
    assert texts("simhash_near_dedup") == sorted(kept, key=str) and len(kept) < len(lines)

    pure = [(d, t) for (d, t) in kept if not test_decontaminate.brute([(d, t)], items)[0][5]]
    assert texts("benchmark_decontamination") == sorted(pure, key=str) and len(pure) < len(kept)

    ids = {d: len(test_packing.tokens(t)) + 1 for d, t in pure}
    total = {}
    for r in at["packing"]:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == ids
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()), key=str) == sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in at["packing"]), key=str)


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls everywhere, repeated rows, ties and columns that clash with the stages' own."""
    sf = str(tmp_path)
    extra = "doc_id LONG, text STRING, score STRING, predicted INT, n_lines STRING, n_dropped INT, component_id LONG, fingerprint STRING, __key INT, length INT, N INT"
    item = " ".join(f"i{k}" for k in range(12))
    rows = [(1, "kind words of one", "s", 9, "l", 9, 9, "f", 9, 9, 9)] * 3 + [(2, None, None, None, None, None, None, None, None, None, None), (None, None, "s", 1, "l", 1, 1, "f", 1, 1, 1), (None, "no id", "s", 1, "l", 1, 1, "f", 1, 1, 1)]
    rows += [(3, "", "s", 1, "l", 1, 1, "f", 1, 1, 1), (4, f"see {item} here", "s", 1, "l", 1, 1, "f", 1, 1, 1), (1, "other words under the same number", "t", 1, "l", 1, 1, "f", 1, 1, 1), (6, "long " * 100_000, "s", 1, "l", 1, 1, "f", 1, 1, 1)]
    labels = [(None, None, None), (1, 1, None), (1, 1, 0)]
    for name, data, schema in (("documents", rows, extra), ("labels", labels, "doc_id LONG, quality INT, toxic INT"), ("benchmark", [(None, item), (1, None), (None, item)], "item_id LONG, text STRING")):
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{sf}/{name}")
            out = spark.read.parquet(f"{sf}/{name}")
            docs = out
        counts.append(out.count())
    kept = {(r.doc_id, (r.text or "")[:5], r.score) for r in docs.collect()}
    assert counts[:2] == [len(rows)] * 2
    # equal rows once, both texts of one number, rows without a number; null and empty are one text
    assert kept == {(1, "kind ", "s"), (1, "other", "t"), (2, "", None), (None, "", "s"), (None, "no id", "s"), (6, "long ", "s")}
    empty = str(tmp_path / "empty")
    for name, schema in (("documents", extra), ("labels", "doc_id LONG, quality INT, toxic INT"), ("benchmark", "item_id LONG, text STRING")):
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0

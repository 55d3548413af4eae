"""Benchmark decontamination: exact containment of item windows by a prefix-filtered set join.

A window (10 consecutive words of an item, or a shorter item whole) is a set of word shingles.
Containment has to be whole, so a window's prefix is one shingle: the rarest in the documents. Only
places of documents with such a shingle become rows of the join. A window then has to fit around
the place (positional and length bounds) and to agree word by word.

Documents are matched with the benchmark's shingles by a bit array of fixed size, so nothing that is
broadcast grows with the benchmark or the documents; a false hit costs a row of the join, no more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bit_array, in_bits, mix, stored, text_slices
from .words import ALNUM, Words

WINDOW, SHINGLE = 10, 3
def shingles(words: Words, hashes: np.ndarray, sizes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By size: hash of the shingle from each word on, and whether it fits."""
    return {k: (lambda h, ok: (mix(h ^ U64(k)), ok))(*words.windows(hashes, k)) for k in sizes}


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored windows: item_id, at, size, words, and their shingles as (offset, h)."""

    def cut(batches):
        for batch in batches:
            rows = []
            for part in text_slices(batch, "text"):
                w = Words(part.column("text"), ALNUM, lower=True)
                by_size = shingles(w, w.hashes(), range(1, SHINGLE + 1))
                words = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.stops, strict=True)]
                for r, item in enumerate(part.column("item_id").to_pylist()):
                    first, n = int(w.rows[r]), int(w.counts[r])
                    size = min(n, window)
                    k = min(size, SHINGLE)
                    for at in range(n - size + 1 if n else 0):
                        s = by_size[k][0][first + at : first + at + size - k + 1].view(np.int64).tolist()
                        rows.append((item, at, size, words[first + at : first + at + size], [{"offset": i, "h": h} for i, h in enumerate(s)]))
            kinds = [batch.schema.field("item_id").type, pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.struct([("offset", pa.int32()), ("h", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["item_id", "at", "size", "words", "shingles"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return stored(benchmark.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, at INT, size INT, words ARRAY<STRING>, shingles ARRAY<STRUCT<offset: INT, h: LONG>>"), "windows")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, __key, n_words, n_hit, items): words, words inside an
    occurrence of a window, and the sorted item_ids, as strings, with occurring windows.

    Null and empty texts have no words and no hits; items without words have no windows; null
    item_ids count as no item, but their windows still hit. Repeated rows have a result each. An
    empty benchmark hits nothing; an empty table of documents gives an empty result.
    """
    spark = docs.sparkSession
    cut = windows(benchmark, window)
    once = cut.dropDuplicates(["item_id", "at", "size", "words"])  # else a repeated item has each shingle more than n times
    parts = stored(once.select("item_id", "at", "size", "words", F.size("shingles").alias("n"), F.inline("shingles")), "window-shingles")
    sizes = sorted(min(r.size, SHINGLE) for r in cut.select("size").distinct().collect())  # at most ``window`` sizes
    sizes = sorted(set(sizes))
    known = spark.sparkContext.broadcast(bit_array(parts.select("h")))

    def count(batches):
        for batch in batches:
            found = [np.zeros(0, U64)]
            for part in text_slices(batch, "text"):
                w = Words(part.column("text"), ALNUM, lower=True)
                for h, ok in shingles(w, w.hashes(), sizes).values():
                    found.append(h[ok & in_bits(known.value, h)])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    seen = stored(docs.select("text").mapInArrow(count, "h LONG, n LONG").groupBy("h").agg(F.sum("n").alias("seen")), "shingle-counts")
    rarest = parts.join(seen, "h").groupBy("item_id", "at", "size", "words", "n").agg(F.count("*").alias("present"), F.min(F.struct("seen", "h", "offset")).alias("rare"))
    prefixes = stored(rarest.filter("present = n").select("item_id", "size", "words", "rare.h", "rare.offset"), "prefixes")
    rare = spark.sparkContext.broadcast(bit_array(prefixes.select("h")))

    def places(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                w = Words(part.column("text"), ALNUM, lower=True)
                hits: list[list[dict]] = [[] for _ in range(len(part))]
                for h, ok in shingles(w, w.hashes(), sizes).values():
                    for i in np.flatnonzero(ok & in_bits(rare.value, h)).tolist():
                        r = int(w.row[i])
                        a, b = max(int(w.rows[r]), i - window + 1), min(int(w.rows[r + 1]), i + window)
                        around = [bytes(w.data[x:y]).decode() for x, y in zip(w.starts[a:b], w.stops[a:b], strict=True)]
                        hits[r].append({"h": int(h[i : i + 1].view(np.int64)[0]), "at": i - int(w.rows[r]), "before": i - a, "words": around})
                kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("words", pa.list_(pa.string()))]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__key"), pa.array(w.counts.astype(np.int64)), pa.array(hits, kind)], ["doc_id", "__key", "n_words", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("__key")).mapInArrow(places, f"doc_id {kind}, __key LONG, n_words LONG, places ARRAY<STRUCT<h: LONG, at: LONG, before: INT, words: ARRAY<STRING>>>"), "places")
    near = rows.select("doc_id", "__key", F.inline("places")).alias("d").join(prefixes.alias("w"), "h")
    fits = near.filter("before >= offset AND size(d.words) - before >= w.size - offset AND slice(d.words, before - offset + 1, w.size) = w.words")
    ranges = fits.groupBy("doc_id", "__key").agg(F.collect_set(F.struct((F.col("at") - F.col("offset")).alias("a"), (F.col("at") - F.col("offset") + F.col("w.size")).alias("b"))).alias("ranges"), F.collect_set("item_id").alias("found"))
    hits = ranges.select(
        F.col("doc_id").alias("__doc"),
        F.col("__key").alias("__of"),
        F.expr("aggregate(array_sort(ranges), named_struct('n', 0L, 'stop', 0L), (s, x) -> named_struct('n', s.n + greatest(0L, x.b - greatest(x.a, s.stop)), 'stop', greatest(s.stop, x.b)), s -> s.n)").alias("__hit"),
        F.expr("array_sort(transform(found, x -> CAST(x AS STRING)))").alias("__items"),
    )
    hits = stored(hits, "hits")
    both = rows.drop("places").join(hits, F.col("__key").eqNullSafe(F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    return both.select("doc_id", "__key", "n_words", F.coalesce("__hit", F.lit(0)).alias("n_hit"), F.coalesce("__items", F.expr("CAST(array() AS array<string>)")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns pass."""
    found = stored(contamination(docs, benchmark, window).filter("n_hit > 0").select(F.col("__key").alias("__found")).distinct(), "contaminated")
    return docs.join(found, F.xxhash64("doc_id", "text") == F.col("__found"), "left_anti")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    out = contamination(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, s, unnest(range(1, len(w) - s + 2)) AS i, w FROM (SELECT *, least(len(w), 10) AS s FROM b WHERE len(w) > 0)),
bk AS (SELECT DISTINCT item_id, s, array_to_string(w[i:i + s - 1], ' ') AS k FROM bw),
dw AS (SELECT r, s, i, array_to_string(w[i:i + s - 1], ' ') AS k FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM bk) WHERE len(w) >= s)),
h AS (SELECT r, i, s, item_id FROM dw JOIN bk USING (s, k)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + s)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, item_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

"""Substring dedup by level-wise doubling.

A window of ``words`` words goes where an earlier document (smaller doc_id) has it too. A window can
only repeat if the half-length windows inside it do, so the search starts at half the length, and
windows repeated there alone are extended to twice that length.

*Half length.* Of the half windows inside each window, the one with the least hash speaks for it:
equal windows choose equal half windows, so about one place in ten is looked at, and only hashes go
through the shuffle. Those that several documents have are kept in a bit array of fixed size.

*Full length.* Consecutive windows that chose the same half window form a segment. Equal segments
are settled at once: all but the first document's are repeats. What is left (one segment for each
distinct one) gives its windows one by one, and these find the first document of each window.

*Beyond.* Longer windows cover no more words, so removal ends here. ``levels`` goes on doubling until
no candidates survive: each level reads only the documents that share a window of the level before.

Texts are read again for each step rather than shuffled; only documents that lose words are joined
with what they lose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, bit_array, in_bits, mix, stored, text_slices, with_columns
from .words import SPACED, Words, ranges_hash, sliding_argmin

SLICE = 1 << 19  # bytes of text whose arrays are held at a time
BITS = 1 << 27  # 16 MiB: more repeats than it can tell apart cost time, never results


class Segments:
    """Runs of windows of one document that chose the same half window: ``first`` to ``last`` are
    the windows' first words, ``chosen`` the hash of the half window."""

    def __init__(self, texts, words: int):
        self.w = Words(texts, SPACED)
        self.hashes = self.w.hashes()
        half = words // 2
        value, whole = self.w.windows(self.hashes, half)
        value = np.where(whole, value, U64(0xFFFFFFFFFFFFFFFF))
        n = len(self.hashes)
        starts = np.flatnonzero(self.w.rows[self.w.row + 1] >= np.arange(n) + words) if n else np.zeros(0, np.int64)
        least = sliding_argmin(value, words - half + 1)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        self.first, self.last = starts[at], starts[np.concatenate([at[1:], [len(starts)]]).astype(np.int64) - 1] if len(at) else starts
        self.chosen = value[least[at]]
        self.row = self.w.row[self.first]
        self.words = words

    def keep(self, which: np.ndarray) -> None:
        self.first, self.last, self.chosen, self.row = self.first[which], self.last[which], self.chosen[which], self.row[which]

    def local(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Word numbers inside the rows."""
        return at - self.w.rows[row]


def _place(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(key.view(U64) + at.astype(U64) * U64(0x9E3779B97F4A7C15))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def _scan(docs: DataFrame, words: int, schema: str, rows) -> DataFrame:
    """``rows(segments, doc_id, key)`` of every slice of the documents, as columns of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                s = Segments(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([_long(c) for c in rows(s, part.column("doc_id").to_numpy(), part.column("__key").to_numpy())], names)

    return docs.mapInArrow(run, schema)


def repeats(docs: DataFrame, words: int = 50, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, __key, a, b): ranges of words covered by windows that a smaller doc_id has; and
    (doc_id, __key) of the documents that share a window with another doc_id, the first ones too.

    ``docs`` has doc_id (long, not null), text and __key, a hash of both. Rows that are equal in
    doc_id and text have their ranges once.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast

    halves = _scan(docs, words, "h LONG, doc_id LONG", lambda s, doc, key: (s.chosen, doc[s.row]))
    halves = halves.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("h")
    repeated = share(bit_array(halves, bits))

    def segments(s, doc, key):
        s.keep(in_bits(repeated.value, s.chosen))
        stop = s.last + s.words
        return [ranges_hash(s.hashes, s.first, stop, 1), ranges_hash(s.hashes, s.first, stop, 2), doc[s.row], key[s.row], s.local(s.first, s.row), stop - s.first]

    found = stored(_scan(docs, words, "h1 LONG, h2 LONG, doc_id LONG, __key LONG, a LONG, n LONG", segments), "segments")
    firsts = stored(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"), "segment-firsts")
    told = found.join(firsts, ["h1", "h2"], "left").select("doc_id", "__key", "a", "n", F.col("least").isNotNull().alias("shared"), F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)).alias("settled"))
    told = stored(told, "segments-told")

    open_at = told.filter("NOT settled").select("__key", "a").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([_long(_place(b.column(0).to_numpy(), b.column(1).to_numpy()))], ["h"]) for b in batches), "h LONG")
    unsettled = share(bit_array(open_at, bits))

    def single(s, doc, key):
        s.keep(in_bits(repeated.value, s.chosen))
        s.keep(in_bits(unsettled.value, _place(key[s.row], s.local(s.first, s.row))))
        size = s.last - s.first + 1
        at = np.repeat(s.first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else s.first
        row = np.repeat(s.row, size)
        return [ranges_hash(s.hashes, at, at + s.words, 1), ranges_hash(s.hashes, at, at + s.words, 2), doc[row], key[row], s.local(at, row)]

    windows = _scan(docs, words, "h1 LONG, h2 LONG, doc_id LONG, __key LONG, a LONG", single)
    firsts = stored(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"), "window-firsts")
    shared = stored(windows.join(firsts, ["h1", "h2"]).select("doc_id", "__key", "a", (F.col("least") < F.col("doc_id")).alias("late")), "shared-windows")
    late = shared.filter("late").select("doc_id", "__key", "a", (F.col("a") + words).alias("b"))
    found = told.filter("settled").select("doc_id", "__key", "a", (F.col("a") + F.col("n")).alias("b")).unionByName(late)
    holders = told.filter("shared").select("doc_id", "__key").unionByName(shared.select("doc_id", "__key"))
    return stored(found.dropDuplicates(), "repeats"), holders


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("__key"))


def levels(docs: DataFrame, words: int = 50, bits: int = BITS):
    """(words, documents read, their repeats) of each level: ``words``, twice that, four times that, ...
    until no candidates survive. A longer window is shared only by documents that share a shorter one, so
    a level reads the documents that survived the one before (told by a bit array of their keys)."""
    share = docs.sparkSession.sparkContext.broadcast
    own = _keyed(docs)
    while True:
        found, holders = repeats(own, words, bits)
        yield words, own, found
        if found.isEmpty():
            return
        survivors = share(bit_array(holders.select(F.col("__key").alias("h")), bits))

        def kept(batches, survivors=survivors):
            for b in batches:
                yield b.filter(pa.array(in_bits(survivors.value, b.column("__key").to_numpy())))

        own, words = _keyed(docs).mapInArrow(kept, own.schema), 2 * words


def longest_repeats(docs: DataFrame, words: int = 50, bits: int = BITS) -> DataFrame:
    """(doc_id, longest): for documents that repeat a smaller doc_id's words, the greatest of the
    ``levels`` whose windows still do. Rows as in :func:`dedup_substrings`."""
    out = None
    for size, _, found in levels(docs, words, bits):
        level = found.select("doc_id", F.lit(size).alias("longest"))
        out = level if out is None else out.unionByName(level)
    return out.groupBy("doc_id").agg(F.max("longest").alias("longest"))


def _kept(text: str, ranges: list[dict]) -> tuple[list[bytes], int]:
    words = (text or "").encode().split()  # bytes split at 0x20 and 0x09-0x0D
    gone = np.zeros(len(words) + 1, np.int64)
    for r in ranges or ():
        gone[r["a"]] += 1
        gone[r["b"]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    return [w for w, g in zip(words, gone, strict=True) if not g], len(words)


def dedup_substrings(docs: DataFrame, words: int = 50, bits: int = BITS) -> DataFrame:
    """``docs`` with repeated words removed: ``text`` has the kept words joined by one space, with
    ``n_words`` (before) and ``n_removed``.

    A word goes if a window of ``words`` consecutive words covers it whose sequence also starts in a
    document with a smaller doc_id. Windows are those of the input, so each sequence survives in the
    first document that has it. Rows that share a doc_id are one document: they take no words from
    each other. Rows without a doc_id neither give nor lose words. Null, empty and shorter texts lose
    nothing; a null text comes back empty. Other columns pass; columns named ``n_words`` or
    ``n_removed`` are replaced. An empty table gives an empty result. Very long texts are read whole,
    each by one task, and are cut into no parts.
    """
    spark = docs.sparkSession
    key = F.xxhash64("doc_id", "text")
    found, _ = repeats(_keyed(docs), words, bits)
    ranges = stored(found.groupBy("doc_id", "__key").agg(F.collect_list(F.struct("a", "b")).alias("__ranges")), "ranges")
    losing = spark.sparkContext.broadcast(bit_array(ranges.select(F.col("__key").alias("h")), bits))
    out = with_columns(docs, n_words=F.lit(0).cast("long"), n_removed=F.lit(0).cast("long"), __key=key)
    names = out.columns

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])

    def kept(rows, ranges):
        """The rows with their text and counts after the loss of ``ranges``."""
        done = [_kept(t, r) for t, r in zip(rows.column("text").to_pylist(), ranges, strict=True)]
        new = {"text": pa.array([b" ".join(k).decode() for k, _ in done], pa.string()), "n_words": pa.array([n for _, n in done], pa.int64()), "n_removed": pa.array([n - len(k) for k, n in done], pa.int64())}
        return pa.RecordBatch.from_arrays([new.get(c, rows.column(i)) for i, c in enumerate(names)], names)

    def loses(batch):
        return pa.array(in_bits(losing.value, batch.column(names.index("__key")).to_numpy()))

    def unchanged(batches):
        for batch in batches:
            for part in text_slices(batch.filter(pc.invert(loses(batch))), "text"):
                yield kept(part, [None] * len(part))

    def changed(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield kept(part, part.column(len(names)).to_pylist())

    other = ranges.select(F.col("doc_id").alias("__doc"), F.col("__key").alias("__of"), "__ranges")
    some = out.mapInArrow(lambda batches: (b.filter(loses(b)) for b in batches), schema)
    some = some.join(other, (some["__key"] == other["__of"]) & (some["doc_id"] == other["__doc"]), "left").select(*(F.col(f"`{c}`") for c in names), "__ranges")
    return out.mapInArrow(unchanged, schema).unionByName(some.mapInArrow(changed, schema)).drop("__key")


def digest(docs: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    out = dedup_substrings(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (k) WHERE m < doc_id),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

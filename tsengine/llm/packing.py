"""Packing: documents become token pieces, pieces become sequences of bounded length.

Shortest-pack-first over the length histogram: the histogram of piece lengths is read from the
longest to the shortest length, and all pieces of one length go, in runs, to the open packs with
the most room. A run of equal packs is one entry, so the plan has one row for each run whatever the
number of documents; pieces find their pack by their rank among the pieces of their length.

Ranks need no ordering of all pieces of a length (copies can give a third of all rows one length):
a piece has its running number among the pieces of its length in its stored task, and the counts by
length and task are summed in order.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored

CACHE_UNITS = 800_000
PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth")])


# The letters, numbers and white space below U+0100 by their Unicode categories.
LETTERS, NUMBERS, SPACE = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """The vocabulary's character for each byte: printable Latin-1 stands for itself, the others for
    the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of a text as little-endian bytes, from remembered ids of its units.

    The tokenizer puts texts in lower case, drops white space and merges inside units only: runs of
    letters, single numbers, runs of other signs, and endings such as 's. So a text's ids are those
    of its units. Texts of characters up to U+00FF, where normal forms and lower case need no
    context, are cut by UNITS; any other text is cut at spaces and line feeds alone.

    With ``added``, the tokenizer's added tokens (such as <|endoftext|>) in a text have their own ids,
    as in the tokenizer's default; the text is cut there first. Without, they are read as other text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known: dict[str, bytes] = {}
        self.added = {t.content: struct.pack("<I", i) for i, t in self.tokenizer.get_added_tokens_decoder().items()} if added else {}
        self.marks = re.compile(f"({'|'.join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))})")

    def units_ids(self, units: list[str], cut: bool):
        if not cut:
            return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return [[t.id for t in self.model.tokenize(u if u.isascii() and u.isprintable() else u.encode().decode("latin-1").translate(self.letters))] for u in units]

    def __call__(self, text: str) -> bytes:
        if not self.added:
            return self.plain(text)
        return b"".join(self.added[x] if i % 2 else self.plain(x) for i, x in enumerate(self.marks.split(text)))

    def plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            cut = True
        except UnicodeEncodeError:
            cut = False
        units = UNITS.findall(text.lower()) if cut else text.replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join(map(known.__getitem__, units))
        except KeyError:
            if len(known) > CACHE_UNITS:
                known.clear()
            new = list({u for u in units if u not in known})
            for u, ids in zip(new, self.units_ids(new, cut), strict=True):
                known[u] = struct.pack(f"<{len(ids)}I", *ids)
            return b"".join(map(known.__getitem__, units))


_open: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The process's own tokenizer, which the tasks of a worker share."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _open[path] = WordIds(path, added=True)
    return _open[path]


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 1) -> DataFrame:
    """Stored pieces (doc_id, start, length, ids_crc32, doc_tokens, task, nth): a document's ids and
    ``end_id``, cut after every ``max_tokens``."""

    def cut(batches):
        from pyspark import TaskContext

        ids, task, seen, end = word_ids(tokenizer), TaskContext.get().partitionId(), Counter(), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = ids(text.as_py() or "") + end
                n = len(data) // 4
                for start in range(0, n, max_tokens):
                    length = min(max_tokens, n - start)
                    rows.append((doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, task, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(PIECE))], PIECE.names)

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE), "pieces")


def plan_packs(histogram: dict[int, int], max_tokens: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) and the number of sequences."""
    runs, sequences = [], 0
    open_packs: list[tuple[int, int, int]] = []  # (-room, first sequence, count), the shortest packs first
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, first, count = heapq.heappop(open_packs)
                room = -room
            else:
                room, first, count = max_tokens, sequences, left
                sequences += left
            take = min(left, count)
            runs.append((length, rank, take, first, max_tokens - room))
            if room > length:
                heapq.heappush(open_packs, (length - room, first, take))
            if count > take:
                heapq.heappush(open_packs, (-room, first + take, count - take))
            rank, left = rank + take, left - take
    return runs, sequences


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of ``end_id`` alone. Repeated rows are packed once each, null
    doc_ids too; no other column is read. Pieces of one length are interchangeable, so ties need no
    order. An empty table gives an empty result. The driver sees one count for each length up to
    ``max_tokens``.
    """
    cut = pieces(docs, tokenizer, max_tokens, end_id)
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stored(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    histogram = {r.length: r.n for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_packs(histogram, max_tokens)
    by_length = defaultdict(list)
    for length, *run in runs:
        by_length[length].append(run)
    table = docs.sparkSession.sparkContext.broadcast({k: [np.asarray(c, np.int64) for c in zip(*v, strict=True)] for k, v in by_length.items()})

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                first, _, start, where = table.value[size]
                run = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = start[run] + rank[at] - first[run], where[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in PIECE.names[:5]), pa.array(sequence), pa.array(offset)], [*PIECE.names[:5], "sequence_id", "offset"])

    ranked = cut.join(firsts.select("length", "task", "first"), ["length", "task"]).select(*PIECE.names[:5], (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, T.StructType([*PIECE.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))

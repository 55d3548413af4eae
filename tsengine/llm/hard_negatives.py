"""Hard-negative mining by a vertical scan with branch and bound (BOND).

For each anchor: its nearest rows of the same label are its positives, and for each positive the best
rows of other labels are wanted whose score lies in a window below the positive's.

*Blocks.* Rows are cut into blocks, stored by column: one run of values for each dimension, with
the least and greatest value of each. Rows of a label lie together in their partition.
*Scan.* An anchor reads the dimensions in the order of its own largest magnitudes. After some
dimensions a row's score is known but for the rest, which the block's least and greatest values bound
from both sides. Rows whose bounds can't reach any window, or the best ones already found, leave the
candidate bitmap. With all dimensions read, bounds are exact scores.
*Passes.* Anchors go to the tasks in groups of bounded size, and each group meets all blocks. A task
keeps the best rows of each anchor (and window) over its blocks; only these leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

BLOCK_ROWS, BLOCK_VALUES = 4096, 1 << 18
GROUP_BYTES, GROUP_CHUNKS = 2 << 20, 8  # anchors of a chunk, chunks of a pass
STEPS = 8  # rounds of reading and pruning
BLOCKS = "size INT, ids BINARY, labels BINARY, columns BINARY"
CHUNKS = "size INT, ids BINARY, keys BINARY, labels BINARY, vectors BINARY, windows BINARY"
NONE = np.iinfo(np.int64).min


def matrix(lists: pa.Array, size: int) -> np.ndarray:
    offsets = np.asarray(lists.offsets)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def runs(batches, limit: Callable[[int], int]):
    """Tables of consecutive rows of one vector size, of at most ``limit(size)`` rows each."""
    kept, kept_size, rows = [], None, 0
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            while at < end:
                size = int(sizes[at])
                if kept and (size != kept_size or rows == limit(kept_size)):
                    yield kept_size, pa.Table.from_batches(kept).combine_chunks()
                    kept, rows = [], 0
                take = min(end - at, limit(size) - rows)
                kept.append(batch.slice(at, take))
                kept_size, rows, at = size, rows + take, at + take
    if kept:
        yield kept_size, pa.Table.from_batches(kept).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks)


def to_blocks(batches):
    for size, table in runs(batches, lambda size: max(64, min(BLOCK_ROWS, BLOCK_VALUES // max(1, size)))):
        values = np.ascontiguousarray(matrix(column(table, "vector"), size).T) if size else np.zeros((0, len(table)), np.int64)
        data = [column(table, n).to_numpy().astype(np.int64).tobytes() for n in ("vec_id", "label")]
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *(pa.array([d], pa.binary()) for d in (*data, values.tobytes()))], ["size", "ids", "labels", "columns"])


def to_chunks(windows: int):
    def work(batches):
        for size, table in runs(batches, lambda size: max(1, GROUP_BYTES // (8 * (size + windows + 3)))):
            data = [column(table, n).to_numpy().astype(np.int64) for n in ("vec_id", "key", "label")]
            data.append(matrix(column(table, "vector"), size) if size else np.zeros((len(table), 0), np.int64))
            data.append(matrix(column(table, "scores"), windows) if windows else np.zeros((len(table), 0), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *(pa.array([d.tobytes()], pa.binary()) for d in data)], ["size", "ids", "keys", "labels", "vectors", "windows"])

    return work


def bond(columns: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block (dimensions x rows) that are left of the bitmap ``alive``, and their exact scores.

    ``keep(least, most)`` tells from bounds of the scores which rows stay.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    a = anchor[order]
    x, y = a * low[order], a * high[order]
    rest_min = np.append(np.cumsum(np.minimum(x, y)[::-1])[::-1], 0)
    rest_max = np.append(np.cumsum(np.maximum(x, y)[::-1])[::-1], 0)
    at, done, step = np.flatnonzero(alive), 0, max(1, -(-len(a) // STEPS))
    score = np.zeros(len(at), columns.dtype)
    while len(at):
        some = keep(score + rest_min[done], score + rest_max[done])
        if not some.all():
            at, score = at[some], score[some]
        if done == len(a):
            break
        part = columns[order[done : done + step]]
        score = score + a[done : done + step] @ (part if len(at) == columns.shape[1] else part[:, at])
        done = min(len(a), done + step)
    return at, score


def kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


class Best:
    """The first ``k`` (score, id) of each of ``n`` searches: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.floor = np.full(n, NONE)  # the last score, once there are k

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, d = np.concatenate([self.scores[i], scores.astype(np.int64)]), np.concatenate([self.ids[i], ids])
        first = np.lexsort((d, -s))[: self.k]
        self.scores[i], self.ids[i] = s[first], d[first]
        if len(first) == self.k:
            self.floor[i] = s[first[-1]]


class Chunk:
    """Some anchors of one vector size, with the windows of scores that are searched for each."""

    def __init__(self, row, low: int, high: int):
        self.size = row["size"]
        self.ids, self.keys, self.labels = (np.frombuffer(row[n], np.int64) for n in ("ids", "keys", "labels"))
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(self.ids), self.size)
        positive = np.frombuffer(row["windows"], np.int64).reshape(len(self.ids), -1)
        self.windows = [[(-(-low * s // 100), high * s // 100, s) for s in sorted({int(s) for s in p if s != NONE})] for p in positive]


def nearest(chunk: Chunk, best: Best, i: int, block, k: int, alive: np.ndarray) -> None:
    ids, columns, low, high, dtype = block

    def keep(least, most):
        floor = best.floor[i]
        return most >= (max(floor, kth(least, k)) if len(least) >= k else floor)

    at, score = bond(columns, low, high, chunk.vectors[i].astype(dtype), alive, keep)
    if len(at):
        best.add(i, score, ids[at])


def windowed(chunk: Chunk, best: Best, i: int, first: int, block, k: int, alive: np.ndarray) -> None:
    ids, columns, low, high, dtype = block
    windows = chunk.windows[i]

    def keep(least, most):
        some = np.zeros(len(least), bool)
        for n, (bottom, top, _) in enumerate(windows):
            floor = max(bottom, best.floor[first + n])
            sure = least[(least >= bottom) & (most <= top)]
            if len(sure) >= k:
                floor = max(floor, kth(sure, k))
            some |= (most >= floor) & (least <= top)
        return some

    at, score = bond(columns, low, high, chunk.vectors[i].astype(dtype), alive, keep)
    for n, (bottom, top, _) in enumerate(windows):
        inside = (score >= bottom) & (score <= top)
        if inside.any():
            best.add(first + n, score[inside], ids[at[inside]])


def scan(blocks: DataFrame, chunks: DataFrame, k: int, exact: bool, low: int = 0, high: int = 0, same: bool = True) -> DataFrame:
    """Candidates (anchor_id, key, window, vec_id, score): from every task, the first ``k`` rows of the
    anchor's label (``same``), or of other labels in each of its windows. A pass sends at most
    GROUP_CHUNKS chunks; the driver sees one pass's chunks at a time."""
    spark = blocks.sparkSession
    dtype = np.float64 if exact else np.int64
    numbers = sorted(r.chunk for r in chunks.select("chunk").collect())  # one long per GROUP_BYTES of anchors
    out = []
    for at in range(0, max(1, len(numbers)), GROUP_CHUNKS):
        group = [r.asDict() for r in chunks.filter(F.col("chunk").isin(numbers[at : at + GROUP_CHUNKS])).collect()]
        sent = spark.sparkContext.broadcast(group)

        def work(batches, sent=sent):
            opened = [Chunk(r, low, high) for r in sent.value]
            firsts = [np.concatenate([[0], np.cumsum([1 if same else len(w) for w in c.windows])]).astype(np.int64) for c in opened]
            bests = [Best(int(f[-1]), k) for f in firsts]
            for batch in batches:
                for row in batch.to_pylist():
                    size = row["size"]
                    ids, labels = (np.frombuffer(row[n], np.int64) for n in ("ids", "labels"))
                    columns = np.frombuffer(row["columns"], np.int64).reshape(size, len(ids)).astype(dtype)
                    block = ids, columns, columns.min(axis=1), columns.max(axis=1), dtype
                    for c, best, first in zip(opened, bests, firsts, strict=True):
                        if c.size != size:
                            continue
                        wanted = np.isin(c.labels, labels) if same else np.asarray([bool(w) for w in c.windows]) & ~((labels == labels[0]).all() & (c.labels == labels[0]))
                        for i in np.flatnonzero(wanted).tolist():
                            if same:
                                nearest(c, best, i, block, k, (labels == c.labels[i]) & (ids != c.ids[i]))
                            else:
                                windowed(c, best, i, int(first[i]), block, k, (labels != c.labels[i]) & (ids != c.ids[i]))
            for c, best, first in zip(opened, bests, firsts, strict=True):
                found = np.asarray([len(x) for x in best.ids], np.int64)
                owner = np.repeat(np.arange(len(c.ids)), np.diff(first))
                window = np.asarray([0] * len(owner) if same else [s for w in c.windows for _, _, s in w], np.int64)
                columns = [np.repeat(x, found) for x in (c.ids[owner], c.keys[owner], window)]
                columns += [np.concatenate([*x, np.zeros(0, np.int64)]) for x in (best.ids, best.scores)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["anchor_id", "key", "window", "vec_id", "score"])

        out.append(stored(blocks.mapInArrow(work, "anchor_id LONG, key LONG, window LONG, vec_id LONG, score LONG"), "hard-negative-pass"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def first_rows(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` candidates of each anchor and window, with their rank from 1."""
    order = Window.partitionBy("anchor_id", "key", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def chunked(anchors: DataFrame, windows: int, n_bytes: int) -> DataFrame:
    parts = max(1, -(-n_bytes // GROUP_BYTES))
    return stored(anchors.repartition(parts).sortWithinPartitions("size").mapInArrow(to_chunks(windows), CHUNKS).withColumn("chunk", F.monotonically_increasing_id()), "anchor-chunks")


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (vec_id,
    label, vector of integers) that meet ``anchor``.

    Scores are inner products. An anchor's positives are its first ``positives`` rows of its label with
    another vec_id; each has the first ``negatives`` rows of other labels whose score is between ``low``
    and ``high`` percent of the positive's. Ties go to the smaller vec_id.

    Rows with a null in vec_id, label or vector take no part; no other column is read. Equal rows are
    one; different rows of one vec_id all take part, and are anchors of their own. Rows are only
    compared with those of the same vector length. Anchors without positives or negatives have no
    rows, so an empty table gives an empty result. Integers whose scores may not fit 64 bits are refused.
    """
    valid = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), anchor.alias("is_anchor")).filter(valid)
    own = own.dropDuplicates(["vec_id", "label", "vector"]).withColumn("size", F.size("vector"))
    own = stored(own.sortWithinPartitions("size", "label"), "hard-negative-rows")
    largest = F.greatest(F.abs(F.array_max("vector").cast("double")), F.abs(F.array_min("vector").cast("double")))
    seen = own.agg(F.max(largest).alias("value"), F.max("size").alias("size"), F.sum(F.when(F.col("is_anchor"), 8 * (F.col("size") + positives + 3))).alias("n_bytes")).head()
    bound = (seen.value or 0) ** 2 * (seen.size or 0)
    if bound >= 2**62:
        raise ValueError(f"scores of {seen.size} integers of up to {seen.value:g} may not fit 64 bits")
    exact = bound < 2**52  # sums of doubles are then exact
    blocks = stored(own.select("size", "vec_id", "label", "vector").mapInArrow(to_blocks, BLOCKS), "hard-negative-blocks")
    anchors = own.filter("is_anchor").select("size", "vec_id", "label", "vector", F.xxhash64("label", "vector").alias("key"))
    near = first_rows(scan(blocks, chunked(anchors, 0, seen.n_bytes or 0), positives, exact), positives)
    near = stored(near.select("anchor_id", "key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "hard-positives")
    scores = near.groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(F.collect_list("positive_score").alias("scores"))  # at most `positives`
    padded = F.concat("scores", F.array_repeat(F.lit(int(NONE)).cast("long"), F.lit(positives) - F.size("scores"))).alias("scores")
    sought = anchors.join(scores, ["vec_id", "key"]).select("size", "vec_id", "label", "vector", "key", padded)
    found = first_rows(scan(blocks, chunked(sought, positives, seen.n_bytes or 0), negatives, exact, low, high, same=False), negatives)
    found = found.select("anchor_id", "key", F.col("window").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["anchor_id", "key", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def digest(rows: DataFrame) -> DataFrame:
    """The contract's rows: components are floor(256 * x); rows with a non-finite component take no
    part; every seventh label is shifted; every hundredth row is an anchor."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    own = rows.filter(~bad).select("vec_id", shifted.alias("label"), scaled.alias("vector"))
    return mine(own, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM own a JOIN own b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5
"""

"""Embedding near-dedup: binary codes by iterative quantisation, multi-index Hamming tables, and a
rerank with the original vectors.

*Classes.* Equal vectors are one class, counted before anything is compared: copies cost no pairs.
*Codes.* Unit vectors are centred, put on their principal axes and turned by a rotation that brings
them nearest to the corners of a cube, for each vector length (learned on a bounded sample; every vector
is coded). Vectors of over FOLD components are folded to FOLD first, by a fixed random sign for each.
*Tables.* A code is cut into 4 segments, each the key of a table; a vector is entered under its own
segment and those one bit away. Two codes within 11 bits differ by at most 2 in some segment, so
they meet there. Of the keys at which a pair meets, one is told from the codes alone as its own, so
each pair is looked at once, in one group.
*Rerank.* Groups are cut into blocks. Vectors with a pair within 11 bits are fetched for their
block, and cosines decide in double precision. Pairs leave a task as numbers of links per vector and
as a spanning forest, never one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, stored
from .groups import block_pairs, connected_components, forest

SEGMENTS, BITS, RADIUS = 4, 16, 11
BLOCK = 512
FOLD = 1024


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Offsets and items of a list array."""
    offsets = np.asarray(lists.offsets)
    return offsets - offsets[0], lists.values.slice(offsets[0], offsets[-1] - offsets[0])


def unit(values: pa.Array, size: int) -> np.ndarray:
    """Unit vectors of ``size`` components in double precision."""
    _, items = flat(values)
    out = items.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    out = out / np.abs(out).max(axis=1, keepdims=True)  # else squares may overflow or vanish
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def folded(x: np.ndarray) -> np.ndarray:
    """Long vectors as sums of FOLD columns with fixed random signs, which keeps angles about."""
    size = x.shape[1]
    if size <= FOLD:
        return x
    x = x * np.random.default_rng(size).choice([-1.0, 1.0], size)
    x = np.pad(x, ((0, 0), (0, -size % FOLD))).reshape(len(x), -1, FOLD).sum(axis=1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def by_size(batch: pa.RecordBatch):
    """(size, rows) of a batch, for each vector length in it."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, batch if len(at) == len(sizes) else batch.take(pa.array(at))


def needed_radius(cosine: float, bits: int = SEGMENTS * BITS) -> float:
    """Differing bits that 97 of 100 pairs at this cosine stay within: each bit of a pair differs with a
    chance of its angle over a half turn."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return bits * p + 1.9 * math.sqrt(bits * p * (1 - p))


def learn(x: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Centre and turned axes (columns) for up to 64 bits, by iterative quantisation."""
    centre = x.mean(axis=0)
    bits = min(SEGMENTS * BITS, x.shape[1])
    spread = (x - centre).T @ (x - centre)
    if len(x) <= bits:  # too few to tell axes: any will do
        spread = spread * 0 + np.diag(np.random.default_rng(x.shape[1]).random(x.shape[1]))
    _, axes = np.linalg.eigh(spread)
    axes = axes[:, ::-1][:, :bits]
    v = (x - centre) @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = right.T @ left.T
    return centre, axes @ turn


def codes(x: np.ndarray, centre: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Codes as signed longs; bits beyond the axes are 0."""
    bits = np.zeros((len(x), SEGMENTS * BITS), bool)
    bits[:, : axes.shape[1]] = (x - centre) @ axes >= 0
    return np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64)


def table_keys(code: str = "code", size: str = "size"):
    """Keys of a code in all tables: vector length, table, and the segment as it is or one bit off."""
    keys = []
    for t in range(SEGMENTS):
        part = F.shiftrightunsigned(code, t * BITS).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
        keys += [(F.col(size).cast("long") * SEGMENTS + t) * (1 << BITS) + part.bitwiseXOR(F.lit(flip).cast("long")) for flip in (0, *(1 << b for b in range(BITS)))]
    return F.array(*keys)


def own_pairs(a: np.ndarray, b: np.ndarray, table: int, value: int) -> np.ndarray:
    """Pairs of codes within RADIUS bits whose own key is ``value`` in ``table``: the first table in
    which they differ by 2 bits at most, and the least value that is one bit or less from both."""
    x = a[:, None] ^ b[None, :]
    ok = np.bitwise_count(x) <= RADIUS
    part = lambda c, t: (c >> U64(t * BITS)) & U64((1 << BITS) - 1)
    for t in range(table):
        ok &= np.bitwise_count(part(x, t)) > 2
    if not ok.any():
        return ok
    i, j = np.nonzero(ok)
    d, s, u = part(x, table)[i, j], part(a, table)[i], part(b, table)[j]
    n, low = np.bitwise_count(d), d & (~d + U64(1))
    met = np.where(n == 2, np.minimum(s ^ low, u ^ low), np.minimum(s, u))
    ok[i, j] = (n <= 2) & (met == U64(value))
    return ok


def _pairs(key, p, q, side, code) -> np.ndarray:
    """Symmetric matrix of the own pairs of one group row."""
    table, value = (key >> BITS) % SEGMENTS, key & ((1 << BITS) - 1)
    if p == q:
        out = own_pairs(code, code, table, value)
        np.fill_diagonal(out, False)
        return out
    out, a, b = np.zeros((len(code), len(code)), bool), np.flatnonzero(side == p), np.flatnonzero(side == q)
    out[np.ix_(a, b)] = own_pairs(code[a], code[b], table, value)
    return out | out.T


def _groups(batch):
    """(key, p, q, numpy columns of the members) of every row."""
    offsets, items = flat(batch.column("members"))
    side, ids, code = (items.field(i).to_numpy() for i in range(3))
    for r, (key, p, q) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q")), strict=True)):
        at = slice(offsets[r], offsets[r + 1])
        yield key, p, q, side[at], ids[at], code[at].view(U64), at, items


def links(vectors: DataFrame, cosine: float = 0.95, sample: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Stored (vec_id, n_links) of linked vectors, and edges (a, b) of a forest that spans the links.

    ``vectors`` has vec_id (long, distinct, not null), embedding (distinct, no nulls, finite, not zero),
    size (its length) and n (how many vectors it stands for). Links count all vectors of the other side.
    """
    spark = vectors.sparkSession
    if vectors.isEmpty():
        return spark.createDataFrame([], "vec_id LONG, n_links LONG"), spark.createDataFrame([], "a LONG, b LONG")
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding", "size").toArrow()  # ``sample`` rows
    batch = rows.combine_chunks().to_batches()[0]
    shared = spark.sparkContext.broadcast({size: learn(folded(unit(part.column("embedding"), size))) for size, part in by_size(batch)})

    def code(batches):
        for batch in batches:
            for size, part in by_size(batch):
                x = folded(unit(part.column("embedding"), size))
                turned = shared.value.get(size) or learn(np.zeros((1, x.shape[1])))  # a length that the sample lacks
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(codes(x, *turned)), part.column("size")], ["vec_id", "code", "size"])

    coded = stored(vectors.select("vec_id", "embedding", "size").mapInArrow(code, "vec_id LONG, code LONG, size INT"), "codes")

    def candidates(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, p, q, side, ids, code_, _, _ in _groups(batch):
                near = np.flatnonzero(_pairs(key, p, q, side, code_).any(axis=1))
                if len(near):
                    for c, v in zip(out, (np.full(len(near), key), np.full(len(near), p), np.full(len(near), q), side[near], ids[near], code_[near].view(np.int64)), strict=True):
                        c.append(v)
            kinds = (np.int64, np.int32, np.int32, np.int32, np.int64, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *c]).astype(k)) for c, k in zip(out, kinds, strict=True)], ["key", "p", "q", "side", "vec_id", "code"])

    met = block_pairs(coded.select("vec_id", "code", F.explode(table_keys()).alias("key")), "key", "vec_id", ["vec_id", "code"], BLOCK)
    near = stored(met.mapInArrow(candidates, "key LONG, p INT, q INT, side INT, vec_id LONG, code LONG"), "near")

    def rerank(batches):
        for batch in batches:
            a, b, n = [], [], []
            for key, p, q, side, ids, code_, at, items in _groups(batch):
                vectors_ = items.field(3).slice(at.start, at.stop - at.start)
                x = unit(vectors_, len(vectors_[0]))  # the key holds the length
                found = _pairs(key, p, q, side, code_) & (x @ x.T >= cosine)
                count = found @ items.field(4).to_numpy()[at]
                some = np.flatnonzero(count)
                tree = forest(found)
                a += ids[some].tolist() + [ids[i] for i, _ in tree]
                b += [None] * len(some) + [ids[j] for _, j in tree]
                n += count[some].tolist() + [0] * len(tree)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], ["a", "b", "n"])

    full = near.join(vectors.select("vec_id", "embedding", "n"), "vec_id").groupBy("key", "p", "q").agg(F.collect_list(F.struct("side", "vec_id", "code", "embedding", "n")).alias("members"))
    found = stored(full.mapInArrow(rerank, "a LONG, b LONG, n LONG"), "links")
    return found.filter("b IS NULL").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links")), found.filter("b IS NOT NULL").select("a", "b")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, sample: int = 20_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of all rows.

    Vectors link if they have the same length and a cosine of ``cosine`` or more. Null, empty and zero
    vectors and those with null or non-finite components link with nothing. ``vec_id`` names a
    vector: repeated rows of it take part once, as the one with the least hash, and have the same result
    each. Rows without a vec_id link with nothing and have a null component. Other columns are
    ignored. An empty table gives an empty result.

    Pairs whose codes differ by over RADIUS bits are not looked at, so a ``cosine`` is refused whose
    pairs would often differ by more (``needed_radius``; 0.95 is the least).
    """
    if needed_radius(cosine) > RADIUS + 0.5:
        raise ValueError(f"pairs at a cosine of {cosine} need {needed_radius(cosine):.1f} bits; the tables find {RADIUS}")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sound = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)")
    good = rows.filter("vec_id IS NOT NULL").filter(sound).groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    good = stored(good, "vectors")
    classes = stored(good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).withColumn("size", F.size("embedding")), "vector-classes")
    counts, edges = links(classes, cosine, sample)
    of = connected_components(edges)
    linked = classes.join(counts, "vec_id", "left").join(of, F.col("vec_id") == of["node"], "left")
    n_links = F.coalesce("n_links", F.lit(0).cast("long")) + F.col("n") - 1  # its equals, too
    named = linked.select(F.col("vec_id").alias("first"), n_links.alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    own = good.join(classes.filter("n > 1").select("embedding", F.col("vec_id").alias("first")), "embedding", "left").select("vec_id", F.coalesce("first", "vec_id").alias("first"))
    told = stored(stored(own, "vector-firsts").join(named, "first").select("vec_id", "n_links", "component_id"), "told")
    out = rows.select("vec_id").join(told, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def digest(vectors: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    return near_duplicates(vectors)


#: All pairs, as SQL can do for the small table.
ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s AS a JOIN s AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

"""Linking rows that share a key, without pairs of all rows of a key and without one task per key;
and the connected components of the links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def block_pairs(rows: DataFrame, key: str, member: str, payload: list[str], block: int) -> DataFrame:
    """Rows (key, p, q, members) whose members hold every pair of rows with equal ``key`` once.

    A key's rows are split by hash into blocks of about ``block``; ``members`` are the rows of the
    blocks p and q, with ``side`` the own block, so no row holds more than two blocks. If p < q, only
    pairs across the two blocks are meant, else pairs inside. ``rows`` should be a scan of a stored
    table, so that a key with many rows is split in the join with the counts.
    """
    counts = stored(rows.groupBy(key).agg(F.count("*").alias("__n")).filter("__n >= 2"), "key-counts")
    split = rows.join(counts, key).withColumn("__k", F.ceil(F.col("__n") / block).cast("int"))
    split = split.withColumn("side", F.pmod(F.xxhash64(member, F.lit("block")), "__k").cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("__k") - 1), lambda j: F.struct(F.least("side", j).alias("p"), F.greatest("side", j).alias("q")))
    split = split.withColumn("__pq", F.explode(each))
    return split.groupBy(key, F.col("__pq.p").alias("p"), F.col("__pq.q").alias("q")).agg(F.collect_list(F.struct("side", *payload)).alias("members")).filter(F.size("members") >= 2)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    out, seen = [], np.zeros(len(links), bool)
    for root in np.flatnonzero(links.any(axis=1)).tolist():
        if not seen[root]:
            seen[root], todo = True, [root]
            while todo:
                at = todo.pop()
                new = np.flatnonzero(links[at] & ~seen).tolist()
                seen[new] = True
                out.extend((at, x) for x in new)
                todo.extend(new)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """Stored (node, component) for all nodes but the least of each component of edges (a, b).

    Alternating stars: every node's larger neighbours are tied to its least neighbour, then its
    smaller ones, until only stars around the least nodes are left. The least neighbours are stored
    before they are joined, so a hub's edges are split over tasks. Nothing reaches the driver but
    the number of edges and a checksum.
    """

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    stars = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    now = state(stars)
    while now[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, now = now, state(stars)
        if now == last:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))

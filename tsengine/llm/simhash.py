"""SimHash near-dedup with pigeonring filtering.

Equal fingerprints are one row. A fingerprint is a ring of 4 segments of 16 bits. If two
fingerprints differ in at most 3 bits, then some segment starts a chain around the ring whose first
l segments together differ in at most l * 3/4 bits, for every l: 0, 1, 2, 3. So the first segment is
equal, and at least one half of the second. These 24 bits are the key under which fingerprints
meet (8 keys each); inside a key the chain's budgets prune pairs before the full distance counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, apart, bit_array, in_bits, stored, text_slices
from .groups import block_pairs, connected_components, forest

SEGMENTS, BITS = 4, 16
SEED = 42
BLOCK = 512
BITS_SENT = 1 << 27  # 16 MiB: more copies than it can tell apart cost a shuffle, never results


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits: each is set if over half the hashes of the word shingles have it. No words: 0."""
    w = (text or "").encode().lower().split()  # bytes: A-Z alone change, and 0x20 and 0x09-0x0D split
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text") -> DataFrame:
    """Stored (doc_id, fingerprint as a signed long, key: a hash of doc_id and text) of all rows. Very
    long texts are read whole, each by one task."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text):
                h = np.asarray([fingerprint(x, words) for x in part.column(text).to_pylist()], U64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(h.view(np.int64)), part.column("__key")], ["doc_id", "fingerprint", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias(text), _key(text).alias("__key"))
    return stored(rows.mapInArrow(run, "doc_id LONG, fingerprint LONG, key LONG"), "fingerprints")


def _key(text: str = "text"):
    return F.xxhash64(F.col("doc_id").cast("long"), F.col(f"`{text}`"))


def ring_keys(fingerprint: str = "fingerprint"):
    """Keys of a fingerprint: number, an equal segment and an equal half of the next one."""
    part = lambda at, bits: F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    keys = []
    for i in range(SEGMENTS):
        for half in range(2):
            after = (i + 1) % SEGMENTS * BITS + half * BITS // 2
            keys.append(F.lit((2 * i + half) << (BITS * 3 // 2)).cast("long") + part(i * BITS, BITS) * (1 << (BITS // 2)) + part(after, BITS // 2))
    return F.array(*keys)


def chain_links(a: np.ndarray, b: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Pairs within ``distance`` whose chain from segment ``start`` keeps its budgets."""
    x = a[:, None] ^ b[None, :]
    total, ok = np.zeros(x.shape, np.uint8), np.ones(x.shape, bool)
    for step in range(SEGMENTS):
        part = (x >> U64((start + step) % SEGMENTS * BITS)) & U64((1 << BITS) - 1)
        total += np.bitwise_count(part)
        ok &= total * SEGMENTS <= (step + 1) * distance
        if not ok.any():
            break
    return ok  # the last budget is the distance itself


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of all rows: the least doc_id reachable over links.

    Fingerprints link at ``distance`` (at most 3) or fewer differing bits, those of empty and null
    texts (0) like any other. Every row has a result, repeated rows too; rows without a doc_id get
    the component of their fingerprint, null if no row with a doc_id has it. Other columns are
    ignored. An empty table gives an empty result.
    """
    return _near(docs, words, distance, text).drop("key")


def _near(docs: DataFrame, words: int, distance: int, text: str = "text") -> DataFrame:
    if not 0 <= distance < SEGMENTS:
        raise ValueError(f"the ring of {SEGMENTS} segments finds distances up to {SEGMENTS - 1}")
    rows = fingerprints(docs, words, text)
    classes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).filter("first IS NOT NULL"), "fingerprint-classes")
    keyed = classes.withColumn("key", F.explode(ring_keys()))

    def link(batches):
        for batch in batches:
            out = []
            for key, p, q, members in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                start = key >> (BITS * 3 // 2 + 1)
                first = np.asarray([m["first"] for m in members], np.int64)
                f = np.asarray([m["fingerprint"] for m in members], np.int64).view(U64)
                side = np.asarray([m["side"] for m in members])
                if p == q:
                    links = chain_links(f, f, start, distance)
                else:
                    links, a, b = np.zeros((len(f), len(f)), bool), np.flatnonzero(side == p), np.flatnonzero(side == q)
                    links[np.ix_(a, b)] = chain_links(f[a], f[b], start, distance)
                    links |= links.T
                np.fill_diagonal(links, False)
                out += [(first[i], first[j]) for i, j in forest(links)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])

    groups = block_pairs(keyed, "key", "fingerprint", ["fingerprint", "first"], BLOCK)
    found = connected_components(groups.mapInArrow(link, "a LONG, b LONG"))
    named = stored(classes.join(found, classes["first"] == found["node"], "left").select("fingerprint", F.coalesce("component", "first").alias("component_id")), "components")
    return rows.join(named, "fingerprint", "left").select("doc_id", "fingerprint", "component_id", "key")


def dedup(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one document of each component: that of the least doc_id.

    Rows that are equal in doc_id and text are one document and stay once (of rows that differ in other
    columns, the one whose columns have the least hash). Rows that share a doc_id but not the text are
    judged each by its own component, so none is lost for another's sake. Rows without a doc_id stay,
    and so do empty and null texts as one document like any other. All columns pass.

    Only rows that may go (a bit array of fixed size tells) are shuffled; the others pass as they are.
    """
    spark = docs.sparkSession
    docs, back = apart(docs, "__key", "__of", "__doc", "__n")
    names = docs.columns
    near = _near(docs, words, distance).filter("doc_id IS NOT NULL")
    told = stored(near.groupBy("doc_id", "key").agg(F.count("*").alias("__n"), F.max(F.col("doc_id") == F.col("component_id")).alias("first")), "documents-told")
    doubtful = told.filter("NOT first OR __n > 1")
    bits = spark.sparkContext.broadcast(bit_array(doubtful.select(F.col("key").alias("h")), BITS_SENT))
    keyed = docs.select("*", _key().alias("__key"))

    def parted(doubt):
        def run(batches):
            for batch in batches:
                found = in_bits(bits.value, batch.column(len(names)).to_numpy())
                yield batch.filter(pa.array(found if doubt else ~found))

        return keyed.mapInArrow(run, keyed.schema)

    sure = parted(False).drop("__key")
    kept = told.filter("first").select(F.col("key").alias("__of"), F.col("doc_id").alias("__doc"), "__n")
    some = parted(True)
    some = some.join(kept, (some["__key"] == kept["__of"]) & (some["doc_id"].cast("long") == kept["__doc"]))
    columns = [F.col(f"`{c}`") for c in names]
    once = some.filter("__n = 1").select(*columns)
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    several = some.filter("__n > 1").groupBy("__doc", "__key").agg(F.min_by(F.struct(*columns), hashed).alias("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
    nameless = docs.filter("doc_id IS NULL")
    return back(sure.filter("doc_id IS NOT NULL").unionByName(once).unionByName(several).unionByName(nameless))


def digest(docs: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    out = near_duplicates(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")

"""Line dedup: lines that many documents share are dropped from every document.

The distinct line hashes that reach the document threshold are indexed by a sharded minimal
perfect hash: every shard has a seed per small bucket of hashes, which sends each hash to a slot of
its own in arrays of fingerprints and counts. Documents probe these arrays; their lines are never
shuffled or joined. Shards are broadcast in groups of at most ``group_bytes``, each group in a pass
of its own, so memory is bounded whatever the number of lines.

A slot also answers strangers, so it holds 64 fingerprint bits independent of the bits that choose
the slot: a line outside the index passes with probability 2**-64.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, mix, stored, text_slices, with_columns

BLANK = b" \t\n\x0b\x0c\r"
SHARD_KEYS, BUCKET_KEYS = 4096, 2
CHAIN = 4  # groups of shards that one stage holds at a time
INDEX = "shard INT, n INT, seeds BINARY, prints BINARY, counts BINARY"


def line_keys(text: bytes) -> list[bytes]:
    """Key of every line: stripped of ASCII white space, A-Z in lower case."""
    return [line.strip(BLANK).lower() for line in text.split(b"\n")]


def _hashes(keys) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(U64).reshape(-1, 2)


def _bucket(h: np.ndarray, buckets) -> np.ndarray:
    return (mix(h[:, 0] ^ mix(h[:, 1])) % buckets).astype(np.int64)


def _slot(h: np.ndarray, seed, n) -> np.ndarray:
    return (mix(h[:, 0] + mix(h[:, 1] ^ (np.asarray(seed).astype(U64) * U64(0x9E3779B97F4A7C15)))) % n).astype(np.int64)


def build_shard(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds, fingerprints and counts of one shard of distinct hashes ``h`` (n x 2).

    Large buckets first, each takes the first seed that sends its hashes to free slots of their
    own; buckets of one hash take a free slot directly, written as ``-1 - slot``.
    """
    n = len(h)
    buckets = -(-n // BUCKET_KEYS)
    of = _bucket(h, U64(buckets))
    seeds, free = np.zeros(buckets, np.int64), np.ones(n, bool)
    slots = np.empty(n, np.int64)
    order = np.argsort(of, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
    parts.sort(key=len, reverse=True)
    for part in parts:
        if len(part) == 1:
            break
        seed = 0
        while True:
            at = _slot(h[part], np.full(len(part), seed), U64(n))
            if free[at].all() and len(set(at.tolist())) == len(at):
                break
            seed += 1
        free[at] = False
        slots[part], seeds[of[part[0]]] = at, seed
    alone = [p[0] for p in parts if len(p) == 1]
    spare = np.flatnonzero(free)
    slots[alone] = spare
    seeds[of[alone]] = -1 - spare
    prints, numbers = np.empty(n, U64), np.empty(n, np.int64)
    prints[slots], numbers[slots] = h[:, 1], counts
    return seeds, prints, numbers


def line_index(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """Stored arrays of the minimal perfect hash over lines found in ``min_docs`` rows or more."""

    def count(batches):
        for batch in batches:
            found: dict[bytes, int] = {}
            for part in text_slices(batch, text):
                for value in part.column(text).to_pylist():
                    for key in set(line_keys((value or "").encode())):
                        if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                            found[d] = found.get(d := xxhash.xxh3_128_digest(key), 0) + 1
            h = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(found.values()), pa.int64())], ["h1", "h2", "n"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf[["h1", "h2"]].to_numpy(np.int64).view(U64)
        seeds, prints, numbers = build_shard(h, pdf["n"].to_numpy())
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n": [len(h)], "seeds": [seeds.tobytes()], "prints": [prints.tobytes()], "counts": [numbers.tobytes()]})

    lines = docs.select(F.col(f"`{text}`").alias(text)).mapInArrow(count, "h1 LONG, h2 LONG, n LONG")
    lines = stored(lines.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs), "lines")
    shards = -(-lines.count() // SHARD_KEYS) or 1
    return stored(lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, INDEX), "line-index").withColumn("shards", F.lit(shards))


class Probe:
    """A group of shards, joined into flat arrays for vectorised look-ups."""

    def __init__(self, rows, shards: int):
        self.shards = shards
        self.keys, self.seed_at, self.slot_at = (np.zeros(shards, np.int64) for _ in range(3))
        seeds, prints, counts, at, to = [], [], [], 0, 0
        for r in rows:
            self.keys[r.shard], self.seed_at[r.shard], self.slot_at[r.shard] = r.n, at, to
            seeds.append(np.frombuffer(r.seeds, np.int64))
            prints.append(np.frombuffer(r.prints, U64))
            counts.append(np.frombuffer(r.counts, np.int64))
            at, to = at + len(seeds[-1]), to + r.n
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.seeds, self.prints, self.counts = join(seeds, np.int64), join(prints, U64), join(counts, np.int64)

    def count(self, h: np.ndarray) -> np.ndarray:
        """Documents with each line; 0 for lines outside this group."""
        out = np.zeros(len(h), np.int64)
        shard = (h[:, 0].view(np.int64) % self.shards).astype(np.int64)
        here = np.flatnonzero(self.keys[shard] > 0)
        if len(here):
            h, shard = h[here], shard[here]
            n = self.keys[shard].astype(U64)
            seed = self.seeds[self.seed_at[shard] + _bucket(h, (n + U64(BUCKET_KEYS - 1)) // U64(BUCKET_KEYS))]
            at = self.slot_at[shard] + np.where(seed < 0, -1 - seed, _slot(h, np.maximum(seed, 0), n))
            out[here] = np.where(self.prints[at] == h[:, 1], self.counts[at], 0)
        return out


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", group_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with shared lines removed from ``text``, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys
    of at least ``min_chars`` code points (and never the empty key) that at least ``min_docs`` rows
    hold lose all their lines. Each row counts as one document, also when rows are repeated. A null
    or empty text is one empty line and comes back empty. Other columns pass unchanged; columns
    named ``n_lines`` or ``n_dropped`` are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    index = line_index(docs, min_docs, min_chars, text)
    sizes = index.select("shard", "shards", (F.length("seeds") + F.length("prints") + F.length("counts")).alias("b")).orderBy("shard").collect()
    groups, total = [[]], 0
    for r in sizes:  # a few numbers for each 4096 indexed lines
        if groups[-1] and total + r.b > group_bytes:
            groups.append([])
            total = 0
        groups[-1].append(r.shard)
        total += r.b
    shards = sizes[0].shards if sizes else 1
    out = with_columns(docs, n_lines=F.lit(0).cast("long"), n_dropped=F.lit(0).cast("long"), __gone=F.lit(b""))
    names = out.columns

    def probe(group, last):
        rows = index.filter(F.col("shard").between(group[0], group[-1])).collect() if group else []  # at most group_bytes
        shared = spark.sparkContext.broadcast(Probe(rows, shards))

        def run(batches):
            arrays = shared.value
            for batch in batches:
                for part in text_slices(batch, text):
                    texts = [(x or "").encode() for x in part.column(text).to_pylist()]
                    gone = part.column("__gone").to_pylist()
                    keys = [line_keys(t) for t in texts]
                    flat = [k for ks in keys for k in ks]
                    hit = arrays.count(_hashes(flat)) >= min_docs
                    ends = np.cumsum([len(k) for k in keys])
                    flags = [hit[e - len(k) : e] | np.frombuffer(g or bytes(len(k)), bool) for k, e, g in zip(keys, ends, gone, strict=True)]
                    new = {"__gone": pa.array([f.tobytes() for f in flags], pa.binary())}
                    if last:
                        kept = [b"\n".join(x for x, f in zip(t.split(b"\n"), fs, strict=True) if not f) if fs.any() else t for t, fs in zip(texts, flags.copy(), strict=True)]
                        new |= {text: pa.array([k.decode() for k in kept], pa.string()), "n_lines": pa.array([len(f) for f in flags], pa.int64()), "n_dropped": pa.array([int(f.sum()) for f in flags], pa.int64()), "__gone": pa.nulls(len(part), pa.binary())}
                    yield pa.RecordBatch.from_arrays([new.get(n, part.column(i)) for i, n in enumerate(names)], names)

        return run

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
    for i, group in enumerate(groups):
        out = out.mapInArrow(probe(group, i == len(groups) - 1), schema)
        if i % CHAIN == CHAIN - 1 and i < len(groups) - 1:
            out = stored(out, "line-passes")
    return out.drop("__gone")


def digest(docs: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM (SELECT DISTINCT r, key FROM k WHERE key <> '') GROUP BY key HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id
"""

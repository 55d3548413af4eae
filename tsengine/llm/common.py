"""Helpers shared by the operators: stored intermediate tables and hashing in numpy."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.session import scratch_path

U64 = np.uint64


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> None:
    """Python workers import this package by its name. Where neither PYTHONPATH nor the working folder
    shows it to them (as after ``sys.path.insert`` alone), it goes along with the session's jobs, once."""
    sc = spark.sparkContext
    shown = {os.path.realpath(p) for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd())}
    if os.path.realpath(ROOT) in shown or getattr(sc, "_tsengine_sent", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tsengine-"), "tsengine.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "tsengine")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), ROOT))
    sc.addPyFile(archive)
    sc._tsengine_sent = True


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: cuts the lineage,
    survives lost executors and gives joins a plain scan whose skewed partitions AQE can split."""
    reachable(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark, sf_dir: str, table: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_columns(df: DataFrame, **cols) -> DataFrame:
    """Set columns, replacing any of the same name (also in another case)."""
    names = {c.lower() for c in cols}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *(c.alias(n) for n, c in cols.items()))


def apart(df: DataFrame, *names: str):
    """``df`` with its columns of these names set aside under other names, and a function that takes
    a frame that kept them back to exactly the columns of ``df``."""
    other = {c: f"__own_{c}" for c in df.columns if c.lower() in {n.lower() for n in names}}
    back = lambda out: out.select(*(F.col(f"`{other.get(c, c)}`").alias(c) for c in df.columns))
    return df.withColumnsRenamed(other), back


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; nulls are empty."""
    arr = arr.cast(pa.large_string())
    arr = pc.fill_null(arr, "") if arr.null_count else arr
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(sizes: np.ndarray, limit: int):
    """Consecutive row ranges of at most ``limit`` in sum, or of one larger row."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """The batch in parts of at most ``limit`` bytes of text, so that working arrays stay small."""
    _, offsets = utf8(batch.column(column))
    for a, b in slices(np.diff(offsets), limit):
        yield batch.slice(a, b - a)


def bit_array(hashes: DataFrame, bits: int = 1 << 23) -> np.ndarray:
    """A bit array of fixed size (bits / 8 bytes, also when it is sent) with the bit of every value
    of the long column ``h`` set. It can tell that a value is missing, never that it is there."""
    at = F.pmod(F.col("h"), F.lit(bits))
    rows = hashes.select(F.floor(at / 32768).cast("int").alias("part"), (at % 32768 + 1).alias("at")).repartition("part")
    parts = rows.groupBy("part").agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # at most bits / 32768 rows of 4 KB
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bitmap, np.uint8)
    return out


def in_bits(array: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.view(np.int64) % (len(array) * 8)
    return (array[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

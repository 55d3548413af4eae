"""Token counts through a digest cache: texts whose normalised content was counted before, by the same
version of a tokenizer, are looked up; only distinct new contents are encoded, and their counts are
appended to the cache.

*Digests.* A content is the SHA-256 of the text as the tokenizer's normaliser leaves it (of the text
itself where it has none). A tokenizer version is the SHA-256 of its file and the library's version.
*Cache.* A folder of Parquet files, one subfolder per tokenizer version, rows (content, n_tokens).
Appends are committed by Spark as a whole; a content that two jobs appended counts once.
*Misses.* One narrow count per content, joined with the cache, tells what is missing. The texts are
then read again: a text that occurs once is encoded where it was read. Only texts that may occur
several times (a bit array of fixed size tells) go through a shuffle, which leaves one of each.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.session import scratch_path

from .common import bit_array, in_bits, stored, text_slices

CACHE_SETTING = "spark.tsengine.tokenCounts.cache"
CACHED = "content BINARY, n_tokens LONG"
#: Contents that hold more than this part of all rows get their counts by a broadcast of at most
#: this many rows; the others by a shuffled join.
HOT = 1000


class Tokenizer:
    """A tokenizer file: ``.json`` for tokenizers, ``.model`` for sentencepiece."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.words, library = None, f"sentencepiece {sentencepiece.__version__}"
            self.normalises = True
        else:
            import tokenizers

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.words, library = tokenizers.Tokenizer.from_str(data.decode()), f"tokenizers {tokenizers.__version__}"
            self.words.no_truncation()
            self.words.no_padding()
            self.normalises = self.words.normalizer is not None
            added = {t.content for t in self.words.get_added_tokens_decoder().values()}
            self.added = added | {self.words.normalizer.normalize_str(t) for t in added} if self.normalises else added
        self.version = hashlib.sha256(library.encode() + b"\0" + data).hexdigest()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the library gives them, without begin, end or added special tokens."""
        if self.words is None:
            return [len(ids) for ids in self.pieces.encode(texts, num_threads=1)]
        return [len(e) for e in self.words.encode_batch_fast(texts, add_special_tokens=False)]

    def normalised(self, text: str) -> bytes:
        """What the count depends on. Added tokens are found before normalising, so a text that holds
        one (or would after normalising) stands for itself alone."""
        if self.words is None:
            return b"n" + self.pieces.normalize(text).encode()
        plain = self.words.normalizer.normalize_str(text) if self.normalises else text
        if any(t in text or t in plain for t in self.added):
            return b"t" + text.encode()
        return b"n" + plain.encode()


_open: dict[str, Tokenizer] = {}


def opened(path: str, version: str | None = None) -> Tokenizer:
    """The process's own tokenizer; with ``version``, refused if this machine has another one."""
    if path not in _open:
        _open[path] = Tokenizer(path)
    if version and _open[path].version != version:
        raise RuntimeError(f"{path} or its library differs from the driver's")
    return _open[path]


def with_content(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text, content, h): the digest of each normalised text, and a long hash of it."""
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    opener = opened(tokenizer)
    if not opener.normalises:
        keyed = own.withColumn("content", F.unhex(F.sha2("text", 256)))
    else:
        version = opener.version

        def digest(batches):
            tok = opened(tokenizer, version)
            for batch in batches:
                for part in text_slices(batch, "text"):
                    content = [hashlib.sha256(tok.normalised(t)).digest() for t in part.column("text").to_pylist()]
                    yield part.append_column("content", pa.array(content, pa.binary()))

        keyed = own.mapInArrow(digest, T.StructType([*own.schema.fields, T.StructField("content", T.BinaryType())]))
    return keyed.withColumn("h", F.xxhash64("content"))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The cache's rows (content, n_tokens) of a tokenizer version, each content once."""
    path = f"{cache.rstrip('/')}/tokenizer={version}"
    if not exists(spark, path):
        return spark.createDataFrame([], CACHED)
    return spark.read.schema(CACHED).parquet(path).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(keyed: DataFrame, wanted: DataFrame, missing: DataFrame | None, tokenizer: str) -> DataFrame:
    """Rows (content, n_tokens) for every distinct content of ``missing`` (None: of ``wanted``).

    ``wanted`` has the number of copies of each content. Both bit arrays may take a content for
    repeated or missing that isn't, never the other way round; the exact checks follow.
    """
    sc, version = keyed.sparkSession.sparkContext, opened(tokenizer).version
    h = F.xxhash64("content").alias("h")
    repeated = sc.broadcast(bit_array(wanted.filter("copies > 1").select(h)))
    absent = sc.broadcast(None if missing is None else bit_array(missing.select(h)))

    def first(batches):
        tok = opened(tokenizer, version)
        for batch in batches:
            if absent.value is not None:
                batch = batch.filter(pa.array(in_bits(absent.value, batch.column("h").to_numpy())))
            for part in text_slices(batch, "text"):
                later = in_bits(repeated.value, part.column("h").to_numpy())
                texts = part.column("text")
                n = np.zeros(len(later), np.int64)
                n[~later] = tok.counts(texts.filter(pa.array(~later)).to_pylist())
                kept = pa.array([t if w else None for t, w in zip(texts.to_pylist(), later, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("content"), kept, pa.array(n, mask=later)], ["content", "text", "n_tokens"])

    def second(batches):
        tok = opened(tokenizer, version)
        for batch in batches:
            for part in text_slices(batch, "text"):
                n = part.column("n_tokens").to_numpy(zero_copy_only=False).copy()
                open_ = np.asarray(part.column("n_tokens").is_null())
                n[open_] = tok.counts(part.column("text").filter(pa.array(open_)).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(n.astype(np.int64))], ["content", "n_tokens"])

    found = keyed.select("content", "text", "h").mapInArrow(first, "content BINARY, text STRING, n_tokens LONG").dropDuplicates(["content"])
    if missing is not None:
        found = found.join(missing.select("content"), "content", "left_semi")
    return found.mapInArrow(second, CACHED)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit; new counts are appended to ``cache``.

    Null texts are empty and have no tokens. Repeated rows and null doc_ids have a row each; equal
    texts are encoded once. No other column of ``docs`` is read. Very long texts are encoded whole,
    one at a time. An empty table gives an empty result and appends nothing. ``tokenizer`` is a path
    that every machine can read, ``cache`` a folder in shared storage.
    """
    spark = docs.sparkSession
    version = opened(tokenizer).version
    keyed = with_content(docs, tokenizer)
    digests = stored(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "token-digests")
    wanted = stored(digests.groupBy("content").agg(F.count("*").alias("copies")), "token-contents")
    place = f"{cache.rstrip('/')}/tokenizer={version}"
    missing = stored(wanted.join(cached(spark, cache, version), "content", "left_anti"), "token-misses") if exists(spark, place) else None
    if (wanted if missing is None else missing).head(1):
        encode_misses(keyed, wanted, missing, tokenizer).write.mode("append").parquet(place)
    known = cached(spark, cache, version)
    rows = wanted.agg(F.sum("copies")).head()[0] or 0
    hot = wanted.filter(F.col("copies") * HOT > rows).filter("copies > 1").select("content")  # fewer than HOT rows
    hot = F.broadcast(stored(known.join(F.broadcast(hot), "content"), "token-hot"))
    usual = digests.join(hot.select("content"), "content", "left_anti").join(known, "content", "left")
    out = digests.join(hot, "content").unionByName(usual)
    n = F.coalesce("n_tokens", F.raise_error(F.lit("a content is missing in the token cache")).cast("long"))
    return out.select("doc_id", "n_bytes", n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def digest(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """The contract's columns. The cache is the folder that the session names (``CACHE_SETTING``), so
    that it serves the next job too; without that setting it starts empty, in the checkpoint folder."""
    spark = docs.sparkSession
    return count_tokens(docs, tokenizer, spark.conf.get(CACHE_SETTING, None) or scratch_path(spark, "token-cache"), limit)

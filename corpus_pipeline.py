"""Corpus pipeline: documents lose toxic texts, shared lines, near copies and benchmark passages, and
are packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. Tables beside the documents are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm import decontaminate, line_dedup, packing, simhash, toxicity
from tsengine.llm.common import apart, read, stored
from tsengine.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labels, doesn't call toxic.

    Null and empty texts have no matches and stay; repeated rows are judged alike; of several labels of a
    document a toxic one counts, and null labels or doc_ids none. Without labels the seed words stand.
    Columns named ``score`` or ``predicted`` keep their values. An empty table stays empty.
    """
    grammar = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    own, back = apart(docs, "score", "predicted")
    return back(toxicity.score_documents(own, grammar).filter("predicted = 0"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; ``n_chars`` follows the text.

    A null text comes back empty. Repeated rows count as a document each, so ten of them lose their
    lines; all lines of one key go, so ties need no order. No document is dropped, also if no line is
    left. Columns named ``n_lines`` or ``n_dropped`` keep their values. An empty table stays empty.
    """
    own, back = apart(docs, "n_lines", "n_dropped")
    out = back(line_dedup.dedup_lines(own))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints within 3 bits: that of the least doc_id.

    Rows equal in doc_id and text stay once; different texts under one doc_id are judged each by itself.
    Null and empty texts are one text like any other. Rows without a doc_id stay. All columns keep their
    values, whatever their names. An empty table stays empty.
    """
    return simhash.dedup(docs, words=3, distance=3).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts hold no window and stay; so does everything if the benchmark is empty or has
    no words. Repeated rows are judged alike, repeated items and items without an item_id count like any
    other. All columns keep their values. An empty table stays empty.
    """
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, by sequence and offset.

    Null and empty texts are one piece of the end id alone. Repeated rows and rows without a doc_id are
    packed each; pieces of one length are interchangeable, so ties need no order. An empty table gives
    no pieces.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL has no finite-state grammar, fingerprints of XXH64 or tokenizer; tests/llm compares each stage
#: with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = stored(docs, name)
    return docs

"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, embedding_dedup, hard_negatives, html_extract, line_dedup, packing, secret_scan, simhash, substring_dedup, token_alignment, token_counts, toxicity
from .common import read

TOKENIZER, COUNTED, ALIGNED = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(read(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.digest(read(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_toxicity(spark, sf_dir):
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.digest(read(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    return chat_format.digest(read(spark, sf_dir, "conversations"))


def op8_html_extract(spark, sf_dir):
    return html_extract.digest(read(spark, sf_dir, "pages"))


def op9_secret_scan(spark, sf_dir):
    return secret_scan.digest(read(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark, sf_dir):
    return embedding_dedup.digest(read(spark, sf_dir, "embeddings"))


def op11_token_counts(spark, sf_dir):
    return token_counts.digest(read(spark, sf_dir, "documents"), tokenizer_path(COUNTED))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.digest(read(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark, sf_dir):
    return token_alignment.digest(read(spark, sf_dir, "documents"), tokenizer_path(COUNTED), tokenizer_path(ALIGNED))


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_simhash, op3_packing, op4_toxicity, op5_decontamination, op6_line_dedup, op7_chat_format, op8_html_extract, op9_secret_scan, op10_embedding_dedup, op11_token_counts, op12_hard_negatives, op13_token_alignment)
}

#: SimHash, packing, toxicity, token counts and alignment are tested against brute force, the tokenizers
#: and held-out labels instead.
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_chat_format": chat_format.ORACLE,
    "op8_html_extract": html_extract.ORACLE,
    "op9_secret_scan": secret_scan.ORACLE,
    "op10_embedding_dedup": embedding_dedup.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}

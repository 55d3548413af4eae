import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tsengine.llm import token_counts
from tsengine.session import scratch_path

BYTES, WORDS, PIECES = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id LONG, text STRING, n_tokens STRING, content INT, H INT"


LIBRARY = {PIECES: sentencepiece.SentencePieceProcessor(model_file=PIECES)} | {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def plain(path, text):
    if path == PIECES:
        return len(LIBRARY[path].encode(text or ""))
    return len(LIBRARY[path].encode(text or "", add_special_tokens=False).ids)


def texts():
    r = random.Random(3)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<s>", "▁", "  ", "\n", "\x00", "don't", "É", "é", "한", "😀", "ﬁ", "word", "WORD", " the", "123", "x" * 50]
    return ["".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(300)]


def counted(docs, path, cache, **kw):
    return sorted(token_counts.count_tokens(docs, path, cache, **kw).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_bytes))


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_counts_equal_the_librarys(spark, small, path):
    rows = [(i, t, "own", 1, 2) for i, t in enumerate([*texts(), None, "", "long text " * 50_000])]
    got = counted(small(rows, SCHEMA), path, scratch_path(spark, "cache"), limit=3)
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == [(i, len((t or "").encode()), plain(path, t)) for i, t, *_ in rows]
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)


def cache_rows(spark, cache, path):
    return spark.read.parquet(f"{cache}/tokenizer={token_counts.opened(path).version}")


def test_only_distinct_misses_are_encoded_and_appended(spark, small, monkeypatch):
    cache = scratch_path(spark, "cache")
    rows = [(i, "one text" if i % 3 else f"text {i % 10}", "", 0, 0) for i in range(200)]
    first = counted(small(rows, SCHEMA), BYTES, cache)
    table = cache_rows(spark, cache, BYTES)
    distinct = {t for _, t, *_ in rows}
    assert table.count() == len(distinct)

    encoded = []
    inner = token_counts.encode_misses
    monkeypatch.setattr(token_counts, "encode_misses", lambda *a: encoded.append(inner(*a)) or encoded[-1])
    assert counted(small(rows, SCHEMA), BYTES, cache) == first
    assert not encoded  # all known: nothing is encoded or appended
    more = rows + [(1000, "new", "", 0, 0), (1001, "new", "", 0, 0), (1002, "newer", "", 0, 0)]
    got = counted(small(more, SCHEMA), BYTES, cache)
    assert got[: len(rows)] == first and [r.n_tokens for r in got[len(rows) :]] == [plain(BYTES, t) for t in ("new", "new", "newer")]
    assert encoded[0].count() == 2
    assert cache_rows(spark, cache, BYTES).count() == len(distinct) + 2


def test_stored_counts_are_what_is_returned(spark, small):
    cache = scratch_path(spark, "cache")
    docs = small([(1, "some words", "", 0, 0), (2, "other words", "", 0, 0)], SCHEMA)
    counted(docs, BYTES, cache)
    known = token_counts.cached(spark, cache, token_counts.opened(BYTES).version)
    # a second job appended the same contents: they still count once
    spark.createDataFrame(known.collect(), known.schema).write.mode("append").parquet(f"{cache}/tokenizer={token_counts.opened(BYTES).version}")
    assert [r.n_tokens for r in counted(docs, BYTES, cache)] == [plain(BYTES, "some words"), plain(BYTES, "other words")]


def test_tokenizer_versions_have_their_own_counts(spark, small):
    cache = scratch_path(spark, "cache")
    docs = small([(1, "Straße und mehr", "", 0, 0)], SCHEMA)
    for path in (BYTES, WORDS, PIECES):
        assert counted(docs, path, cache)[0].n_tokens == plain(path, "Straße und mehr")
        assert cache_rows(spark, cache, path).count() == 1


def test_normalised_contents_share_a_count_but_not_added_tokens(spark, small):
    cache = scratch_path(spark, "cache")
    rows = [(1, "Same  WORDS", "", 0, 0), (2, "same words", "", 0, 0), (3, "a<|endoftext|>b", "", 0, 0), (4, "a<|ENDOFTEXT|>b", "", 0, 0)]
    got = counted(small(rows, SCHEMA), WORDS, cache)
    assert [r.n_tokens for r in got] == [plain(WORDS, t) for _, t, *_ in rows]
    assert got[2].n_tokens != got[3].n_tokens
    assert cache_rows(spark, cache, WORDS).count() == 3


def test_repeated_rows_null_ids_and_empty_table(spark, small):
    rows = [(1, "a b", "", 0, 0)] * 4 + [(None, "a b", "", 0, 0), (None, None, "", 0, 0)]
    got = counted(small(rows, SCHEMA), BYTES, scratch_path(spark, "cache"))
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 2)] * 4 + [(None, 0), (None, 2)]
    cache = scratch_path(spark, "cache")
    assert counted(small([], SCHEMA), BYTES, cache) == [] and not token_counts.exists(spark, cache)


def test_query_reads_the_sessions_cache(spark, small):
    cache = scratch_path(spark, "cache")
    spark.conf.set(token_counts.CACHE_SETTING, cache)
    try:
        token_counts.digest(small([(1, "a b", "", 0, 0)], SCHEMA), BYTES).collect()
    finally:
        spark.conf.unset(token_counts.CACHE_SETTING)
    assert cache_rows(spark, cache, BYTES).count() == 1

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tsengine.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def tokens(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers():
    r = random.Random(1)
    signs = [chr(i) for i in range(256)] + list("'sSdDmM llre't  \n") * 3 + ["'S", "<|endoftext|>", "œ", "Σ", "ΑΣ ", "İ", "́", "한", "😀", " "]
    ids = packing.WordIds(PATH)
    for _ in range(3000):
        text = "".join(r.choice(signs[: 256 if r.random() < 0.7 else None]) for _ in range(r.randrange(40)))
        assert np.frombuffer(ids(text), "<u4").tolist() == tokens(text), text


def test_added_tokens_have_their_own_ids(small):
    untouched = Tokenizer.from_file(PATH)
    r = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "don", "'t", "É", "e", "\u0301", "ΑΣ", "한", "😀", " ", "\n", "7"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(1000)]
    ids = packing.word_ids(PATH)
    for text in texts:
        assert np.frombuffer(ids(text), "<u4").tolist() == untouched.encode(text, add_special_tokens=False).ids, text
    rows = [(i, t) for i, t in enumerate(["one<|endoftext|>two", "<|startoftext|>", "plain"])]
    got = {x.doc_id: (x.doc_tokens, x.ids_crc32) for x in packing.pack(small(rows, "doc_id LONG, text STRING"), PATH).collect()}
    for i, text in rows:
        want = np.asarray([*untouched.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (len(want), zlib.crc32(want.tobytes()))


def check(small, rows, max_tokens):
    out = packing.pack(small(rows, "doc_id LONG, text STRING, length STRING"), PATH, max_tokens).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in out:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append(x)
    for doc, text, _ in rows:
        ids = np.asarray([*tokens(text), 1], "<u4")
        mine = [x for x in by_doc[doc] if x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())]
        assert {i for x in mine for i in range(x.start, x.start + x.length)} == set(range(len(ids)))
    assert sum(x.length for x in out) == sum(len(tokens(t)) + 1 for _, t, _ in rows)
    for pieces in by_sequence.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= max_tokens
    return sum(x.length for x in out) / (len(by_sequence) * max_tokens) if out else 1.0


def test_every_id_once_and_little_padding(small):
    r = random.Random(2)
    rows = [(d, " ".join(r.choice(["stone", "river", "antidisestablishment", "É"]) for _ in range(int(r.expovariate(1 / 60)))), "x") for d in range(400)]
    rows += [(1000 + i, rows[0][1], None) for i in range(200)]  # one length for a third of all rows
    assert check(small, rows, 64) > 0.95


def test_edges(small):
    rows = [(1, None, None), (2, "", None), (3, "   \n ", "a"), (None, "no id", None), (None, "no id", None), (4, "word " * 30_000, None)]
    check(small, rows, 2048)
    assert packing.pack(small([], "doc_id LONG, text STRING"), PATH).count() == 0


def test_plan_places_every_rank_once():
    r = random.Random(3)
    histogram = {n: r.randrange(1, 500) for n in r.sample(range(1, 2049), 300)}
    runs, sequences = packing.plan_packs(histogram, 2048)
    filled = defaultdict(int)
    ranks = defaultdict(list)
    for length, rank, count, first, offset in runs:
        ranks[length] += range(rank, rank + count)
        for s in range(first, first + count):
            assert filled[s] == offset
            filled[s] += length
    assert {k: len(v) for k, v in ranks.items()} == histogram and all(sorted(v) == list(range(len(v))) for v in ranks.values())
    assert len(filled) == sequences and max(filled.values()) <= 2048

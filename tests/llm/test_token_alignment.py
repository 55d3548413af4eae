import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tsengine.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id LONG, text STRING, pairs INT, n_links STRING, GROUPS STRING"


def token_lists():
    """(id, bytes) of each token, by each library itself."""
    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True

    def first(text):
        e = t.encode(" " + text, add_special_tokens=False)
        data, ends = (" " + text).encode(), [len((" " + text)[:0].encode())]
        # byte-level tokens, from the vocabulary's letters
        return [(i, bytes(LETTERS[c] for c in t.id_to_token(i))) for i in e.ids], data, ends

    def second(text):
        out = []
        for i in sp.encode(text):
            piece = sp.id_to_piece(i)
            out.append((i, bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()))
        return out

    return first, second


def _letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


LETTERS = _letters()


def brute(rows):
    first, second = token_lists()
    docs = []
    for doc, text, *_ in rows:
        a = first(text)[0] if text else []
        b = second(text) if text else []
        if not text or b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
            docs.append((doc, 0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]).tolist(), np.cumsum([len(x) for _, x in b]).tolist()
        where = {e: j for j, e in enumerate(ends_b)}
        links = [(i, where[e]) for i, e in enumerate(ends_a) if e in where]
        groups, i0, j0 = [], 0, 0
        for i, j in links:
            groups.append(",".join(str(x) for x, _ in a[i0 : i + 1]) + "|" + ",".join(str(x) for x, _ in b[j0 : j + 1]))
            i0, j0 = i + 1, j + 1
        docs.append((doc, len(a), len(b), groups, [(a[i][0], b[j][0]) for i, j in links]))
    counts = Counter(p for d in docs for p in d[4])
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc, n_a, n_b, groups, links in docs:
        text = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), text))
    return out


def got(docs):
    rows = ta.digest(docs, A, B).collect()
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    parts = ["<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "  ", "\n", "\t", "\x00", "\r\n", "don't", "É", "é", "한국어", "😀", "ﬁ", "　", " ", "words", " the", "123456", "x" * 30, "unbelievable", " Straße"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(400)]
    return [(i, t, 1, "x", "y") for i, t in enumerate([*texts, None, "", " ", "  ", "a", "words of a long text, " * 40_000])]


def test_equals_brute_force(small, rows):
    want = brute(rows)
    assert sorted(got(small(rows, SCHEMA)), key=key) == sorted(want, key=key)
    assert any(r[1] == 0 and t for r, (_, t, *_) in zip(want, rows, strict=True))  # some texts don't come back


def test_repeated_rows_null_ids_and_empty_table(small):
    rows = [(1, "same words", 1, "x", "y")] * 3 + [(None, "same words", 1, "x", "y"), (None, None, 1, "x", "y")]
    assert sorted(got(small(rows, SCHEMA)), key=key) == sorted(brute(rows), key=key)
    assert got(small([], SCHEMA)) == []
    assert {r[1] for r in got(small([(1, None, 1, "x", "y")], SCHEMA))} == {0}


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64])
def test_pieces_of_any_work_give_the_same_overlaps(work):
    r = np.random.default_rng(work)
    for _ in range(200):
        total = int(r.integers(1, 60))
        a, b = (np.append(np.flatnonzero(r.random(total) < r.random()), total) for _ in range(2))
        i, j, both = ta.overlaps(a, b, work)
        starts_a, starts_b = np.append(-1, a[:-1]), np.append(-1, b[:-1])
        want = {(x, y) for x in range(len(a)) for y in range(len(b)) if max(starts_a[x], starts_b[y]) < min(a[x], b[y])}
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(want)
        assert set(zip(i[both].tolist(), j[both].tolist(), strict=True)) == {(x, y) for x, y in want if a[x] == b[y]}
        assert (np.diff(i[both]) > 0).all()


def test_pieces_have_equal_work():
    r = np.random.default_rng(1)
    a, b = np.unique(r.integers(0, 10_000, 4000)), np.unique(r.integers(0, 10_000, 900))
    x, y = ta.diagonals(a, b, 100)
    steps = np.diff(x) + np.diff(y)
    assert (steps[:-1] == 100).all() and steps[-1] <= 100
    for i, j in zip(x, y, strict=True):  # all ends before a diagonal are at most those after it
        assert max([*a[:i], *b[:j]], default=-1) <= min([*a[i:], *b[j:]], default=10_001)


def test_every_link_is_a_pair_that_the_vocabularies_allow(small, rows):
    sides = ta.opened(A, B)
    assert len(sides.codes) < 10 * (len(sides.a.bytes) + sides.n_b)
    for row in ta.align(small(rows[:50], SCHEMA), A, B).collect():
        codes = sides.codes[np.asarray(row.pairs, np.int64)]
        last = [(int(g.split("|")[0].split(",")[-1]), int(g.split("|")[1].split(",")[-1])) for g in row.groups.split(";")] if row.groups else []
        assert [divmod(int(c), sides.n_b) for c in codes] == last


def sides_ids(texts):
    sides = ta.opened(A, B)
    return sides, [(ids.tolist(), n.tolist()) for ids, n in sides.ids(texts)], [(ids.tolist(), n.tolist()) for ids, n in (sides.a.ids(texts), sides.b.ids(texts))]


def test_repeated_words_are_encoded_once(monkeypatch):
    sides, seen, whole = ta.Sides(A, B), [], ta.Side.ids
    monkeypatch.setattr(ta.Side, "ids", lambda self, texts: seen.extend(map(len, texts)) or whole(self, texts))
    texts = ["some words, that come again. and again " * 200] * 20
    n_a, n_b, n_groups, *_ = ta.align_texts(sides, texts)
    assert len(set(n_a)) == len(set(n_b)) == len(set(n_groups)) == 1 and n_groups[0] > 1000
    assert sum(seen) < sum(map(len, texts)) / 10


@pytest.mark.parametrize("seed", range(4))
def test_units_have_the_ids_of_whole_texts(monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(ta, "STRETCH", r.choice([1, 7, 40, 1 << 14]))
    monkeypatch.setattr(ta, "REMEMBERED", r.choice([0, 10, 1000]))
    spaces = [" "] * 8 + ["  ", "   ", "\n", " \n", "\n ", "\t", "\x1c", "\x85", "\xa0", "\u180e", "\u200b", "\u2028", "\u3000", "▁", " ▁", "▁ ", "\x00", ""]
    parts = ["words", "don't", "'s", "'", "É", "한국어", "😀", "e\u0301", "\u0301", "123", "4", "--", "x" * 40, "<|endoftext|>", "<s>", "<unk>", "<0x41>", ".", "Straße", "\ufffd", "\U000e0001"]
    texts = ["".join(r.choice(parts if r.random() < 0.6 else spaces) if r.random() < 0.3 else r.choice(parts) + r.choice(spaces) for _ in range(r.randrange(40))) for _ in range(500)]
    sides, got, want = sides_ids([*texts, "", " ", "\n", "a"])
    assert sides.a.cuts and sides.b.cuts
    assert got == want


def test_tokenizers_whose_tokens_reach_over_spaces_read_whole_texts(tmp_path):
    import json

    from sentencepiece import sentencepiece_model_pb2

    with open(A, encoding="utf-8") as f:
        spec = json.load(f)
    for name, changed in {"added": {"added_tokens": [spec["added_tokens"][0] | {"content": "two words", "special": False}]}, "normalised": {"normalizer": {"type": "NFC"}}, "other": {"pre_tokenizer": None}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(spec | changed), encoding="utf-8")
        assert not ta.json_cuts(str(tmp_path / f"{name}.json"))
    model = sentencepiece_model_pb2.ModelProto()
    with open(B, "rb") as f:
        model.ParseFromString(f.read())
    model.pieces[1000].piece = "of▁the"
    (tmp_path / "b.model").write_bytes(model.SerializeToString())
    assert ta.json_cuts(A) and ta.model_cuts(B) and not ta.model_cuts(str(tmp_path / "b.model"))
    sides = ta.Sides(A, str(tmp_path / "b.model"))
    for (x, n), (y, m) in zip(sides.ids(["some of the words"]), (sides.a.ids(["some of the words"]), sides.b.ids(["some of the words"])), strict=True):
        assert x.tolist() == y.tolist() and n.tolist() == m.tolist()

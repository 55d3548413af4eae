"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Each text is encoded by A and B; byte offsets at which tokens end are merged. The merge is cut into
independent pieces of equal work: a binary search on a diagonal of the merge path tells how many ends
of A and of B lie before it. A piece emits its overlaps (an A token and a B token that share bytes, and
whether both end there); where an end of A closes one piece and the same end of B opens the next, the
two are stitched. Overlaps that both tokens end are links, and cut the tokens into groups.

Tokens that end together: the bytes of one are the end of the other's. So all id pairs that can
ever be linked are known from the two vocabularies, and corpus-wide counts are one array of that
fixed size, whatever the corpus. Pieces stay in the task that encoded the text: encoding costs many
times the merge, and ids and ends are larger than the text they come from.

Encoding is most of the cost, and words come again. Where both tokenizers' files show that no token
reaches over a single space between two other signs, texts are cut there, and a worker remembers the
ids that the tokenizers gave the units met of late. Other tokenizers read whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_slices
from .packing import _byte_letters

WORK = 1 << 16  # merge steps of a piece
CUT = re.compile(r" (?<=[^\s▁] )(?=[^\s▁])")  # a single space between two other signs
STRETCH = 1 << 18  # characters whose units are looked up together
TOGETHER = 64  # new units encoded as one text
REMEMBERED, HELD = 300_000, 4 << 20  # a worker forgets all beyond so many units, or ids of them
ALIGNED = "doc_id LONG, n_a LONG, n_b LONG, n_groups LONG, groups STRING, pairs ARRAY<INT>"


class Table:
    """Byte strings, or rows of ids, by number; gathered many at a time."""

    def __init__(self, strings: Sequence[bytes] = ()):
        self.size = np.asarray([len(s) for s in strings], np.int32)
        self.start = np.concatenate([[0], np.cumsum(self.size, dtype=np.int64)])[:-1]
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def gather(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size, dtype=np.int64)
        return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])


class Numbers(dict):
    """Units' numbers, in the order in which they were met; ``new`` lists those met of late."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        number = self[unit] = len(self)
        return number


def json_cuts(path: str) -> bool:
    """Whether a text's ids are those of its units, each with a space before it: byte-level words
    (of which none has a space but at its start, or is white space and other signs) and nothing else."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    words, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space", True)
    return plain and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and all(t["special"] for t in spec.get("added_tokens", ()))


def model_cuts(path: str) -> bool:
    """The same of a ``.model``: merges of the text as it is, with a space before it, and no piece
    with a space after another sign."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # it needs protobuf
        return False
    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    text, train, kind = spec.normalizer_spec, spec.trainer_spec, spec.SentencePiece
    plain = not text.precompiled_charsmap and text.add_dummy_prefix and text.escape_whitespaces and not text.remove_extra_whitespaces
    merges = train.model_type == train.BPE and train.byte_fallback and not train.treat_whitespace_as_suffix
    return plain and merges and all(p.type in (kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE) and "▁" not in p.piece.lstrip("▁") for p in spec.pieces)


def stretches(text: str) -> list[str]:
    """The text cut at the first possible place after every ``STRETCH`` characters."""
    out, at = [], 0
    while m := CUT.search(text, at + STRETCH):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


class Side:
    """A tokenizer whose tokens are byte strings: byte-level ``.json`` or ``.model``. Both read a
    text with a space before it, and the strings of special tokens as plain text."""

    def __init__(self, path: str):
        self.cuts = model_cuts(path) if path.endswith(".model") else json_cuts(path)
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.pieces, self.words = SentencePieceProcessor(model_file=path), None
            names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
            self.bytes = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.words = Tokenizer.from_file(path)
            self.words.encode_special_tokens = True
            self.words.no_truncation()
            self.words.no_padding()
            letters = {c: b for b, c in _byte_letters().items()}
            names = self.words.get_vocab()
            self.bytes = [b""] * (max(names.values()) + 1)
            for name, i in names.items():
                self.bytes[i] = bytes(map(letters.__getitem__, name))
        self.table = Table(self.bytes)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and how many each text has."""
        if self.words is None:
            ids = self.pieces.encode(texts, num_threads=1)
        else:
            ids = [e.ids for e in self.words.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), n

    def unit_ids(self, apart: list[str], inner: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All units' ids in a row, and how many each has. ``inner`` begin and end with signs at which
        texts can be cut, so many are encoded as one text; ``apart`` go one by one."""
        if inner:
            ids, _ = self.ids([" ".join(inner[i : i + TOGETHER]) for i in range(0, len(inner), TOGETHER)])
            ends = np.cumsum(self.table.size[ids], dtype=np.int64)
            stops = np.cumsum([1 + len(u.encode()) for u in inner])
            last = np.searchsorted(ends, stops)
            if last[-1] == len(ids) - 1 and np.array_equal(ends[last], stops):
                own, n = self.ids(apart)
                return np.concatenate([own, ids]), np.concatenate([n, np.diff(last, prepend=-1)])
        return self.ids(apart + inner)  # also where a sign's bytes don't come back


class Sides:
    """Two tokenizers, and the codes ``a * |B| + b`` of all id pairs that can end together, in order."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Side(a), Side(b)
        self.n_b = len(self.b.bytes)
        self.codes = np.unique(np.concatenate([self.suffixes(self.a.bytes, self.b.bytes, self.n_b, 1), self.suffixes(self.b.bytes, self.a.bytes, 1, self.n_b)]))
        self.known, self.units = Numbers(), (Table(), Table())  # units' numbers; their ids of A and of B
        self.decimals = Table([b"%d," % i for i in range(max(len(self.a.bytes), self.n_b))])

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B, all texts' ids in a row, and how many each text has."""
        if not (self.a.cuts and self.b.cuts):
            return [self.a.ids(texts), self.b.ids(texts)]
        cut = [stretches(t) for t in texts]
        owner, parts = np.repeat(np.arange(len(texts)), [len(c) for c in cut]), list(chain.from_iterable(cut))
        found: tuple[list, list] = ([], [])
        for i, j in slices(np.asarray([len(p) for p in parts], np.int64), STRETCH):
            units = [CUT.split(p) for p in parts[i:j]]
            at = self.numbers(units)
            stops = np.concatenate([[0], np.cumsum([len(u) for u in units])])
            for table, rows in zip(self.units, found, strict=True):
                sums = np.concatenate([[0], np.cumsum(table.size[at], dtype=np.int64)])
                rows.append((table.gather(at), np.diff(sums[stops])))
        out = []
        for rows in found:
            ids, n = map(np.concatenate, zip(*rows, strict=True))
            out.append((ids, np.bincount(owner, n, len(texts)).astype(np.int64)))
        return out

    def numbers(self, units: list[list[str]]) -> np.ndarray:
        """The numbers of all parts' units; new ones' ids are added to the tables. Units at the ends of
        a part may be empty or have white space there; they come first."""
        if len(self.known) > REMEMBERED or sum(len(t.flat) for t in self.units) > HELD:
            self.known, self.units = Numbers(), (Table(), Table())
        for part in units:
            self.known[part[0]], self.known[part[-1]]
        apart = len(self.known.new)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, sum(map(len, units)))
        new, self.known.new = self.known.new, []
        if new:
            for side, table in zip((self.a, self.b), self.units, strict=True):
                table.add(*side.unit_ids(new[:apart], new[apart:]))
        return at

    @staticmethod
    def suffixes(whole: list[bytes], parts: list[bytes], by_whole: int, by_part: int) -> np.ndarray:
        """Codes of pairs in which a token of ``parts`` ends a token of ``whole``."""
        named: dict[bytes, list[int]] = {}
        for i, s in enumerate(parts):
            named.setdefault(s, []).append(i)
        return np.asarray([i * by_whole + j * by_part for i, s in enumerate(whole) for at in range(len(s)) for j in named.get(s[at:], ())], np.int64)


_open: dict[tuple[str, str], Sides] = {}


def opened(a: str, b: str) -> Sides:
    if (a, b) not in _open:
        _open[a, b] = Sides(a, b)
    return _open[a, b]


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces begin, and the end: how many ends of ``a`` and ``b`` lie before every
    ``work``-th step of their merge, in which an end of ``a`` goes before the same end of ``b``."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        at = (low + high)[open_] // 2
        before = a[at] <= b[d[open_] - at - 1]
        low[open_] = np.where(before, at + 1, low[open_])
        high[open_] = np.where(before, high[open_], at)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of a piece: for each A end the B token it lies in and whether that ends there too;
    for each B end without an A end (their numbers come first) the A token it lies in."""
    in_b = np.searchsorted(b, a)
    both = np.zeros(len(a), bool)
    inside = in_b < len(b)
    both[inside] = b[in_b[inside]] == a[inside]
    alone = np.ones(len(b), bool)
    alone[in_b[both]] = False
    alone = np.flatnonzero(alone)
    return in_b, both, alone, np.searchsorted(a, b[alone])


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps (A token, B token, both end there) of two rows of ends, from pieces of equal work,
    stitched. Within a piece, those that an A end closes come first."""
    at_a, at_b = diagonals(a, b, work)
    found = []
    for i, j, i2, j2 in zip(at_a[:-1], at_b[:-1], at_a[1:], at_b[1:], strict=True):
        in_b, both, alone, in_a = merge_piece(a[i:i2], b[j:j2])
        if i2 > i and j2 < len(b) and a[i2 - 1] == b[j2]:
            both[-1] = True  # the same end of B opens the next piece
        if i and j < j2 and a[i - 1] == b[j]:
            alone, in_a = alone[1:], in_a[1:]  # the same end of A closed the last piece
        found.append((np.concatenate([np.arange(i, i2), i + in_a]), np.concatenate([j + in_b, j + alone]), np.concatenate([both, np.zeros(len(alone), bool)])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def lossless(side: Side, ids: np.ndarray, n: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts' token bytes are their wanted bytes (``at``: where each text's begin, and the end)."""
    ends = np.concatenate([[0], np.cumsum(side.table.size[ids], dtype=np.int64)])[np.concatenate([[0], np.cumsum(n)])]
    ok = np.diff(ends) == np.diff(at)
    if ok.all() and np.array_equal(side.table.gather(ids), wanted):
        return ok
    got = side.table.gather(ids[np.repeat(ok, n)])
    text = np.repeat(np.arange(len(n))[ok], np.diff(at)[ok])
    ok[text[got != wanted[np.repeat(ok, np.diff(at))]]] = False
    return ok


def render(sides: Sides, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups as ``a1,a2|b1;...`` with a mark after each, and where each group's text ends."""
    in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    place_a = np.arange(len(a)) + np.repeat(last_b - in_b + 1, in_a)
    place_b = np.arange(len(b)) + np.repeat(last_a + 1, in_b)
    ids = np.empty(len(a) + len(b), np.int32)
    ids[place_a], ids[place_b] = a, b
    out = sides.decimals.gather(ids).copy()
    marks = np.cumsum(sides.decimals.size[ids], dtype=np.int64) - 1
    out[marks[place_a[last_a]]] = ord("|")
    out[marks[place_b[last_b]]] = ord(";")
    return out, marks[place_b[last_b]]


def align_texts(sides: Sides, texts: list[str], work: int = WORK):
    """Counts of A tokens, B tokens and groups, rendered groups, and linked pairs (places in
    ``sides.codes``) of each text; all zero and empty where a text's bytes don't come back."""
    (a, n_a), (b, n_b) = sides.ids(texts)
    wanted = [b" " + t.encode() if t else b"" for t in texts]
    at = np.concatenate([[0], np.cumsum([len(w) for w in wanted])])
    whole = np.frombuffer(b"".join(wanted), np.uint8)
    empty = np.diff(at) == 0
    if empty.any():  # whatever a tokenizer makes of nothing
        (a, n_a), (b, n_b) = ((x[np.repeat(~empty, n)], np.where(empty, 0, n)) for x, n in ((a, n_a), (b, n_b)))
    ok = lossless(sides.a, a, n_a, whole, at) & lossless(sides.b, b, n_b, whole, at) & ~empty
    if not ok.all():
        (a, n_a), (b, n_b) = ((x[np.repeat(ok, n)], np.where(ok, n, 0)) for x, n in ((a, n_a), (b, n_b)))
    i, j, both = overlaps(np.cumsum(sides.a.table.size[a], dtype=np.int64), np.cumsum(sides.b.table.size[b], dtype=np.int64), work)
    last_a, last_b = i[both], j[both]
    first = np.searchsorted(last_a, np.concatenate([[0], np.cumsum(n_a)]))
    pairs = np.searchsorted(sides.codes, a[last_a].astype(np.int64) * sides.n_b + b[last_b]).astype(np.int32)
    groups = [""] * len(texts)
    if len(last_a):
        out, marks = render(sides, a, b, last_a, last_b)
        begin = 0
        for k in np.flatnonzero(ok):
            end = int(marks[first[k + 1] - 1])
            groups[k] = out[begin:end].tobytes().decode()
            begin = end + 1
    return n_a, n_b, np.diff(first), groups, pairs, first


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;...``, ids in order) and
    pairs (one place in ``Sides.codes`` for each link, in order).

    Texts that are null or empty, or whose token bytes are not a space and the text, have no tokens.
    Repeated rows and null doc_ids have a row each; no other column is read. A text is encoded and
    aligned whole in one task, in pieces of ``WORK`` steps. An empty table gives an empty result.
    """

    def work(batches):
        sides = opened(a, b)
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 18):
                texts = part.column("text").to_pylist()
                n_a, n_b, n_groups, groups, pairs, first = align_texts(sides, texts)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(pairs))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(groups, pa.string()), lists], ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(work, ALIGNED)


def numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and items of a list array."""
    offsets = np.asarray(lists.offsets)
    return offsets - offsets[0], lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)


def pair_counts(aligned: DataFrame, a: str, b: str) -> np.ndarray:
    """How many links of all documents hold each pair of ``Sides.codes``. Tasks count for themselves
    first; the driver gets at most one row per pair that the vocabularies allow."""
    size = len(opened(a, b).codes)

    def count(batches):
        n = np.zeros(size, np.int64)
        for batch in batches:
            n += np.bincount(numbers(batch.column("pairs"))[1], minlength=size)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], ["pair", "n"])

    rows = aligned.select("pairs").mapInArrow(count, "pair INT, n LONG").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out


def best_pairs(sides: Sides, counts: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of their B id, ties included."""
    most = np.zeros(sides.n_b, np.int64)
    np.maximum.at(most, sides.codes % sides.n_b, counts)
    return (counts > 0) & (counts == most[sides.codes % sides.n_b])


def with_counts(aligned: DataFrame, a: str, b: str) -> DataFrame:
    """``aligned`` (a stored table: it is read twice) without its pairs, with n_links, n_best (links
    whose pair is their B id's most frequent one) and count_sum (sum of their pairs' counts)."""
    counts = pair_counts(aligned, a, b)
    table = aligned.sparkSession.sparkContext.broadcast((counts, best_pairs(opened(a, b), counts)))
    kept = [f for f in aligned.schema.fields if f.name != "pairs"]

    def look_up(batches):
        counts, best = table.value
        for batch in batches:
            at, pairs = numbers(batch.column("pairs"))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[pairs], dtype=np.int64)])[at]) for x in (best, counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *map(pa.array, (np.diff(at).astype(np.int64), *sums))], [*(f.name for f in kept), "n_links", "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return aligned.mapInArrow(look_up, f"{schema}, n_links LONG, n_best LONG, count_sum LONG")


def digest(docs: DataFrame, a: str, b: str) -> DataFrame:
    """The contract's columns: groups as their SHA-256, '' for texts without tokens."""
    sha = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = align(docs, a, b).select("doc_id", "n_a", "n_b", "n_groups", sha.alias("groups_sha256"), "pairs")
    return with_counts(stored(aligned, "token-alignment"), a, b)

"""Packing documents into training sequences along a space-filling curve.

Every document is tokenized once; a seeded random projection of its hashed tokens gives a point of
few dimensions, whose place on a Hilbert curve is the document's key. Documents travel in chunks of
bounded size, so that ranges of the curve hold like amounts however long documents are; they are
sorted by that key, so neighbours on the curve meet, and each range's stream of tokens is cut into
sequences one after the other: all are full but the rest at the end of a range, which is cut at
powers of two and so takes no padding either.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, integer_id, mix64, partitions, powers, utf8

END = 1  # closes each document
LENGTH = 2048
DIMENSIONS, BITS = 4, 12
#: Words whose ids a worker keeps at most (about 40 bytes each); beyond, it starts anew.
CACHED = 500_000
_STEP_CHARS = 1 << 18
#: Tokens of a document that travel together.
CHUNK = 1024
# The settings of tokenizer files whose words are split on arrays here.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _classes() -> np.ndarray:
    """The tokenizer's classes of the code points below 2**16."""
    out = np.full(1 << 16, _OTHER, np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _SPACE if chr(c).isspace() else _OTHER
    return out


class Encoder:
    """Ids of whole texts: each distinct word is encoded once, all of a step's words are looked up.

    The tokenizer lower-cases, splits a text into words (contractions, runs of letters, single
    numbers, runs of other symbols) and encodes each alone, marking the end of a word in its last id.
    The same split is done here on arrays. It is exact for code points below U+0300, where classes,
    case and composition need no context; a text with others, or with one of the tokenizer's added
    tokens, is encoded whole by the tokenizer, and so is every text under a tokenizer with another
    normaliser or split. Words are told apart by two 64-bit hashes; should words of a step share
    only one, its texts are encoded whole too.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        added = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        normalizer, split = (json.loads(part.__getstate__()) if part else {} for part in (self.model.normalizer, self.model.pre_tokenizer))
        splits = split.get("pretokenizers") or [split]
        known = normalizer == _NORMALIZER and splits[0] == _SPLIT and type(self.model.model).__name__ == "BPE" and not self.model.model.dropout
        # the rest of the splits turns bytes into characters and must not cut again
        known = known and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in splits[1:])
        self.beyond = re.compile("|".join([r"[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u02ff]", *added]) if known else "")
        self.classes = _classes()
        self.values = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # token by token: a worker's memory is small, and a dictionary of all would stay in it
        self.last = np.array([(self.model.id_to_token(k) or "").endswith("</w>") for k in range(self.model.get_vocab_size())], bool)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, self.type)
        self.used = 0

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, spans and both hashes of the words of a lower-cased text that ends in four spaces."""
        u = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        kind = self.classes[u]
        before = np.concatenate([[np.uint8(_SPACE)], kind[:-1]])
        begins = (kind != _SPACE) & ((kind != before) | (kind == _NUMBER))
        mark = np.flatnonzero((u == 39) & (before != _OTHER))  # an apostrophe inside other symbols is one of them
        if len(mark):
            one, two = u[mark + 1], u[mark + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(mark), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            begins[mark[short | long] + 1] = False
            end = np.concatenate([mark[short] + 2, mark[long] + 3])
            begins[end[kind[end] == _LETTER]] = True
        starts = np.flatnonzero(begins)
        if not len(starts):
            return starts, starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        spans = np.diff(np.append(starts, len(u)))
        place = np.arange(starts[0], len(u)) - np.repeat(starts, spans)
        values = self.values[u[starts[0] :]] * powers(int(spans.max()) + 1)[place]
        values[kind[starts[0] :] == _SPACE] = 0
        return starts, spans, mix64(np.add.reduceat(values, starts - starts[0])), np.bitwise_xor.reduceat(values, starts - starts[0])

    def learn(self, hashes: np.ndarray, checks: np.ndarray, words: list[str]) -> None:
        """Encodes words of growing hashes and adds them to those known."""
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.type)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # a vocabulary without marks
            found = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
            ids, ends = np.array([k for f in found for k in f], self.type), np.cumsum([len(f) for f in found])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        sizes = np.diff(ends, prepend=0)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.checks = np.insert(self.hashes, at, hashes), np.insert(self.checks, at, checks)
        self.starts = np.insert(self.starts, at, self.used + ends - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.used += len(ids)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lower = [t.lower() for t in texts]
        joined = "\n".join(lower) + "    "
        starts, spans, hashes, checks = self.words(joined)
        order = np.argsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        if (checks[order][1:] != checks[order][:-1])[~new[1:]].any():
            return self._whole(texts)
        distinct, inverse = hashes[order[new]], np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        if len(self.hashes) > CACHED:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        unknown = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        unknown[inside] = self.hashes[at[inside]] != distinct[inside]
        if unknown.any():
            where = order[new][unknown]
            self.learn(distinct[unknown], checks[where], [joined[a : a + n].rstrip(" \t\n\r") for a, n in zip(starts[where].tolist(), spans[where].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        if (self.checks[at] != checks[order[new]]).any():
            return self._whole(texts)
        sizes = self.sizes[at][inverse]
        ends = np.cumsum(sizes)
        spot = np.repeat(self.starts[at][inverse] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        rows = np.cumsum([len(t) + 1 for t in lower])
        words = np.searchsorted(starts, rows)  # words up to the end of each text
        upto = np.concatenate([[0], ends])[words]
        return self.ids[spot], np.diff(upto, prepend=0)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([k for f in found for k in f], self.type), np.array([len(f) for f in found], np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        whole = [bool(self.beyond.search(t)) for t in texts]
        ids, sizes = self._plain([t for t, w in zip(texts, whole, strict=True) if not w])
        if not any(whole):
            return ids, sizes
        found = iter(self.model.encode_batch_fast([t for t, w in zip(texts, whole, strict=True) if w], add_special_tokens=False))
        plain = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else ())
        parts = [np.array(next(found).ids, self.type) if w else next(plain) for w in whole]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker process, so tasks share the words they have met."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def projection(n: int, seed: int = 11) -> np.ndarray:
    """A direction of +1 and -1 for each token id, by hashing it."""
    bits = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return np.where((bits[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1), 1.0, -1.0)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve through a grid of ``2**bits`` cells a side, of integer points."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def document_keys(ids: np.ndarray, sizes: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Curve keys of documents whose ids follow one another; each point is squashed into the grid."""
    sums = np.add.reduceat(directions[ids], np.cumsum(sizes) - sizes, axis=0)  # no document is empty
    spread = sums / np.sqrt(sizes)[:, None]
    return hilbert_keys(np.minimum((0.5 + np.arctan(spread / 4.0) / np.pi) * (1 << BITS), (1 << BITS) - 1))


def _tokenize(path: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, directions = encoder(path), None
        for batch in batches:
            data, at = utf8(batch.column("text"))
            lo = 0
            while lo < batch.num_rows:
                hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + _STEP_CHARS, "right")) - 1), batch.num_rows)
                texts = [t or "" for t in batch.column("text").slice(lo, hi - lo).to_pylist()]
                ids, sizes = encode(texts)
                ids, sizes = np.insert(ids, np.cumsum(sizes), END), sizes + 1
                directions = projection(encode.model.get_vocab_size()) if directions is None else directions
                chunks = -(-sizes // CHUNK)
                of = np.repeat(np.arange(hi - lo), chunks)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
                cuts = np.append((np.cumsum(sizes) - sizes)[of] + start, len(ids)) * encode.type.itemsize
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids)])
                place = pa.array(document_keys(ids, sizes, directions)[of])
                named = [batch.column(c).slice(lo, hi - lo).take(pa.array(of)) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([place, *named, pa.array(start), pa.array(sizes[of]), packed], ["place", "doc_id", "row", "start", "tokens", "ids"])
                lo = hi

    return run


class _Piece:
    """Tokens of one document that stand together in a sequence, from ``start`` in the document and ``offset`` there."""

    __slots__ = ("doc_id", "row", "start", "tokens", "offset", "size", "parts")

    def __init__(self, doc_id: int | None, row: int, start: int, tokens: int, offset: int) -> None:
        self.doc_id, self.row, self.start, self.tokens, self.offset = doc_id, row, start, tokens, offset
        self.size, self.parts = 0, []

    def add(self, part: np.ndarray) -> None:
        self.parts.append(part)
        self.size += len(part)

    def told(self, sequence: int) -> tuple:
        crc = 0
        for part in self.parts:
            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
        return self.doc_id, self.start, self.size, crc, self.tokens, sequence, self.offset


def _pieces(length: int, wide: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        tail: list[_Piece] = []  # the open sequence
        used = 0

        def placed(part: np.ndarray, doc_id: int | None, row: int, start: int, tokens: int, offset: int, sequence: list[_Piece]) -> None:
            last = sequence[-1] if sequence else None
            if last is None or last.row != row or last.start + last.size != start:
                sequence.append(last := _Piece(doc_id, row, start, tokens, offset))
            last.add(part)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "row", "start", "tokens")]
            for doc_id, row, start, tokens, packed in zip(*columns, batch.column("ids"), strict=True):
                ids, at = np.frombuffer(packed.as_buffer(), "<u4" if wide else "<u2"), 0
                while at < len(ids):
                    part = ids[at : at + length - used]
                    placed(part, doc_id, row, start + at, tokens, used, tail)
                    used, at = used + len(part), at + len(part)
                    if used == length:
                        rows += [p.told(number) for p in tail]
                        tail, used, number = [], 0, number + 1
            for p in tail:
                p.parts = [np.concatenate(p.parts)]  # lets the batch go
            if rows:
                yield batch_of(rows)
        rows = []
        while used:  # what is left, in sequences of powers of two
            room = 1 << (used.bit_length() - 1)
            filled, now, rest = 0, [], []
            for p in tail:
                ids = np.concatenate(p.parts)
                k = min(len(ids), room - filled)
                if k:
                    placed(ids[:k], p.doc_id, p.row, p.start, p.tokens, filled, now)
                    filled += k
                if k < len(ids):
                    placed(ids[k:], p.doc_id, p.row, p.start + k, p.tokens, 0, rest)
            rows += [p.told(number) for p in now]
            tail, used, number = rest, used - room, number + 1
        if rows:
            yield batch_of(rows)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text (null: empty) and then END, so an empty text has
    one. Each id lies in exactly one piece, each sequence holds at most ``length`` ids, gapless from
    offset 0, and every sequence is full or a power of two long. Documents of one key follow by
    doc_id, which are integers; rows that repeat a doc_id, or have none, are packed each. ``length``
    is a power of two. ``tokenizer``
    is a file that executors can open; by default that of the installed public vocabularies. Extra
    columns are ignored.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16
    kind = docs.schema["doc_id"].dataType
    named = docs.select(integer_id(docs), "text").withColumn("row", F.monotonically_increasing_id())
    tokens = cut(named.mapInArrow(_tokenize(tokenizer), "place long, doc_id long, row long, start long, tokens long, ids binary"))
    order = ["place", "doc_id", "row", "start"]
    along = tokens.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    pieces = along.mapInArrow(_pieces(length, wide), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumn("doc_id", F.col("doc_id").cast(kind))

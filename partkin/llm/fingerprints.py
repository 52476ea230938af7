"""Context-triggered piecewise hashes of documents, and their likeness.

A rolling hash of the last seven bytes ends a chunk wherever it meets a condition of the block size,
so chunk borders depend on nearby content alone and an edit changes few chunks. A fingerprint is the
block size (halved until there are enough chunks), one character for each chunk, and the same at
twice the block size; two fingerprints are compared, where block sizes allow, by the edit distance of
their signatures. Borders, chunk hashes and edit distances (bit-parallel, for all pairs of a step at
once) are array operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import STEP_BYTES, integer_id, mix64, partitions, powers

SMALLEST = 3
LENGTH = 64  # characters of a signature, at most: the last one stands for all chunks that are left
WINDOW = 7
RUN = 7  # characters in a row that like signatures share
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: The rolling hash's multiplier and its powers.
_P, _P2, _P4 = (np.uint32(0x01000193**k & 0xFFFFFFFF) for k in (1, 2, 4))
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Prints(NamedTuple):
    """Fingerprints of some texts: block sizes, and the two signatures as padded rows and lengths."""

    block: np.ndarray
    one: np.ndarray
    one_size: np.ndarray
    two: np.ndarray
    two_size: np.ndarray

    def rows(self, which: slice | np.ndarray) -> Prints:
        return Prints(*[x[which] for x in self])

    def strings(self) -> list[str]:
        one, two = ALPHABET[self.one], ALPHABET[self.two]
        return [
            f"{b}:{one[k, : self.one_size[k]].tobytes().decode()}:{two[k, : self.two_size[k]].tobytes().decode()}"
            for k, b in enumerate(self.block)
        ]


def _signature(hashes: np.ndarray, row: np.ndarray, spans: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Padded signatures from the chunk sums of rows in order; spans are the chunks' bytes."""
    sizes = np.bincount(row, minlength=n)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(row)) - first[row]
    if (sizes > LENGTH).any():  # the chunks from the last place on count as one
        heads = np.flatnonzero(place < LENGTH)
        ends = np.cumsum(spans)
        before = ends - spans
        of = np.searchsorted(heads, np.arange(len(row)), "right") - 1
        shift = before - before[heads[of]]
        hashes = np.add.reduceat(hashes * powers(int(shift.max()) + 1)[shift], heads)
        row, place, sizes = row[heads], place[heads], np.minimum(sizes, LENGTH)
    out = np.zeros((n, LENGTH), np.uint8)
    out[row, place] = (mix64(hashes) >> np.uint64(58)).astype(np.uint8)
    return out, sizes


def fingerprints(texts: list[bytes]) -> Prints:
    """Of whole texts; equal texts have equal fingerprints, whatever stands around them.

    The block size follows from the length, and is halved while the signature has less than half of
    its characters (few distinct windows may all miss the condition).
    """
    size = np.array([len(t) for t in texts], np.int64)
    power = np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / (SMALLEST * LENGTH)))).astype(np.int64)
    out = _prints(texts, SMALLEST << power)
    short = np.flatnonzero((out.one_size < LENGTH // 2) & (out.block > SMALLEST))
    while len(short):
        again = _prints([texts[k] for k in short], out.block[short] // 2)
        for whole, part in zip(out, again, strict=True):
            whole[short] = part
        short = short[(again.one_size < LENGTH // 2) & (again.block > SMALLEST)]
    return out


def _prints(texts: list[bytes], block: np.ndarray) -> Prints:
    """With given block sizes."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    gap = WINDOW - 1  # so that a window never reaches into the text before
    data = np.frombuffer(b"\0" * gap + (b"\0" * gap).join(texts), np.uint8)
    wide = data.astype(np.uint32) + np.uint32(1)
    two = wide[1:] + wide[:-1] * _P
    four = two[2:] + two[:-2] * _P2
    three = two[1:] + wide[:-2] * _P2
    roll = four[3:] + three[:-4] * _P4  # of the seven bytes that end here
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    # without the gaps again: roll[k] belongs to data[k + gap]
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(gap * np.arange(n), size)
    body, roll = data[at + gap], roll[at]
    row = np.repeat(np.arange(n), size)
    wanted = block[row].astype(np.uint32)
    ends = roll % wanted == wanted - 1
    twice = ends & (roll % (wanted * np.uint32(2)) == wanted * np.uint32(2) - 1)
    full = begin[size > 0] + size[size > 0] - 1
    ends[full] = True
    twice[full] = True
    last = np.flatnonzero(ends)
    if not len(last):
        none = np.zeros((n, LENGTH), np.uint8), np.zeros(n, np.int64)
        return Prints(block, *none, *none)
    starts = np.concatenate([[0], last[:-1] + 1])
    spans = last - starts + 1
    place = np.arange(len(body)) - np.repeat(starts, spans)
    sums = np.add.reduceat(_VALUES[body] * powers(int(spans.max()) + 1)[place], starts)
    small = _signature(sums, row[last], spans, n)
    tops = np.flatnonzero(twice[last])  # chunks of twice the block size are joined from the others
    heads = np.concatenate([[0], tops[:-1] + 1])
    of = np.repeat(np.arange(len(tops)), tops - heads + 1)
    shift = starts - starts[heads[of]]
    joined = np.add.reduceat(sums * powers(int(shift.max()) + 1)[shift], heads)
    return Prints(block, *small, *_signature(joined, row[last][tops], np.add.reduceat(spans, heads), n))


def _alike(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """1 less the edit distance (insertions and deletions) over both lengths; 0 without a common run."""
    n = len(a)
    if not n:
        return np.zeros(0)
    one = np.uint64(1)
    rows = np.arange(n)
    where = np.zeros((n, 65), np.uint64)  # bit k: character k of a
    for k in range(int(a_size.max(initial=0))):
        where[rows, np.where(k < a_size, a[:, k], 64)] |= one << np.uint64(k)
    where[:, 64] = 0
    state = np.full(n, ~np.uint64(0))
    need = np.minimum(RUN, (np.maximum(a_size, b_size) + 1) // 2)
    shared = need == 0
    runs = [np.zeros(n, np.uint64) for _ in range(RUN)]
    for k in range(int(b_size.max(initial=0))):
        match = where[rows, np.where(k < b_size, b[:, k], 64)]
        hit = state & match
        state = (state + hit) | (state - hit)
        longer = [match]
        for m in range(RUN - 1):
            longer.append((runs[m] << one) & match)
        runs = longer
        for m in range(RUN):
            shared |= (need == m + 1) & (runs[m] != 0)
    used = np.where(a_size >= 64, ~np.uint64(0), (one << np.minimum(a_size, 63).astype(np.uint64)) - one)
    common = np.bitwise_count(~state & used).astype(float)
    both = a_size + b_size
    return np.where(shared & (both > 0), 2 * common / np.maximum(both, 1), 0.0)


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """From 0 to 1 for each pair of rows; equal fingerprints have 1, incompatible block sizes 0."""
    same, under, over = a.block == b.block, a.block == 2 * b.block, 2 * a.block == b.block
    out = np.zeros(len(a.block))
    x, y = a.rows(same), b.rows(same)
    out[same] = np.maximum(_alike(x.one, x.one_size, y.one, y.one_size), _alike(x.two, x.two_size, y.two, y.two_size))
    x, y = a.rows(under), b.rows(under)
    out[under] = _alike(x.one, x.one_size, y.two, y.two_size)
    x, y = a.rows(over), b.rows(over)
    out[over] = _alike(x.two, x.two_size, y.one, y.one_size)
    out[same & (a.one_size == 0) & (b.one_size == 0)] = 1.0
    return out


def _answers(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """The result for all rows but the last, which is only a successor."""
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    edited = []
    for text, after in zip(texts, texts[1:], strict=False):
        k = len(text) // 4
        edited.append((text[: len(text) - k] + after[:k]).encode() if k else text.encode())
    own, new = fingerprints([t.encode() for t in texts]), fingerprints(edited)
    head = own.rows(slice(0, len(edited)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:-1], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
            pa.array(head.strings()),
            pa.array(new.strings()),
            pa.array(likeness(head, new)),
            pa.array(likeness(head, own.rows(slice(1, None)))),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket; in each the documents in order, then the one that follows the last."""
    held: list[tuple[int | None, str]] = []
    bucket, size, closed = None, 0, False
    for batch in batches:
        for b, tail, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")], strict=True):
            if b != bucket:
                bucket, held, size, closed = b, [], 0, False
            if closed:
                continue  # further rows of a repeated id
            held.append((doc_id, text))
            size += len(text)
            closed = tail == 1
            if len(held) > 1 and (closed or size > STEP_BYTES // 2):
                yield _answers(held)
                held, size = held[-1:], len(text)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are each their own successor."""
    for batch in batches:
        for text in batch.column("text").to_pylist():
            yield _answers([(None, text), (None, text)])


def document_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints every whole text and its edited text (null: empty).

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many, or
    all, of the next document by ascending doc_id; after the last comes the first. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt by ranges of doc_id (integers), whose first ids the driver gets from a scan
    of that column alone; the first document of a range is also sent to the range before, so every
    document meets its successor in one shuffle. Rows that repeat a doc_id are ordered by text. A row
    without an id has no place in the order: it is its own successor, as is a single document. An
    empty table gives an empty result.
    """
    docs = docs.select(integer_id(docs), F.coalesce("text", F.lit("")).alias("text"))
    named = docs.where(F.col("doc_id").isNotNull())
    n = buckets or 3 * partitions(docs)
    shares = [k / n for k in range(1, n)] or [0.5]
    ends = named.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", shares, 10 * n).alias("cuts")).first()
    low = ends["low"] or 0
    firsts = np.array(sorted({c for c in ends["cuts"] or () if c > low}), np.int64)
    last = len(firsts)

    @arrow_udf("array<int>")
    def deal(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Twice the bucket of a row, and for the first of its range also that of the one before, plus one."""
        for ids in batches:
            ids = ids.to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(firsts, ids, "right")
            first = ids == low
            if last:
                first |= (bucket > 0) & (firsts[np.maximum(bucket, 1) - 1] == ids)
            before = np.where(bucket > 0, bucket - 1, last)
            codes = np.stack([2 * bucket, 2 * before + 1], 1).ravel()[np.stack([np.ones(len(ids), bool), first], 1).ravel()]
            yield pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(1 + first)]).astype(np.int32), pa.array(codes.astype(np.int32)))

    dealt = named.withColumn("code", F.explode(deal(F.col("doc_id"))))
    dealt = dealt.select((F.col("code") / 2).cast("int").alias("bucket"), (F.col("code") % 2).alias("tail"), "doc_id", "text")
    met = dealt.repartition(partitions(docs), "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return met.mapInArrow(_stream, schema).unionByName(docs.where(F.col("doc_id").isNull()).mapInArrow(_alone, schema))

"""Removal of repeated byte strings by a depth-limited, distributed radix sort of suffixes.

Suffixes are told apart only through ``length`` bytes, most significant digit first, and a suffix is
followed only while another shares its digits; groups that are equal to the last digit are exactly
the repeated windows. The passes:

1. The first digit of a window is its anchor: the least hash among the strings of GRAM bytes within
   it, which depends on the window alone. Neighbouring windows share anchors, so a document becomes
   segments (runs of windows with one anchor), a fortieth as many as its bytes. A batch settles
   its own equal segments; the first of each is dealt by its anchor. Anchors that are too common
   for one task are found beforehand by Misra-Gries counts: their windows are dealt by the longer
   string around the anchor that each half of them shares, and where that is too common as well,
   by all of their bytes.
2. Segments of one anchor meet. Those equal in all their bytes are settled: all but the first go.
   Where all segments of an anchor are equal that is all; most anchors end here.
3. Only anchors with different segments, where a copy begins or ends, need more digits. Their
   segments' bytes are fetched from the documents and dealt by anchor again, and the windows in them
   are refined by anchor and offset, then by four digits of a quarter of the window each. Windows
   alone in their group are dropped after every pass.

What is removed goes back to the documents as runs of bytes. Rows travel as compressed columns, one
value for each batch and bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, integer_id, mix64, partitions, steps, utf8

LENGTH, GRAM = 100, 24
DIGITS = 4
#: Text that a bucket stands for: there are as many buckets as that asks for, whatever the size.
BUCKET_BYTES = 2_000_000
#: Counters of a task's Misra-Gries summary: every digit of more than N / COUNTERS of the N segments shows.
COUNTERS = 1 << 16
#: Segments of one digit that a bucket takes anyway; beyond, a digit of more than 4 N / COUNTERS is split.
LEAST = 20_000
#: Text that is cut up at a time, in arrays of eight bytes a position.
STEP_BYTES = 1 << 19
#: Text that a task holds at a time when it visits documents, and windows that it refines at a time.
HELD_BYTES, HELD_WINDOWS = 1 << 23, 1 << 19
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ROOT = 0x9FB21C651E98DF25
_LOW = np.uint64(0xFFFFFF)
_TURN = np.uint64(_ROOT)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_ROOT, k, 1 << 64))


@lru_cache(maxsize=None)
def _power_table(sign: int, size: int) -> np.ndarray:
    out = np.full(size, _power(sign), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(sign: int, n: int) -> np.ndarray:
    """The first n powers of the root, or of its inverse."""
    return _power_table(sign, 1 << max(12, int(n - 1).bit_length()))[:n]


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The mixed hash of the ``size`` bytes from each position on, by doubling."""
    part, have, done = _BYTE[data], 1, None
    total: np.ndarray | None = None
    while True:
        if size & have:
            total = part if total is None else total[: len(part) - done] + part[done:] * _power(done) if len(part) > done else part[:0]
            done = have if done is None else done + have
        if 2 * have > size:
            break
        part = part[: max(0, len(part) - have)] + part[have:] * _power(have)
        have *= 2
    return mix64(total[: max(0, len(data) - size + 1)])


def _strings(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The hashes of the strings of ``size`` bytes from some positions on."""
    weights = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _power(1))]), dtype=np.uint64)
    out = np.zeros(len(starts), np.uint64)
    for k in range(size):
        out += _BYTE[data[starts + k]] * weights[k]
    return mix64(out)


def _has(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    spot = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[spot] == values


def _halves(data: np.ndarray, anchor: np.ndarray, key: np.ndarray, begin: np.ndarray, windows: np.ndarray, which: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of too common anchors cut where the anchor passes the middle of their windows.

    All windows of the first part hold the ``half`` bytes before the anchor, all of the second the
    ``half`` bytes after it; with the anchor, these are the parts' digits.
    """
    half = (length - gram) // 2
    a, b, w = anchor[which], begin[which], windows[which]
    left = np.clip(a - b - half, 0, w)  # windows in which more than half bytes stand before the anchor
    one, two = np.flatnonzero(left > 0), np.flatnonzero(left < w)
    keys = [mix64(_strings(data, a[one] - half, gram + half) + np.uint64(1)), mix64(_strings(data, a[two], gram + half) + np.uint64(2))]
    rest = np.flatnonzero(~which)
    order = np.argsort(np.concatenate([begin[rest], b[one], (b + left)[two]]), kind="stable")
    joined = zip((anchor[rest], key[rest], begin[rest], windows[rest]), (a[one], keys[0], b[one], left[one]), (a[two], keys[1], (b + left)[two], (w - left)[two]), strict=True)
    return tuple(np.concatenate(x)[order] for x in joined)


def segments(data: np.ndarray, at: np.ndarray, length: int, gram: int, common: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, ...]:
    """(digit, content hash, row, start in row, windows, anchor's offset) of runs of windows.

    A run is a maximal range of consecutive windows of one row that have the same digit; its content
    is all bytes of its windows. ``data`` is shorter than 2**24 bytes or one row. ``common`` holds, in
    order, the anchors that are too common and the longer strings that are so.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    if len(data) > 1 << 23:  # one very long text: in overlapping pieces, split at a window
        out, step = [], 1 << 22
        for lo in range(0, len(data) - length + 1, step):
            piece = data[lo : lo + step + length - 1]
            a, c, r, s, w, o = segments(piece, np.array([0, len(piece)]), length, gram, common)
            out.append((a, c, r, s + lo, w, o))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
    hashes = string_hashes(data, gram)
    least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)  # ties go to the left
    wide, span = length - gram + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    anchor = (least & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= at[1:][row])
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    begin, windows, anchor = start[first], np.diff(np.append(first, len(start))), anchor[first]
    key = hashes[anchor]
    if common and len(common[0]) and (which := _has(common[0], key)).any():
        anchor, key, begin, windows = _halves(data, anchor, key, begin, windows, which, length, gram)
    single = np.zeros(len(key), bool)
    if len(common) > 1 and len(common[1]) and (single := _has(common[1], key)).any():
        times = np.where(single, windows, 1)
        shift = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        anchor, key, begin, windows, single = (np.repeat(x, times) for x in (anchor, key, begin, windows, single))
        begin, windows = begin + shift, np.where(single, 1, windows)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix64(hashes ^ _TURN) * _powers(1, len(hashes)), dtype=np.uint64, out=sums[1:])
    content = (sums[begin + windows + length - gram] - sums[begin]) * _powers(-1, len(hashes))[begin]  # the same wherever the run stands
    content = mix64(content + windows.astype(np.uint64))
    key = np.where(single, mix64(content ^ _TURN), key)
    row = row[begin]
    return key, content, row, begin - at[:-1][row], windows, anchor - begin


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as one compressed value, bytes of like weight together."""
    body = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + body)


def unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(value)
    n, spot, out = int.from_bytes(body[:8], "little"), 8, []
    for kind in map(np.dtype, kinds):
        planes = np.frombuffer(body, np.uint8, n * kind.itemsize, spot).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        spot += n * kind.itemsize
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64) ^ _TURN) % np.uint64(buckets)).astype(np.int64)


def _spread(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Which entries go to which bucket."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(bucket[part[0]]), part


#: kinds of values: segments by anchor; runs to remove, and unsettled segments, by document; bytes by anchor; documents
_SEGMENTS, _RUNS, _OPEN, _BYTES, _TEXTS = range(5)
_COLUMNS = {
    _SEGMENTS: ("<u8", "<u8", "<i8", "<i4", "<u1", "<u1"),  # anchor, content, doc_id, start, windows, offset
    _RUNS: ("<i8", "<i4", "<i4"),  # doc_id, start, windows
    _OPEN: ("<u8", "<i8", "<i4", "<u1", "<u1"),  # anchor, doc_id, start, windows, offset
}
SCHEMA = "kind int, bucket int, value binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, bucket, value = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(value, pa.binary())], ["kind", "bucket", "value"])


def _typed(kind: int, columns: list[np.ndarray]) -> list[np.ndarray]:
    return [c.astype(t) if c.dtype != np.dtype(t) else c for c, t in zip(columns, _COLUMNS[kind], strict=True)]


def _sent(kind: int, key: int, columns: list[np.ndarray], buckets: int) -> list[tuple[int, int, bytes]]:
    columns = _typed(kind, columns)
    return [(kind, b, pack(*[c[part] for c in columns])) for b, part in _spread(columns[key], buckets)]


def _runs(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
    """Runs of windows joined where they touch, by document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), (start + windows)[order].astype(np.int64)
    if len(doc):
        new = np.ones(len(doc), bool)
        # runs of one document don't overlap before joining, so each begins after the one before
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
        first = np.flatnonzero(new)
        doc, start, end = doc[first], start[first], np.maximum.reduceat(end, first)
    return [doc, start, end - start]


def _equal(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by anchor, content and place, and which of that order begin an equal group."""
    order = np.lexsort((start, doc, content, anchor))
    a, c = anchor[order], content[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    return order, new


def _later(order: np.ndarray, new: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of that order stand after the first of their group, and not just in another row of its doc_id."""
    if not len(order):
        return new
    first = order[new][np.cumsum(new) - 1]
    return (doc[order] != doc[first]) | (start[order] != start[first])


def _segments_of(batch: pa.RecordBatch, length: int, gram: int, common: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    data, at = utf8(batch.column("text"))
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    found: list[list[np.ndarray]] = [[] for _ in _COLUMNS[_SEGMENTS]]
    for a, b in steps(at, STEP_BYTES):
        got = list(segments(data[at[a] : at[b]], at[a : b + 1] - at[a], length, gram, common))
        got[2] = ids[a:b][got[2]]
        for k, t in enumerate(_COLUMNS[_SEGMENTS]):
            found[k].append(got[k].astype(t))
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, _COLUMNS[_SEGMENTS], strict=True)]


def summary(keys: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """The Misra-Gries summary of weighted keys: what a count loses is the weight over the counters at most."""
    keys, inverse = np.unique(keys, return_inverse=True)
    counts = np.bincount(inverse, counts, len(keys)).astype(np.int64)
    if len(keys) > counters:
        counts -= np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def _count(length: int, gram: int, common: tuple[np.ndarray, ...], counters: int, floor: float) -> object:
    """A task's most frequent digits; equal segments of a batch count once.

    A count of ``floor`` a byte of the task's text or less isn't told, so that what all tasks keep to
    themselves is at most ``floor`` times the bytes of all texts, and what they tell is little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            anchor, content, *_ = _segments_of(batch, length, gram, common)
            size += len(utf8(batch.column("text"))[0])
            order = np.lexsort((content, anchor))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(content[order]) != 0)
            keys, counts = summary(np.concatenate([keys, anchor[order[new]]]), np.concatenate([counts, np.ones(int(new.sum()), np.int64)]), counters)
        told = counts > floor * size
        yield pa.RecordBatch.from_arrays([pa.array(keys[told].view(np.int64)), pa.array(counts[told])], ["digit", "n"])

    return run


def too_common(docs: DataFrame, total: int, length: int, gram: int, counters: int, least: int) -> tuple[np.ndarray, ...]:
    """The digits with more segments than one task should take: first anchors, then the strings around those.

    ``total`` is the bytes of all texts, which have a segment about every (length - gram) / 2 bytes.
    All digits of more than ``limit`` segments are found: summaries lose a quarter of that at most,
    and tasks keep as much to themselves. The driver gets about ``counters`` / 2 of either at most.
    """
    limit = max(least, 4 * (2 * total // (length - gram)) // counters)
    common: tuple[np.ndarray, ...] = ()
    for _ in range(2):
        counted = docs.mapInArrow(_count(length, gram, common, counters, limit / 4 / max(total, 1)), "digit long, n long")
        found = counted.groupBy("digit").agg(F.sum("n").alias("n")).where(F.col("n") > limit / 2).collect()
        common = (*common, np.sort(np.array([r["digit"] for r in found], np.int64).view(np.uint64)))
        if not found:
            break
    return common


def _cut_up(length: int, gram: int, buckets: int, common: tuple[np.ndarray, ...]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, content, doc, start, windows, offset = _segments_of(batch, length, gram, common)
            order, new = _equal(anchor, content, doc, start)
            first, again = np.sort(order[new]), order[_later(order, new, doc, start)]  # in order of documents, which compresses
            rows = _sent(_SEGMENTS, 0, [anchor[first], content[first], doc[first], start[first], windows[first], offset[first]], buckets)
            yield _batch(rows + _sent(_RUNS, 0, _runs(doc[again], start[again], windows[again]), buckets))

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """The values of each (kind, bucket) of sorted rows."""
    now, values = None, []
    for batch in batches:
        for kind, bucket, value in zip(*[batch.column(c).to_pylist() for c in ("kind", "bucket", "value")], strict=True):
            if (kind, bucket) != now:
                if now:
                    yield *now, values
                now, values = (kind, bucket), []
            values.append(value)
    if now:
        yield *now, values


def _settle(buckets: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, bucket, values in _groups(batches):
            if kind == _RUNS:
                yield _batch([(kind, bucket, v) for v in values])
                continue
            parts = [unpack(v, *_COLUMNS[_SEGMENTS]) for v in values]
            anchor, content, doc, start, windows, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, new = _equal(anchor, content, doc, start)
            again, first = order[_later(order, new, doc, start)], order[new]
            rows = _sent(_RUNS, 0, _runs(doc[again], start[again], windows[again]), buckets)
            a = anchor[first]
            more = np.zeros(len(a), bool)
            more[1:] = a[1:] == a[:-1]
            more[:-1] |= more[1:]
            left = first[more]
            left = left[np.lexsort((start[left], doc[left]))]
            yield _batch(rows + _sent(_OPEN, 1, [anchor[left], doc[left], start[left], windows[left], offset[left]], buckets))

    return run


def _by_doc(values: dict[int, list[bytes]], kind: int, key: int) -> dict[int, list[np.ndarray]]:
    """The columns of a kind's values in a bucket, for each document."""
    parts = [unpack(v, *_COLUMNS[kind]) for v in values.get(kind, ())]
    if not parts:
        return {}
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.argsort(columns[key], kind="stable")
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(columns[key])) + 1
    ids = columns[key][np.concatenate([[0], cuts])]
    return dict(zip(ids.tolist(), zip(*[np.split(c, cuts) for c in columns], strict=True), strict=True))


def _framed(head: bytes, body: bytes) -> bytes:
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(body)


def _unframed(value: bytes) -> tuple[bytes, bytes]:
    n = 4 + int.from_bytes(value[:4], "little")
    return value[4:n], zstandard.ZstdDecompressor().decompress(value[n:])


def _ship(buckets: int) -> object:
    """Documents dealt by doc_id, those of a batch and bucket together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            missing = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            rows = []
            for b, part in _spread(ids, buckets):
                body = b"".join(data[x:y].tobytes() for x, y in zip(at[part].tolist(), at[part + 1].tolist(), strict=True))
                rows.append((_TEXTS, b, _framed(pack(ids[part], missing[part].astype("<u1"), (at[part + 1] - at[part]).astype("<i8")), body)))
            yield _batch(rows)

    return run


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]], list[tuple[int | None, bytes]]]]:
    """Rows sorted by bucket, its values before its documents: (bucket, values by kind, some documents)."""
    now, values, docs, size = None, {}, [], 0
    for batch in batches:
        for bucket, kind, value in zip(*[batch.column(c).to_pylist() for c in ("bucket", "kind", "value")], strict=True):
            if bucket != now:
                if docs:
                    yield now, values, docs
                now, values, docs, size = bucket, {}, [], 0
            if kind != _TEXTS:
                values.setdefault(kind, []).append(value)
                continue
            head, body = _unframed(value)
            ids, missing, sizes = unpack(head, "<i8", "<u1", "<i8")
            ends = np.cumsum(sizes).tolist()
            docs += [(None if m else i, body[e - n : e]) for i, m, n, e in zip(ids.tolist(), missing.tolist(), sizes.tolist(), ends, strict=True)]
            size += len(body)
            if size > HELD_BYTES:
                yield now, values, docs
                docs, size = [], 0
    if docs:
        yield now, values, docs


def _fetch(length: int, buckets: int) -> object:
    """Sends the bytes of the open segments, dealt by anchor; one value a bucket for many documents."""

    def sent(found: list[list[np.ndarray]], texts: list[np.ndarray]) -> pa.RecordBatch:
        anchor, doc, start, windows, offset, spot = (np.concatenate(x) for x in zip(*found, strict=True))
        body, rows = np.concatenate(texts), []
        for b, part in _spread(anchor, buckets):
            sizes = windows[part].astype(np.int64) + length - 1
            at = np.repeat(spot[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            rows.append((_BYTES, b, _framed(pack(anchor[part], doc[part], start[part], windows[part], offset[part]), body[at].tobytes())))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, wanted = None, {}
        found, texts, base = [], [], 0
        for bucket, values, docs in _visits(batches):
            if bucket != seen:
                seen, wanted = bucket, _by_doc(values, _OPEN, 1)
            for doc_id, text in docs:
                if doc_id in wanted:
                    anchor, doc, start, windows, offset = wanted[doc_id]
                    body = np.frombuffer(text, np.uint8)
                    inside = start.astype(np.int64) + windows + length - 1 <= len(body)  # of the row that has them
                    found.append([anchor[inside], doc[inside], start[inside], windows[inside], offset[inside], base + start[inside].astype(np.int64)])
                    texts.append(body)
                    base += len(body)
            if base > HELD_BYTES:
                yield sent(found, texts)
                found, texts, base = [], [], 0
        if found:
            yield sent(found, texts)

    return run


def repeated_windows(group: np.ndarray, spot: np.ndarray, body: np.ndarray, length: int, digits: int = DIGITS) -> tuple[np.ndarray, np.ndarray]:
    """Which windows share their group and all their bytes with another, and the key they share.

    ``spot`` is where a window begins in ``body``. Each pass refines the groups by the next digit,
    a string of length / digits bytes, and drops the windows that are alone.
    """
    alive = np.arange(len(spot))
    wide = -(-length // digits)
    hashes = string_hashes(body, wide)
    for k in range(-1, digits):
        if k >= 0:  # the last digit ends with the window, so it may overlap the one before
            group = mix64(group + hashes[spot[alive] + min(k * wide, length - wide)] * _power(k + 2))
        order = np.argsort(group)
        key = group[order]
        alone = np.ones(len(key), bool)
        if len(key):
            same = key[1:] == key[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
        keep = order[~alone]
        alive, group = alive[keep], group[keep]
    return alive, group


def _told_apart(key: np.ndarray, spot: np.ndarray, body: np.ndarray, length: int) -> np.ndarray:
    """The keys of sorted windows, made different where equal keys hide different bytes."""
    views = np.lib.stride_tricks.sliding_window_view(body, length)
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    wrong = [k[(views[spot[k]] != views[spot[k - 1]]).any(1)] for k in np.array_split(same, len(same) // 50_000 + 1)]
    for value in np.unique(key[np.concatenate(wrong)]):
        rows = np.flatnonzero(key == value)
        _, text = np.unique(views[spot[rows]], axis=0, return_inverse=True)
        key[rows] = mix64(value + text.ravel().astype(np.uint64) * _power(1))
    return key


def _refined(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray, offset: np.ndarray, body: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the windows that another one equals and precedes; ``body`` has the segments' bytes in a row."""
    sizes = windows.astype(np.int64) + length - 1
    begin = np.cumsum(sizes) - sizes
    count = windows.astype(np.int64)
    of = np.repeat(np.arange(len(count)), count)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    # windows can be equal only if the anchor stands at the same place in them
    group = mix64(anchor[of] + (offset[of].astype(np.int64) - shift).astype(np.uint64) * _power(1))
    spot = begin[of] + shift
    alive, key = repeated_windows(group, spot, body, length)
    d, s = doc[of[alive]], start[of[alive]].astype(np.int64) + shift[alive]
    order = np.argsort(key, kind="stable")
    key[order] = _told_apart(key[order], spot[alive][order], body, length)
    order = np.lexsort((s, d, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    gone = order[_later(order, new, d, s)]
    return d[gone], s[gone]


def _refine(length: int, buckets: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, values in _groups(batches):
            parts, bodies = [], []
            for v in values:
                head, body = _unframed(v)
                parts.append(unpack(head, *_COLUMNS[_OPEN]))
                bodies.append(np.frombuffer(body, np.uint8))
            anchor, doc, start, windows, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            body = np.concatenate(bodies)
            sizes = windows.astype(np.int64) + length - 1
            begin = np.cumsum(sizes) - sizes
            order = np.argsort(anchor, kind="stable")
            # some anchors at a time, each whole
            heads = np.flatnonzero(np.concatenate([[True], np.diff(anchor[order]) != 0]))
            upto = np.concatenate([[0], np.cumsum(windows[order].astype(np.int64))])
            lo = 0
            while lo < len(heads):
                hi = max(lo + 1, int(np.searchsorted(upto[heads], upto[heads[lo]] + HELD_WINDOWS, "right")) - 1)
                hi = len(heads) if upto[-1] <= upto[heads[lo]] + HELD_WINDOWS else hi
                rows = order[heads[lo] : heads[hi] if hi < len(heads) else len(order)]
                spread = np.repeat(begin[rows] - (np.cumsum(sizes[rows]) - sizes[rows]), sizes[rows]) + np.arange(int(sizes[rows].sum()))
                d, s = _refined(anchor[rows], doc[rows], start[rows], windows[rows], offset[rows], body[spread], length)
                if len(d):
                    yield _batch(_sent(_RUNS, 0, _runs(d, s, np.ones(len(d), np.int64)), buckets))
                lo = hi

    return run


def _remove(length: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, gone = None, {}
        for bucket, values, docs in _visits(batches):
            if bucket != seen:
                seen, gone = bucket, _by_doc(values, _RUNS, 0)
            out = []
            for doc_id, body in docs:
                removed = spans = 0
                kept = hashlib.sha256()
                done = 0
                if doc_id in gone:
                    _, start, windows = gone[doc_id]
                    order = np.argsort(start, kind="stable")
                    lo, hi = start[order].astype(np.int64), (start + windows)[order].astype(np.int64) + length - 1
                    hi = np.minimum(np.maximum.accumulate(hi), len(body))
                    new = np.ones(len(lo), bool)
                    new[1:] = lo[1:] > hi[:-1]
                    first = np.flatnonzero(new)
                    for a, b in zip(lo[first].tolist(), hi[np.append(first[1:] - 1, len(lo) - 1)].tolist(), strict=True):
                        if a < b:
                            kept.update(body[done:a])
                            removed, spans, done = removed + b - a, spans + 1, b
                kept.update(body[done:])
                out.append((doc_id, len(body), removed, spans, kept.hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def substring_dedup(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, buckets: int | None = None, counters: int = COUNTERS, least: int = LEAST
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a
    document of smaller doc_id, or earlier in the same one. Strings are judged on the input, never
    cross documents, and may overlap; null counts as empty, and shorter texts lose nothing. doc_ids
    are integers; rows that repeat a doc_id and text count as one document and lose the same each;
    other texts under one doc_id are documents of their own, in the order of their hash; null ids
    take no part and keep their bytes. Segments are found equal by two 64-bit hashes, refined windows
    by their bytes. A digit that has more than ``least`` segments and 4 / ``counters`` of all is
    split (see the module). Extra columns are ignored.
    """
    if not gram < length <= gram + 255:
        raise ValueError("length must exceed gram, by at most 255")
    docs = docs.select(integer_id(docs), F.coalesce("text", F.lit("")).alias("text"))
    told = docs.where(F.col("doc_id").isNotNull()).withColumn("content", F.xxhash64("text"))
    if told.groupBy("doc_id").agg((F.min("content") < F.max("content")).alias("several")).where("several").isEmpty():
        return _deduplicated(docs, length, gram, buckets, counters, least)
    # some ids have several texts: all are numbered anew, in their order
    order = ["doc_id", "content"]
    ids = told.select(*order).distinct().repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    ids = cut(ids.withColumn("place", F.monotonically_increasing_id()))
    placed = told.join(ids, order).select(F.col("place").alias("doc_id"), "text").unionByName(docs.where(F.col("doc_id").isNull()))
    found = _deduplicated(placed, length, gram, buckets, counters, least).withColumnRenamed("doc_id", "place")
    return found.join(ids, "place", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _deduplicated(docs: DataFrame, length: int, gram: int, buckets: int | None, counters: int, least: int) -> DataFrame:
    n = partitions(docs)
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = buckets or max(1, -(-total // BUCKET_BYTES))  # by the bytes to tell apart

    def dealt(values: DataFrame, *order: str) -> DataFrame:
        return values.repartition(n, "bucket").sortWithinPartitions(*order)

    named = docs.where(F.col("doc_id").isNotNull())
    common = too_common(named, total, length, gram, counters, least)
    known = cut(dealt(named.mapInArrow(_cut_up(length, gram, buckets, common), SCHEMA), "kind", "bucket").mapInArrow(_settle(buckets), SCHEMA))

    texts = docs.mapInArrow(_ship(buckets), SCHEMA)

    def visited(values: DataFrame) -> DataFrame:
        return dealt(values.unionByName(texts), "bucket", "kind")

    opened = visited(known.where(F.col("kind") == _OPEN)).mapInArrow(_fetch(length, buckets), SCHEMA)
    refined = dealt(opened, "kind", "bucket").mapInArrow(_refine(length, buckets), SCHEMA)
    gone = known.where(F.col("kind") == _RUNS).unionByName(refined)
    return visited(gone).mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

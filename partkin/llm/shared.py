"""Things that several corpus operators need: tables, lineage cuts, hashed splits, UTF-8 batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, NullType

from ..runtime import cut as cut  # operators take it from here

#: Bytes of text that one vectorised step takes at a time, so that its arrays stay near the cache.
STEP_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def integer_id(docs: DataFrame, name: str = "doc_id") -> Column:
    """The ids as longs; ids of another kind, which have no order to agree on, are refused."""
    kind = docs.schema[name].dataType
    whole = isinstance(kind, IntegralType | NullType) or (isinstance(kind, DecimalType) and kind.scale == 0)
    if not whole:
        raise TypeError(f"{name} must be a column of integers, not of {kind.simpleString()}")
    return F.col(name).cast("long").alias(name)


def frequent(rows: DataFrame, key: str, most: int, counters: int, least: int) -> DataFrame:
    """(key) of at most ``most`` longs that may stand in ``least`` rows or more, from a frequent-items sketch.

    Tasks keep sketches of ``counters`` counters of the Misra-Gries family, which are merged in two
    steps, so that no task reads all of them. With N rows, a key above N * 4 / (3 * counters) rows is
    found unless ``most`` others are more frequent; one that is found need not be frequent.
    """
    parts = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(F.expr(f"approx_top_k_accumulate({key}, {counters})").alias("sketch"))
    whole = parts.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(sketch, {counters})").alias("sketch"))
    found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {most})")).alias("t"))
    return found.where(F.col("t.count") >= least).select(F.col("t.item").alias(key))


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that no model may learn from; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def seeded_uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, array.offset * (8 if wide else 4)).astype(np.int64)
    body = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return body, at - at[0]


def steps(at: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a range of its own and stays whole."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A 2-d array as one binary value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over each row given by offsets; 0 for empty rows."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _word_table() -> np.ndarray:
    """For each byte, its value inside a word (ASCII letters folded), 0 for bytes that end words."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            out[b] = ord(chr(b).lower()) if b < 128 else b
    return out


WORD_BYTES = _word_table()
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = np.uint64(0x9FB21C651E98DF25)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps_ = np.full(max(n, 4096), _POWER, np.uint64)
        steps_[0] = 1
        _powers = np.cumprod(steps_, dtype=np.uint64)
    return _powers


def folded(data: np.ndarray) -> np.ndarray:
    """Word bytes with ASCII and Latin-1 capitals folded; 0 between words."""
    low = WORD_BYTES[data]
    if len(low) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][latin] += 0x20
    return low


def word_hashes(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of some rows, their rows, and their starts.

    ``inside`` is 0 for the bytes between words; other bytes are hashed by value and place in the word.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_word = inside != 0
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = is_word[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    values = _BYTE_VALUES[inside[starts[0] :]] * powers(int(spans.max()) + 1)[place]
    values[~is_word[starts[0] :]] = 0
    return mix64(np.add.reduceat(values, starts - starts[0])), np.searchsorted(at, starts, "right") - 1, starts

"""Line deduplication over overlapping windows of three consecutive lines.

Each window is hashed (two independently seeded 64-bit hashes of the three lines), the windows that
occur more than once are found over the whole corpus, and every occurrence but the first covers its
lines. Covered positions are merged per document and their lines removed. Windows that may be very
frequent are named by a sketch; their first places are aggregated and broadcast, and all others meet
by their hashes. All of it is DataFrame functions: the text itself moves once, for the join with the
covered positions of its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, frequent

WINDOW = 3
#: Windows that are broadcast at most, counters of the sketch, and occurrences from which a window counts as frequent.
MAX_HEAVY, COUNTERS, LEAST = 2048, 16_384, 64


def _line_hashes(lines: str, seed: int) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(F.lit(seed), x))


def _windows(hashed: str, width: int) -> Column:
    """Hashes of the overlapping windows of an array of line hashes, by zipping its shifted slices."""
    n = F.greatest(F.size(hashed) - (width - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(hashed, k + 1, n).alias(f"l{k}") for k in range(width)])
    return F.transform(shifted, lambda z: F.xxhash64(*[z[f"l{k}"] for k in range(width)]))


def repeated_positions(docs: DataFrame, width: int = WINDOW, max_heavy: int = MAX_HEAVY, counters: int = COUNTERS, least: int = LEAST) -> DataFrame:
    """(doc_id, starts): 0-based first lines of the windows that also occur earlier.

    Earlier is a smaller doc_id, or the same document and a smaller line number.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    seen = docs.where(F.col("doc_id").isNotNull()).select("doc_id", lines.alias("lines")).where(F.size("lines") >= width)
    seen = seen.select("doc_id", _line_hashes("lines", 1).alias("h1"), _line_hashes("lines", 2).alias("h2"))
    seen = seen.select("doc_id", F.arrays_zip(_windows("h1", width).alias("a"), _windows("h2", width).alias("b")).alias("w"))
    seen = cut(seen.select("doc_id", F.posexplode("w").alias("start", "h")).select("doc_id", "start", "h.a", "h.b"))
    names = cut(frequent(seen, "a", max_heavy, counters, least))  # at most max_heavy rows
    place, window = F.struct("doc_id", "start"), Window.partitionBy("a", "b")
    rare = seen.join(F.broadcast(names), "a", "left_anti").withColumn("first", F.min(place).over(window))
    common = seen.join(F.broadcast(names), "a", "left_semi")
    firsts = common.groupBy("a", "b").agg(F.min(place).alias("first"))  # as many rows as names, but for collisions
    later = rare.unionByName(common.join(F.broadcast(firsts), ["a", "b"])).where(place > F.col("first"))
    return later.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))


def line_dedup(docs: DataFrame, width: int = WINDOW, counts: bool = True, least: int = LEAST) -> DataFrame:
    """``docs`` without the lines of repeated windows; with ``counts`` also n_lines and n_removed, in place of columns so named.

    Lines end at ``\\n``; empty lines are lines. A document of fewer than ``width`` lines has no
    window and stays as it is, null and empty texts included; so do rows without a doc_id. Rows that
    repeat a doc_id are read as one another's copies only through their text: a window at the same
    doc_id and line is the same occurrence. ``text`` and, where there is one, ``n_chars`` are
    rewritten; other columns pass through. A text that loses all its lines becomes empty.
    """
    starts = repeated_positions(docs, width, least=least).select(F.col("doc_id").alias("__id"), F.col("starts").alias("__starts"))
    # split below the join, so that the lambdas above it index an attribute and split each text once
    split = docs.withColumn("__null", F.col("text").isNull()).withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n")).drop("text")
    joined = split.join(starts, F.col("doc_id") == F.col("__id"), "left")
    n = F.size("__lines")
    covered = F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.sequence(s, s + (width - 1)))))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), covered)
    left = F.when(F.col("__starts").isNull(), F.col("__lines")).otherwise(F.transform(kept, lambda i: F.get("__lines", i)))
    text = F.when(~F.col("__null"), F.array_join(left, "\n"))
    out = joined.withColumns({"__text": text, "__gone": F.coalesce(F.size(covered), F.lit(0))})
    replaced = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        shorter = F.length("__text").cast(docs.schema["n_chars"].dataType)
        replaced["n_chars"] = F.when(F.col("__starts").isNull(), F.col("n_chars")).otherwise(shorter)
    told = {"n_lines": n.cast("long"), "n_removed": F.col("__gone").cast("long")} if counts else {}
    names = [replaced[c].alias(c) if c in replaced else F.col(c) for c in docs.columns if c not in told]
    return out.select(*names, *[value.alias(name) for name, value in told.items()])

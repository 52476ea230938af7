"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (Spark's mergeable frequent-items sketch of that family) names digests that may
be frequent. Their exact counts and winners are then computed, with partial aggregation, and the
verified ones, at most ``max_heavy`` rows, are broadcast: all their copies are decided where they
lie. Every other digest is decided by an ordinary shuffle; the summary's guarantee bounds the share
of rows that any of them has, so no task gets a large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, frequent

#: Verified digests that are broadcast at most, counters of the sketch, and rows from which a digest counts as frequent.
MAX_HEAVY, COUNTERS, LEAST = 2048, 16_384, 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, digest): SHA-256 of the whole text in UTF-8, null counting as empty, and a number of the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def heavy_hitters(keys: DataFrame, max_heavy: int = MAX_HEAVY, counters: int = COUNTERS, least: int = LEAST) -> DataFrame:
    """Verified (digest, winner, group_size) of digests with at least ``least`` rows, at most ``max_heavy``."""
    names = frequent(keys.select(F.xxhash64("digest").alias("hash")), "hash", max_heavy, counters, least)
    found = keys.withColumn("hash", F.xxhash64("digest")).join(F.broadcast(names), "hash", "left_semi")
    return found.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") >= least)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = MAX_HEAVY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (identical after no change) the row with the largest id stays. Null texts equal
    the empty text. A null id loses against any other. Of rows that repeat the largest id of their
    text one stays, and of a text all of whose ids are null one row. Extra columns are ignored. An
    empty table gives an empty result.
    """
    keys = cut(digests(docs, id_col, text_col))
    heavy = cut(heavy_hitters(keys, max_heavy))  # at most max_heavy rows
    w = Window.partitionBy("digest")
    winner = F.max(F.struct("doc_id", "row"))  # nulls come first, so any id beats them
    rest = keys.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    rest = rest.select("doc_id", "row", "digest", winner.over(w).alias("winner"), F.count(F.lit(1)).over(w).alias("group_size"))
    known = heavy.select("digest", "winner", "group_size")
    frequent_ = keys.join(F.broadcast(known), "digest").select("doc_id", "row", "digest", "winner", "group_size")
    return rest.unionByName(frequent_).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

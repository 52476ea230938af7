"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partkin.llm.line_dedup import line_dedup
from partkin.llm.mixing import mixed
from partkin.llm.near_dedup import without_near_copies
from partkin.llm.packing import pack
from partkin.llm.quality import KEEP_AT, learn, with_scores
from partkin.llm.shared import cut, table
from partkin.runtime import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without any label all of them."""
    model = learn(docs, table(ship(spark), sf_dir, "labels"))
    if not model.learned_from:
        return docs
    return with_scores(docs, model, score_col="__score").where(F.col("__score") >= KEEP_AT).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated three-line windows."""
    return line_dedup(docs, counts=False)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    ship(spark)
    return without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes."""
    ship(spark)
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in their sequences; copies of a document are packed each."""
    ship(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing, signatures and boosted trees are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is kept in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs

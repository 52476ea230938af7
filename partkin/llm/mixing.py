"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source is dealt by a seeded hash into shards of bounded size, and these into groups. The words
that the mix should hold are cut into blocks of equal size; Sainte-Lague gives each source its number
of blocks (the highest quotients of target / 0.5, 1.5, 2.5, ... win), and gives each group of a
source, and each shard of a group, its quota of those in the same way. A shard puts its documents in a seeded order, passes over them whole as often
as its quota allows, and takes the first blocks of one more pass for what is left.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import cut

#: Words are runs of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Sources whose table is broadcast; with more, Spark chooses the join.
MOST_SOURCES = 10_000


def water_level(sizes: np.ndarray, weights: np.ndarray, share: float, epochs: float) -> np.ndarray:
    """Targets w * level, stopped at epochs * size, that sum to share * sum(sizes).

    Stopping the sources above their cap and sharing the excess by weight, again until none is above,
    ends at the same level; here it is found by taking sources in the order in which they stop.
    """
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    caps, left, open_weight = epochs * sizes, share * sizes.sum(), weights.sum()
    targets = np.zeros(len(sizes))
    for k in np.argsort(caps / weights, kind="stable"):
        if open_weight <= 0 or caps[k] > weights[k] * left / open_weight:
            break
        targets[k] = caps[k]
        left -= caps[k]
        open_weight -= weights[k]
        weights = weights.copy()
        weights[k] = 0.0
    if open_weight > 0:
        targets += np.where(weights > 0, weights * left / open_weight, 0.0)
    return np.minimum(targets, caps)


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients votes / (2 s + 1); ties to the earlier entry; at most ``most`` each.

    The quotients that win are those above some price, found by bisection; the few between its last
    two values are compared one by one, so the result is the one of seat-by-seat allotment.
    """
    votes = np.asarray(votes, float)
    most = np.full(len(votes), np.iinfo(np.int64).max // 4) if most is None else np.asarray(most, np.int64)
    seats = int(min(seats, np.where(votes > 0, most, 0).sum())) if len(votes) else 0
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def won(price: float) -> np.ndarray:
        return np.minimum(np.floor(votes / price + 0.5).astype(np.int64), np.where(votes > 0, most, 0))

    low, high = votes.sum() / (4.0 * seats + 4.0 * len(votes)), 4.0 * votes.max() + 1.0
    while won(low).sum() < seats:
        low /= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if middle in (low, high):
            break
        low, high = (middle, high) if won(middle).sum() >= seats else (low, middle)
    out = won(high)
    while out.sum() < seats:  # ties at the last price
        open_ = (out < most) & (votes > 0)
        out[np.argmax(np.where(open_, votes / (2.0 * out + 1.0), -1.0))] += 1
    return out


def _quotas(votes: str, blocks: str, block: int, epochs: int, names: list[str], kind: str) -> tuple[object, str]:
    """A function that deals a parent's blocks to its rows by Sainte-Lague, and its schema."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.lexsort([rows.column(c).to_numpy() for c in reversed(names)])
        rows = rows.take(pa.array(order))
        own = rows.column(votes).to_numpy()
        quota = sainte_lague(own, int(rows.column(blocks)[0].as_py()), -(-epochs * own // block))
        return pa.table([*[rows.column(c) for c in names], rows.column(votes), pa.array(quota)], [*names, votes, "quota"])

    return run, kind


def _hashed(seed: int, *more: str) -> Column:
    """A seeded hash of a row's id, and of more columns, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *more).cast("binary"))


def _dealt(seed: int, parts: str) -> Column:
    """Which of ``parts`` a row goes to; its text takes part, so that rows of one id are spread too."""
    return (F.conv(F.substring(_hashed(seed, "__text"), 1, 8), 16, 10).cast("long") % F.col(parts)).cast("int")


def _planned(docs: DataFrame, weights: tuple[float, ...], share: float, epochs: int, block_words: int, shard_docs: int, seed: int) -> DataFrame:
    """``docs`` with __size, __source_size, __target and __taken, each row for itself.

    A source's documents are dealt by hash to groups of shards, and those to shards, of about
    ``shard_docs`` rows. The driver sees the sources and their groups, of ``shard_docs`` shards each;
    shards get their quotas where they lie.
    """
    measured = docs.withColumns(
        {"__size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "__text": F.md5(F.coalesce("text", F.lit("")).cast("binary"))}
    )
    small = cut(measured.select("source", "__size", "doc_id", "__text"))
    # Spark and Python both order valid UTF-8 by code point
    totals = sorted(
        (r.asDict() for r in small.groupBy("source").agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()),
        key=lambda r: (r["source"] is None, r["source"] or ""),
    )
    size = np.array([r["size"] for r in totals], np.int64)
    weight = np.array([weights[k % len(weights)] for k in range(len(totals))])
    target = water_level(size, weight, share, epochs)
    shards = [max(1, math.ceil(r["docs"] / shard_docs)) for r in totals]
    positive = target[target > 0]
    block = int(max(1, min([block_words, *(positive // 200)])))

    spark = docs.sparkSession
    sources = spark.createDataFrame(
        [(k, r["source"], int(size[k]), float(target[k]), math.ceil(n / shard_docs), min(n, shard_docs)) for k, (r, n) in enumerate(zip(totals, shards, strict=True))],
        "__rank int, __source string, __source_size long, __target double, __groups int, __shards int",
    )
    if len(totals) <= MOST_SOURCES:  # a row of some dozen bytes each
        sources = F.broadcast(sources)

    def dealt(rows: DataFrame) -> DataFrame:
        met = rows.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        return met.withColumns({"__group": _dealt(seed + 2, "__groups"), "__shard": _dealt(seed + 1, "__shards")})

    words = cut(dealt(small).groupBy("__rank", "__group", "__shard").agg(F.sum("__size").alias("__words")))
    groups = words.groupBy("__rank", "__group").agg(F.sum("__words").alias("words")).orderBy("__rank", "__group").collect()
    rank = np.array([r["__rank"] for r in groups], np.int64)
    own = np.array([r["words"] for r in groups], np.int64)
    blocks = sainte_lague(target, int(round(float(target.sum()) / block)))
    # groups are in order of rank, so each source is a run of them
    edges = np.searchsorted(rank, np.arange(len(totals) + 1))
    quota = [sainte_lague(own[a:b], int(n), -(-epochs * own[a:b] // block)) for n, a, b in zip(blocks, edges[:-1], edges[1:], strict=True)]
    parents = spark.createDataFrame(
        [(r["__rank"], r["__group"], int(q)) for r, q in zip(groups, np.concatenate([np.zeros(0, np.int64), *quota]), strict=True)], "__rank int, __group int, __blocks long"
    )
    run, kind = _quotas("__words", "__blocks", block, epochs, ["__rank", "__group", "__shard"], "__rank int, __group int, __shard int, __words long, quota long")
    plan = words.join(parents, ["__rank", "__group"]).groupBy("__rank", "__group").applyInArrow(run, kind)
    plan = plan.withColumn("__take", F.least(F.col("quota") * block, F.col("__words") * epochs)).drop("quota")

    shard = ["__rank", "__group", "__shard"]
    order = [_hashed(seed), F.col("doc_id"), F.col("__text"), F.col("__size")]
    upto = F.sum("__size").over(Window.partitionBy(*shard).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt(measured).withColumn("__upto", upto).join(plan, shard)
    whole = F.when(F.col("__words") > 0, F.floor(F.col("__take") / F.col("__words"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("__take") - whole * F.col("__words")
    part = F.greatest(F.lit(0), F.least(F.col("__size"), rest - (F.col("__upto") - F.col("__size"))))
    out = placed.withColumn("__taken", (whole * F.col("__size") + part).cast("long"))
    return out.select(*docs.columns, "__size", "__source_size", "__target", "__taken")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    epochs: int = 2,
    block_words: int = 1024,
    shard_docs: int = 4096,
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. Their targets sum to
    ``share`` of all words and stop at ``epochs`` times the source's words (water_level). ``taken``
    counts the document's words in the mix, repeats included, at most ``epochs`` times its size; a
    block's edge may cut a document. A null or empty text has size 0 and takes nothing; a source of
    only such texts has target 0. Blocks shrink below ``block_words`` where the smallest positive
    target asks for it, to keep every source within one block, or 1 %, of its target. Order within a
    shard is by seeded hash, then doc_id and text, so reruns agree; rows that repeat a doc_id, or are
    equal altogether, count each. Shards hold about ``shard_docs`` rows at every size; the driver
    sees one row for each source and each ``shard_docs`` shards.
    """
    narrow = docs.select("doc_id", "source", "text")
    placed = _planned(narrow, weights, share, epochs, block_words, shard_docs, seed)
    names = {"size": "__size", "source_size": "__source_size", "target": "__target", "taken": "__taken"}
    return placed.select("doc_id", "source", *[F.col(c).alias(k) for k, c in names.items()])


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    epochs: int = 2,
    block_words: int = 1024,
    shard_docs: int = 4096,
    seed: int = 17,
) -> DataFrame:
    """``docs`` as ``mix`` takes them: whole copies, and for a rest of words the text up to its last.

    A document that the mix takes no word of goes, unless it has none (it takes no room). ``n_chars``,
    where there is one, follows the text. Copies carry the id of their document; rows that repeat an
    id are taken each by themselves, those without one too.
    """

    @arrow_udf("string")
    def head(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        word = re.compile(WORD)
        for texts, counts in batches:
            out = []
            for text, count in zip(texts.to_pylist(), counts.to_pylist(), strict=True):
                end = 0
                for _, found in zip(range(count), word.finditer(text), strict=False):
                    end = found.end()
                out.append(text[:end])
            yield pa.array(out, pa.string())

    met = _planned(docs, weights, share, epochs, block_words, shard_docs, seed)
    some = F.greatest("__size", F.lit(1))
    copies = F.when(F.col("__size") == 0, F.lit(1)).otherwise(F.floor(F.col("__taken") / some).cast("int"))
    rest = F.when(F.col("__size") == 0, F.lit(0)).otherwise(F.col("__taken") % some)
    # one row for each whole copy (0 words to cut at) and one for the rest
    each = F.concat(F.array_repeat(F.lit(0).cast("long"), copies), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    met = met.withColumn("__cut", F.explode(each))
    short = F.col("__cut") > 0
    texts = met.withColumn("__head", F.when(short, head(F.when(short, F.col("text")).otherwise(F.lit("")), F.col("__cut").cast("int"))))
    new = {"text": F.when(short, F.col("__head")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(short, F.length("__head").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return texts.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])

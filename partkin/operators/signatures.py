"""Sub-assemblies as multisets of components, and what of the newest variant already exists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import same_amount
from ..runtime import kept
from ..schemas import CLASSES


@dataclass(frozen=True)
class Thresholds:
    max_abs_diff: int = 3
    diff_ratio: float = 0.25

    def __post_init__(self) -> None:
        if self.max_abs_diff < 1 or not 0 < self.diff_ratio <= 1:
            raise ValueError("max_abs_diff is at least 1, and diff_ratio above 0 and at most 1")


#: Up to this many components a signature is matched by deletions, beyond by a prefix.
DELETIONS_UP_TO = 12


def signature_items(canonical: DataFrame) -> DataFrame:
    """(sub_assembly_id, variant_id, component_id, unit, quantity, lines, read).

    The unit is that of the component's earliest readable line, the quantity the sum of its lines in
    that unit, added in order of rows so that it doesn't depend on how they are dealt.
    """
    amount = F.when(F.col("quantity").isNotNull(), F.struct("row_number", "unit", "quantity"))
    got = (
        canonical.where(F.col("parent_id") != "")
        .groupBy(F.col("parent_id").alias("sub_assembly_id"), "variant_id", "component_id")
        .agg(F.array_sort(F.collect_list(amount)).alias("amounts"), F.count(F.lit(1)).alias("lines"))
    )
    unit = F.when(F.size("amounts") > 0, F.get("amounts", F.lit(0))["unit"])
    got = got.withColumn("unit", unit)
    total = F.aggregate(F.transform("amounts", lambda a: F.when(a["unit"] == F.col("unit"), a["quantity"]).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return got.select("sub_assembly_id", "variant_id", "component_id", "unit", F.when(F.col("unit").isNotNull(), total).alias("quantity"), "lines")


def lines_left_out(lines: DataFrame, items: DataFrame) -> DataFrame:
    """(sub_assembly_id, lines_left_out): lines without a component, and those of unreadable components."""
    unplaced = lines.where((F.col("parent_id") != "") & (F.col("child_id") == "")).select(F.col("parent_id").alias("sub_assembly_id"), F.lit(1).cast("long").alias("n"))
    unread = items.select("sub_assembly_id", F.when(F.col("unit").isNull(), F.col("lines")).otherwise(F.lit(0)).alias("n"))
    return unplaced.unionByName(unread).groupBy("sub_assembly_id").agg(F.sum("n").alias("lines_left_out"))


def signatures(items: DataFrame) -> DataFrame:
    """(sub_assembly_id, variant_id, items): sorted by component; a sub-assembly nothing of which is readable has none."""
    item = F.when(F.col("unit").isNotNull(), F.struct(F.col("component_id").alias("c"), F.col("unit").alias("u"), F.col("quantity").alias("q")))
    return items.groupBy("sub_assembly_id", "variant_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def budget(a: Column, b: Column, t: Thresholds) -> Column:
    """Differences that two sizes allow, computed in doubles."""
    return F.least(F.lit(t.max_abs_diff), F.ceil(F.lit(float(t.diff_ratio)) * F.least(a, b).cast("double")).cast("int"))


def with_names(signatures_: DataFrame) -> DataFrame:
    """``signatures_`` with the names of their components, which comparing reads for every pair."""
    return signatures_.withColumn("names", F.transform("items", lambda x: x["c"]))


def compared(pairs: DataFrame, t: Thresholds) -> DataFrame:
    """``pairs`` with n_parts, n_qty and reuse_class; a and a_names are the ancestor's, b and b_names the target's.

    Items that are equal altogether are counted by an intersection; only where shared parts are not
    all equal are their amounts looked at one by one.
    """
    allowed = budget(F.size("a"), F.size("b"), t)
    shared = F.size(F.array_intersect("a_names", "b_names"))
    out = pairs.withColumn("__shared", shared).withColumn("n_parts", F.size("a") + F.size("b") - 2 * F.col("__shared"))
    out = out.where(F.col("n_parts") <= allowed)
    changed = F.size(F.filter("a", lambda x: F.exists("b", lambda y: (y["c"] == x["c"]) & ~same_amount(x["q"], x["u"], y["q"], y["u"]))))
    out = out.withColumn("n_qty", F.when(F.size(F.array_intersect("a", "b")) == F.col("__shared"), F.lit(0)).otherwise(changed)).drop("__shared")
    kind = F.when((F.col("n_parts") == 0) & (F.col("n_qty") == 0), F.lit("reused")).when((F.col("n_parts") <= allowed) & (F.col("n_qty") <= allowed), F.lit("reusable")).otherwise(F.lit("specific"))
    return out.withColumn("reuse_class", kind)


def _blocking(sigs: DataFrame, id_: str, t: Thresholds) -> DataFrame:
    """(key, id, n): a row for each key that any signature within the budget shares; n is the size.

    Small ones share a set of components left when each has lost at most its own budget; large ones,
    whose subsets would be many, share two of their first budget + 2 components in hash order, since
    each lacks at most budget of the other's. Sizes around the border take both, since alike
    signatures differ in size by the budget at most.
    """
    sized = sigs.select(id_, F.transform("names", lambda x: F.xxhash64(x)).alias("names")).withColumn("n", F.size("names"))
    own = F.least(F.lit(t.max_abs_diff), F.ceil(F.lit(float(t.diff_ratio)) * F.col("n").cast("double")).cast("int"))
    small = sized.where(F.col("n") <= DELETIONS_UP_TO + t.max_abs_diff).withColumn("own", own).withColumn("left", F.array("names"))
    for k in range(t.max_abs_diff):
        fewer = F.flatten(F.transform("left", lambda s: F.transform(s, lambda x: F.array_remove(s, x))))
        small = small.withColumn("left", F.when(F.col("own") > k, F.array_distinct(F.concat("left", fewer))).otherwise(F.col("left")))
    keys = F.transform("left", lambda s: F.xxhash64(F.lit(0), s))
    small = small.withColumn("key", F.explode(F.array_distinct(keys)))
    large = sized.where(F.col("n") > DELETIONS_UP_TO).withColumn("first", F.slice(F.array_sort("names"), 1, t.max_abs_diff + 2))
    pairs = F.flatten(F.transform("first", lambda x: F.transform(F.filter("first", lambda y: y > x), lambda y: F.xxhash64(F.lit(1), x, y))))
    large = large.withColumn("key", F.explode(pairs))
    return small.select("key", id_, "n").unionByName(large.select("key", id_, "n"))


def chronology(variants: DataFrame) -> DataFrame:
    """(variant_id, role): the newest dated variant, by date then id, and those strictly older."""
    dated = variants.where(F.col("design_date").isNotNull() & (F.col("id") != "")).select("id", "design_date")
    newest = dated.agg(F.max(F.struct("design_date", "id")).alias("m"))
    both = dated.crossJoin(F.broadcast(newest))  # one row
    role = F.when(F.col("id") == F.col("m.id"), F.lit("target")).when(F.col("design_date") < F.col("m.design_date"), F.lit("ancestor"))
    return both.select(F.col("id").alias("variant_id"), role.alias("role")).where(F.col("role").isNotNull()).groupBy("variant_id").agg(F.max("role").alias("role"))


def backtest(sigs: DataFrame, variants: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(sub_assembly_id, variant_id, reuse_class, ancestor_id, n_parts, n_qty) of the newest variant.

    The best ancestor is the one of the better class, then of fewer differences, then of the smaller
    id; "" where there is none. An empty signature is specific. Ancestors that are equal item for
    item are one candidate, under their smallest id, and targets that are equal item for item are
    compared once. Equal ones are found by their items, all others through shared blocking keys, so no
    pair is looked at that can't be alike. Only numbers travel to find the pairs; items are fetched for
    the different ones.
    """
    rows = with_names(kept(sigs.join(F.broadcast(chronology(variants)), "variant_id")))  # a row for each variant
    hashed = F.xxhash64("items").alias("hash")  # sorted by first, so that few items are compared
    older = rows.where((F.col("role") == "ancestor") & (F.size("items") > 0)).groupBy(hashed, "items").agg(F.min("sub_assembly_id").alias("ancestor_id"))
    older = with_names(kept(older.drop("hash").withColumn("aid", F.monotonically_increasing_id())))
    target = rows.where(F.col("role") == "target").select("sub_assembly_id", "variant_id", "items")
    same = target.select("items").distinct().join(older.select("items", F.col("ancestor_id").alias("same_id")), "items", "left")
    same = with_names(kept(same.withColumn("tid", F.monotonically_increasing_id())))
    rest = same.where(F.col("same_id").isNull() & (F.size("items") > 0))
    left, right = _blocking(rest, "tid", t), _blocking(older, "aid", t).withColumnRenamed("n", "m")
    pairs = left.join(right, "key").where(F.abs(F.col("n") - F.col("m")) <= budget(F.col("n"), F.col("m"), t)).select("tid", "aid").distinct()
    pairs = pairs.join(rest.select("tid", F.col("items").alias("b"), F.col("names").alias("b_names")), "tid")
    pairs = pairs.join(older.select("aid", "ancestor_id", F.col("items").alias("a"), F.col("names").alias("a_names")), "aid")
    near = compared(pairs, t).where(F.col("reuse_class") != "specific")
    rank = F.when(F.col("reuse_class") == "reused", 0).otherwise(1)
    best = near.groupBy("tid").agg(F.min(F.struct(rank.alias("rank"), (F.col("n_parts") + F.col("n_qty")).alias("total"), "ancestor_id", "n_parts", "n_qty")).alias("m"))
    out = target.join(same.join(best, "tid", "left"), "items")
    kind = F.when(F.col("same_id").isNotNull() | (F.col("m.rank") == 0), F.lit("reused")).when(F.col("m").isNotNull(), F.lit("reusable")).otherwise(F.lit("specific"))
    return out.select(
        "sub_assembly_id",
        "variant_id",
        kind.alias("reuse_class"),
        F.coalesce("same_id", "m.ancestor_id", F.lit("")).alias("ancestor_id"),
        F.when(F.col("same_id").isNotNull(), F.lit(0)).otherwise(F.col("m.n_parts")).cast("long").alias("n_parts"),
        F.when(F.col("same_id").isNotNull(), F.lit(0)).otherwise(F.col("m.n_qty")).cast("long").alias("n_qty"),
    )


def class_counts(predictions: DataFrame) -> DataFrame:
    """All classes with their counts, zeros too."""
    names = predictions.sparkSession.createDataFrame([(c,) for c in CLASSES], "reuse_class string")
    return names.join(predictions.groupBy("reuse_class").agg(F.count(F.lit(1)).alias("n")), "reuse_class", "left").select("reuse_class", F.coalesce("n", F.lit(0)).alias("n"))


def backtest_diff(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """(sub_assembly_id, component_id, change, left and right amounts) of every reusable one, from its ancestor."""
    won = kept(predictions.where(F.col("reuse_class") == "reusable").select("sub_assembly_id", "ancestor_id"))
    read = items.where(F.col("unit").isNotNull())
    b = won.join(read, "sub_assembly_id").select("sub_assembly_id", "component_id", F.col("quantity").alias("right_quantity"), F.col("unit").alias("right_unit"))
    a = won.join(read.select(F.col("sub_assembly_id").alias("ancestor_id"), "component_id", F.col("quantity").alias("left_quantity"), F.col("unit").alias("left_unit")), "ancestor_id").drop("ancestor_id")
    both = a.join(b, ["sub_assembly_id", "component_id"], "full")
    same = same_amount(F.col("left_quantity"), F.col("left_unit"), F.col("right_quantity"), F.col("right_unit"))
    change = F.when(F.col("left_unit").isNull(), F.lit("added")).when(F.col("right_unit").isNull(), F.lit("removed")).when(~same, F.lit("quantity_changed"))
    return both.withColumn("change", change).where(F.col("change").isNotNull())

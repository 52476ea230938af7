"""What makes a reuse unsafe: components whose rows disagree, and notes that speak against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import unpivoted

CONFLICTS = ("unit", "supplier", "cost")
NO_VARIANT = "(no variant)"


def _shown_variant() -> Column:
    return F.when(F.col("variant_id") == "", F.lit(NO_VARIANT)).otherwise(F.col("variant_id"))


def conflict_values(canonical: DataFrame, attributes: tuple[str, ...] = CONFLICTS) -> DataFrame:
    """Each value of each attribute that a component shows two or more of.

    (component_id, ordinal, attribute, value, n_values, row_number, line_id, variants): the earliest
    row that shows the value, and the variants that carry it.
    """
    shown = canonical.withColumn("variant_id", _shown_variant())
    seen = unpivoted(shown, {a: CONFLICTS.index(a) for a in attributes}, "component_id", "variant_id")
    value = seen.groupBy("component_id", "ordinal", "attribute", "value").agg(
        F.min(F.struct("row_number", "line_id")).alias("first"), F.array_sort(F.collect_set("variant_id")).alias("variants")
    )
    several = value.withColumn("n_values", F.count(F.lit(1)).over(Window.partitionBy("component_id", "attribute"))).where("n_values > 1")
    return several.select("component_id", "ordinal", "attribute", "value", "n_values", "first.row_number", "first.line_id", "variants")


def usual_spelling(canonical: DataFrame) -> DataFrame:
    """(component_id, spelling): the reference as it is written most often, ties to the first in order."""
    from ..functions.text import strip

    counted = canonical.groupBy("component_id", strip(F.col("component_ref_raw")).alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("component_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "spelling"))["spelling"].alias("spelling"))


def note_contradictions(linked: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per linked fact, component and variant that carries it, with that variant's first row."""
    carried = (
        canonical.withColumn("carrier", _shown_variant())
        .groupBy("component_id", "carrier")
        .agg(F.min(F.struct("row_number", "line_id")).alias("first"))
        .select("component_id", "carrier", F.col("first.row_number").alias("bom_row"), F.col("first.line_id").alias("line_id"))
    )
    return linked.where(F.col("component_id").isNotNull()).join(carried, "component_id")


def flags(conflicts: DataFrame, contradictions: DataFrame) -> DataFrame:
    """(component_id, labels): all that speaks against a part anywhere: attributes, then kinds of notes."""
    kinds = F.when(F.col("kind") == "obsolescence", 1).when(F.col("kind") == "replacement", 0).otherwise(2)
    said = conflicts.select("component_id", F.col("ordinal"), F.col("attribute").alias("label"))
    said = said.unionByName(contradictions.select("component_id", (kinds + 10).alias("ordinal"), F.col("kind").alias("label"))).distinct()
    return said.groupBy("component_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "label"))), lambda x: x["label"]).alias("labels"))


def flagged_parts(predictions: DataFrame, items: DataFrame, flags_: DataFrame) -> DataFrame:
    """(sub_assembly_id, component_id, labels) of the parts of every proposed reuse that are flagged."""
    reuses = predictions.where(F.col("reuse_class") != "specific").select("sub_assembly_id")
    return items.join(reuses, "sub_assembly_id").join(flags_, "component_id").select("sub_assembly_id", "component_id", "labels")


def verdict_counts(groups: DataFrame) -> DataFrame:
    """All verdicts with their counts, zeros too."""
    from ..schemas import VERDICTS

    names = groups.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    return names.join(groups.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")), "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))

"""Raw tables to typed ones: every row and every raw cell kept, every unreadable cell counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.raw import Raw

ISSUE = "array<struct<field:string,raw:string,reason:string>>"


@dataclass(frozen=True)
class Dataset:
    """Normalized tables; ``issues`` has a row for each unreadable cell."""

    variants: DataFrame
    lines: DataFrame
    notes: DataFrame
    issues: DataFrame


def _issue(field: str, reason: Column) -> Column:
    return F.when(reason.isNotNull(), F.struct(F.lit(field).alias("field"), F.col(field).alias("raw"), reason.alias("reason")))


def _issues(*found: Column) -> Column:
    return F.array_compact(F.array(*found)).cast(ISSUE).alias("issues")


def _with_raw(df: DataFrame) -> DataFrame:
    """``df`` with composed cells, and its cells as they were in ``__raw``."""
    cells = [c for c in df.columns if c != "row_number"]
    return T.composed(df.withColumn("__raw", F.struct(*cells, "row_number")), *cells)


def _raw(df: DataFrame) -> Column:
    return (F.col("__raw") if "__raw" in df.columns else F.struct(*df.columns)).alias("raw")


def _cell(df: DataFrame, c: str) -> Column:
    return F.col(f"__raw.{c}") if "__raw" in df.columns else F.col(c)


def _empty(key: Column, reason: str = "empty") -> Column:
    return F.when(key == "", F.lit(reason))


def variants(raw: DataFrame) -> DataFrame:
    key = T.variant_key(F.col("variant_id"))
    again = F.row_number().over(Window.partitionBy("id").orderBy("row_number")) > 1
    read = raw.select(
        key.alias("id"),
        _cell(raw, "variant_id").alias("raw_id"),
        T.text_key(F.col("name")).alias("name"),
        T.iso_date(F.col("design_date")).alias("design_date"),
        T.text_key(F.col("region")).alias("region"),
        T.integer(F.col("seats")).alias("seats"),
        T.integer(F.col("bike_spaces")).alias("bike_spaces"),
        T.text_key(F.col("traction")).alias("traction"),
        "row_number",
        _raw(raw),
        _issues(
            _issue("variant_id", _empty(key)),
            _issue("name", _empty(T.text_key(F.col("name")))),
            _issue("design_date", T.date_reason(F.col("design_date"))),
            _issue("region", _empty(T.text_key(F.col("region")))),
            _issue("seats", T.integer_reason(F.col("seats"))),
            _issue("bike_spaces", T.integer_reason(F.col("bike_spaces"))),
            _issue("traction", _empty(T.text_key(F.col("traction")))),
        ),
    )
    twice = F.struct(F.lit("variant_id").alias("field"), F.col("raw_id").alias("raw"), F.lit("duplicate variant").alias("reason"))
    return read.withColumn("issues", F.when((F.col("id") != "") & again, F.array_append("issues", twice)).otherwise(F.col("issues")))


def _named(raw: DataFrame, known: DataFrame) -> DataFrame:
    """``raw`` with its variant's key, and whether a variant declares that."""
    keyed = raw.withColumn("__key", T.variant_key(F.col("variant_id")))
    return keyed.join(known.select(F.col("id").alias("__id")).distinct(), F.col("__key") == F.col("__id"), "left")


def _variant_reason() -> Column:
    return F.when(F.col("__key") == "", F.lit("empty")).when(F.col("__id").isNull(), F.lit("unknown variant"))


def lines(raw: DataFrame, known: DataFrame) -> DataFrame:
    """One row per BOM line; parent_id is "" unless a declared variant and a reference name one."""
    c = F.col
    keyed = T.with_amounts(_named(raw, known)).withColumns(
        {
            "__parent": T.reference_key(c("sub_assembly_ref")),
            "__child": T.reference_key(c("component_ref")),
            "__sub": T.text_key(c("sub_assembly_designation")),
            "__designation": T.text_key(c("designation")),
            "__supplier": T.text_key(c("supplier")),
            "__cost": T.strip(c("unit_cost_eur")),
        }
    )
    keyed = keyed.withColumn("__cost_reason", T.stripped_number_reason(c("__cost")))
    named = (c("__parent") != "") & (c("__key") != "") & c("__id").isNotNull()
    return keyed.select(
        "row_number",
        _cell(raw, "line_id").alias("line_id"),
        c("__key").alias("variant_id"),
        F.when(named, F.concat("__key", F.lit(":"), "__parent")).otherwise(F.lit("")).alias("parent_id"),
        c("__child").alias("child_id"),
        c("amount").alias("quantity"),
        c("amount_unit").alias("unit"),
        _cell(raw, "sub_assembly_ref").alias("sub_assembly_ref_raw"),
        c("__parent").alias("sub_assembly_key"),
        c("__sub").alias("sub_assembly_designation"),
        _cell(raw, "component_ref").alias("component_ref_raw"),
        c("__designation").alias("designation"),
        c("__supplier").alias("supplier"),
        _cell(raw, "supplier").alias("supplier_raw"),
        F.when(c("__cost_reason").isNull(), F.replace("__cost", F.lit(","), F.lit(".")).try_cast("double")).alias("cost"),
        _raw(raw),
        _issues(
            _issue("line_id", _empty(T.strip(c("line_id")))),
            _issue("variant_id", _variant_reason()),
            _issue("sub_assembly_ref", _empty(c("__parent"), "empty reference")),
            _issue("component_ref", _empty(c("__child"), "empty reference")),
            _issue("quantity", c("quantity_reason")),
            _issue("unit", c("unit_reason")),
            _issue("sub_assembly_designation", _empty(c("__sub"))),
            _issue("designation", _empty(c("__designation"))),
            _issue("supplier", _empty(c("__supplier"))),
            _issue("unit_cost_eur", c("__cost_reason")),
        ),
    )


def notes(raw: DataFrame, known: DataFrame) -> DataFrame:
    c = F.col
    return _named(raw, known).select(
        "row_number",
        _cell(raw, "note_id").alias("note_id"),
        c("__key").alias("variant_id"),
        T.iso_date(c("date")).alias("date"),
        _cell(raw, "text").alias("text"),
        _raw(raw),
        _issues(
            _issue("note_id", _empty(T.strip(c("note_id")))),
            _issue("text", _empty(T.strip(c("text")))),
            _issue("variant_id", _variant_reason()),
            _issue("date", T.date_reason(c("date"))),
        ),
    )


def _exploded(df: DataFrame, file: str, row_id: str) -> DataFrame:
    return df.select(F.lit(file).alias("source_file"), "row_number", F.col(row_id).alias("row_id"), F.explode("issues").alias("i")).select(
        "source_file", "row_number", "row_id", "i.field", "i.raw", "i.reason"
    )


def normalize(raw: Raw, compose: bool = True) -> Dataset:
    """``compose`` puts the cells that become keys in canonical composition first.

    Raw columns keep their characters either way; tables known to be ASCII need no composing.
    """
    if compose:
        raw = Raw(*[_with_raw(df) for df in (raw.variants, raw.bom, raw.notes)])
    v = variants(raw.variants)
    li, no = lines(raw.bom, v), notes(raw.notes, v)
    issues = _exploded(v, "variants.csv", "raw_id").unionByName(_exploded(li, "bom.csv", "line_id")).unionByName(_exploded(no, "notes.csv", "note_id"))
    return Dataset(v.drop("issues"), li.drop("issues"), no.drop("issues"), issues)


def components(lines_: DataFrame) -> DataFrame:
    """Candidate groups: one per reference key, with the raw references and designations it shows."""
    return (
        lines_.where(F.col("child_id") != "")
        .groupBy(F.col("child_id").alias("id"))
        .agg(
            F.array_sort(F.collect_set("component_ref_raw")).alias("raw_references"),
            F.array_sort(F.collect_set(F.when(F.col("designation") != "", F.col("designation")))).alias("designations"),
        )
    )


def sub_assemblies(lines_: DataFrame) -> DataFrame:
    return (
        lines_.where(F.col("parent_id") != "")
        .groupBy(F.col("parent_id").alias("id"), "variant_id", F.col("sub_assembly_key").alias("reference_key"))
        .agg(
            F.array_sort(F.collect_set("sub_assembly_ref_raw")).alias("raw_references"),
            F.array_sort(F.collect_set(F.when(F.col("sub_assembly_designation") != "", F.col("sub_assembly_designation")))).alias("designations"),
        )
    )


def suppliers(lines_: DataFrame) -> DataFrame:
    return lines_.where(F.col("supplier") != "").groupBy(F.col("supplier").alias("id")).agg(F.array_sort(F.collect_set("supplier_raw")).alias("raw_names"))

"""The whole run: raw directory to tables, findings and predictions, and their artifacts.

Tables stay DataFrames, and ``write_tables`` keeps them as Parquet whatever their size. The JSON
artifacts describe one company's parts, so they are collected and rendered on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baselines, checks, findings as findings_op, notes as notes_op, resolve, signatures as sig
from ..operators.normalize import Dataset, components, normalize, sub_assemblies, suppliers
from ..operators.notes import KeywordReader, NoteReader
from ..runtime import cut, tuned
from ..schemas import CONFLICT_RULES, DUPLICATE_REFERENCE, GROUP_CONFLICT, GROUP_SPLIT, KINDS, NOTE_RULES
from ..sources import artifacts as A
from ..sources.raw import Raw, read_raw


@dataclass(frozen=True)
class Result:
    raw: Raw
    dataset: Dataset
    groups: DataFrame
    canonical: DataFrame
    facts: DataFrame
    linked: DataFrame
    items: DataFrame
    signatures: DataFrame
    predictions: DataFrame
    findings: DataFrame
    reader: str
    notes_read: int
    invalid: int


def analyse(raw: Raw, thresholds: sig.Thresholds, reader: NoteReader | None = None) -> Result:
    """Everything between the raw tables and the artifacts; what is used often is computed once and kept."""
    read = normalize(raw)
    d = Dataset(read.variants, cut(read.lines), read.notes, read.issues)
    groups = cut(resolve.groups(d.lines))
    canonical = cut(resolve.canonical_lines(d.lines.drop("raw"), groups))
    told = notes_op.extract(d.notes, reader or KeywordReader())
    items = cut(sig.signature_items(canonical))
    placed = sig.signatures(items)
    # a sub-assembly none of whose lines names a component has an empty signature
    empty = d.lines.where(F.col("parent_id") != "").select(F.col("parent_id").alias("sub_assembly_id"), "variant_id").distinct()
    all_ = empty.join(placed.drop("variant_id"), "sub_assembly_id", "left").withColumn("items", F.coalesce("items", F.array().cast(placed.schema["items"].dataType)))
    linked = cut(notes_op.link(told.facts, canonical))
    return Result(
        raw, d, groups, canonical, told.facts, linked, items, all_, cut(sig.backtest(all_, d.variants, thresholds)),
        cut(findings_op.findings(canonical, linked)), told.reader, told.notes_read, told.invalid_outputs,
    )


def run(spark: SparkSession, raw_dir: str | Path, thresholds: sig.Thresholds, reader: NoteReader | None = None) -> Result:
    return analyse(read_raw(tuned(spark), raw_dir), thresholds, reader)


def write_tables(result: Result, folder: str) -> None:
    """The product at any size: each table as Parquet, written where its rows are."""
    tables = {
        "lines": result.dataset.lines, "issues": result.dataset.issues, "groups": result.groups, "canonical": result.canonical, "facts": result.linked,
        "items": result.items, "predictions": result.predictions, "findings": result.findings,
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def _rows(df: DataFrame, *order: str) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


def _text(raw: dict[str, Any], field: str, normalized: Any) -> dict[str, Any]:
    return {"raw": raw[field], "normalized": normalized}


def normalized(d: Dataset) -> dict[str, Any]:
    lines = []
    for r in _rows(d.lines, "row_number"):
        raw = r["raw"]
        lines.append(
            {
                **{k: r[k] for k in ("line_id", "row_number", "variant_id", "parent_id", "child_id")},
                "quantity": {"raw_value": raw["quantity"], "raw_unit": raw["unit"], "value": r["quantity"], "unit": r["unit"]},
                "sub_assembly_ref": _text(raw, "sub_assembly_ref", r["sub_assembly_key"]),
                "sub_assembly_designation": _text(raw, "sub_assembly_designation", r["sub_assembly_designation"]),
                "component_ref": _text(raw, "component_ref", r["child_id"]),
                "designation": _text(raw, "designation", r["designation"]),
                "supplier": _text(raw, "supplier", r["supplier"]),
                "unit_cost": _text(raw, "unit_cost_eur", r["cost"]),
            }
        )
    dated = d.variants.withColumn("__d", F.coalesce("design_date", F.lit("9999-12-31").cast("date")))
    fields = ("name", "design_date", "region", "seats", "bike_spaces", "traction")
    return {
        "variants": [{"id": r["id"], "raw_id": r["raw_id"], **{f: _text(r["raw"], f, r[f]) for f in fields}} for r in _rows(dated, "__d", "id")],
        "suppliers": _rows(suppliers(d.lines), "id"),
        "components": _rows(components(d.lines), "id"),
        "sub_assemblies": _rows(sub_assemblies(d.lines), "id"),
        "lines": lines,
        "notes": [{"note_id": r["note_id"], "row_number": r["row_number"], "variant_id": r["variant_id"], "date": _text(r["raw"], "date", r["date"]), "text": r["text"]} for r in _rows(d.notes, "row_number")],
        "issues": _rows(d.issues, "source_file", "row_number", "field"),
    }


def resolution(r: Result) -> dict[str, Any]:
    parts: dict[str, list[dict[str, Any]]] = {}
    for c in _rows(resolve.canonical_components(r.canonical)):
        parts.setdefault(c["reference_key"], []).append({"id": c.pop("component_id"), **c})
    ordered = lambda p: (p["id"].partition("#")[0], int(p["id"].partition("#")[2] or 0))
    return {
        "groups": [
            {"reference_key": g["reference_key"], "verdict": g["verdict"], "diverging": g["diverging"], "components": sorted(parts[g["reference_key"]], key=ordered)}
            for g in _rows(r.groups, "reference_key")
        ]
    }


def facts(r: Result) -> dict[str, Any]:
    found: dict[tuple, dict[str, Any]] = {}
    rows = sorted(_rows(r.linked), key=lambda f: (f["row_number"], KINDS.index(f["kind"]), f["component_ref"], f["component_id"] or ""))
    for f in rows:
        part = f.pop("component_id")
        entry = found.setdefault(tuple(sorted(f.items())), {"fact": f, "components": []})
        entry["components"] += [part] if part else []
    return {"note_facts": {"reader": r.reader, "notes_read": r.notes_read, "invalid_outputs": r.invalid, "facts": list(found.values())}}


def _grouped(rows: list[dict[str, Any]], key: str) -> dict[Any, list[dict[str, Any]]]:
    out: dict[Any, list[dict[str, Any]]] = {}
    for row in rows:
        out.setdefault(row[key], []).append(row)
    return out


def _quoted(values: list[Any]) -> str:
    return ", ".join(repr(v) for v in values)


#: What a finding says, by its rule; the words in braces are filled in from its row.
SENTENCES = {
    DUPLICATE_REFERENCE.id: "component {subject} is written in {n} ways: {quoted}",
    GROUP_CONFLICT.id: "the rows under {spellings} differ in {listed}, yet are taken for one component",
    GROUP_SPLIT.id: "{spellings} read as one reference but name {n} things ({quoted}), so the rows stay separate",
    **{rule.id: f"{{spelling!r}}, component {{subject}}, shows {{n}} values of {name}: {{shown}}" for name, rule in CONFLICT_RULES.items()},
    NOTE_RULES["replacement"].id: "note {note} has {ref!r} replaced{by}; component {subject} is still on {listed} (reader: {reader})",
    NOTE_RULES["obsolescence"].id: "note {note} calls {ref!r} obsolete; component {subject} is still on {listed} (reader: {reader})",
    NOTE_RULES["restriction"].id: "note {note} limits where {ref!r} may go{scope}; component {subject} is on {listed} (reader: {reader})",
}


def findings(r: Result, resolved: dict[str, Any]) -> list[dict[str, Any]]:
    """The findings in their order, each with its sentence."""
    parts = {p["id"]: p for g in resolved["groups"] for p in g["components"]}
    spelled = {x["component_id"]: x["spelling"] for x in _rows(checks.usual_spelling(r.canonical))}
    keys: dict[str, list[str]] = {g["reference_key"]: sorted({v for p in g["components"] for v in p["raw_references"]}) for g in resolved["groups"]}
    said = {(f["row_number"], f["kind"], f["component_ref"]): f for f in _rows(r.facts)}
    out = []
    for f in _rows(r.findings, *findings_op.ORDER):
        subject, values = f["subject"], f["values"]
        words = {"subject": subject, "n": len(values), "quoted": _quoted(values), "listed": ", ".join(values), "reader": r.reader}
        if f["stage"] == 0:
            words["spellings"] = _quoted(keys.get(subject) or parts[subject]["raw_references"])
        elif f["stage"] == 1:
            split = [v[1:].partition("] ") for v in values]
            cost = f["rule_id"] == CONFLICT_RULES["cost"].id
            words |= {"spelling": spelled[subject], "shown": "; ".join(f"{f'{float(v):.2f} EUR' if cost else repr(v)} on {at}" for at, _, v in split)}
        else:
            fact = said[(f["row"], KINDS[f["kind"] - 1], f["ref"])]
            words |= {
                "note": fact["note_id"], "ref": fact["component_ref"], "by": f" by {fact['replacement_ref']!r}" if fact["replacement_ref"] else "",
                "scope": f" ({fact['scope']!r})" if fact["scope"] else "",
            }
        out.append({"rule_id": f["rule_id"], "confidence": f["confidence"], "subject": subject, "message": SENTENCES[f["rule_id"]].format(**words), "source_rows": f["source_rows"]})
    return out


def _item(x: dict[str, Any]) -> dict[str, Any]:
    return {"component": x["c"], "quantity": x["q"], "unit": x["u"]}


def signature_table(r: Result) -> list[dict[str, Any]]:
    left = {x["sub_assembly_id"]: x["lines_left_out"] for x in _rows(sig.lines_left_out(r.dataset.lines, r.items))}
    about = {x["id"]: x for x in _rows(sub_assemblies(r.dataset.lines))}
    return [
        {
            "sub_assembly_id": x["sub_assembly_id"], "variant_id": x["variant_id"], "reference_key": about[x["sub_assembly_id"]]["reference_key"],
            "designations": about[x["sub_assembly_id"]]["designations"], "signature": {"items": [_item(i) for i in x["items"]]}, "lines_left_out": left.get(x["sub_assembly_id"], 0),
        }
        for x in _rows(r.signatures, "sub_assembly_id")
    ]


def backtest_table(r: Result) -> dict[str, Any]:
    roles = _rows(sig.chronology(r.dataset.variants), "variant_id")
    diffs = _grouped(_rows(sig.backtest_diff(r.predictions, r.items), "sub_assembly_id", "component_id"), "sub_assembly_id")
    predictions = []
    for p in _rows(r.predictions, "sub_assembly_id"):
        diff = None
        if p["reuse_class"] == "reusable":
            diff = {"added": [], "removed": [], "quantity_changed": []}
            for x in diffs.get(p["sub_assembly_id"], ()):
                left, right = ({"component": x["component_id"], "quantity": x[f"{s}_quantity"], "unit": x[f"{s}_unit"]} for s in ("left", "right"))
                entry = {"added": right, "removed": left, "quantity_changed": {"component": x["component_id"], "left": left, "right": right}}
                diff[x["change"]].append(entry[x["change"]])
        predictions.append({**{k: p[k] for k in ("sub_assembly_id", "variant_id", "reuse_class", "ancestor_id")}, "diff": diff})
    dates = {x["id"]: x["design_date"] for x in _rows(r.dataset.variants)}
    return {
        "target_variant_id": next((x["variant_id"] for x in roles if x["role"] == "target"), ""),
        "ancestor_variant_ids": sorted((x["variant_id"] for x in roles if x["role"] == "ancestor"), key=lambda v: (dates[v], v)),
        "predictions": predictions,
    }


def searches(r: Result) -> dict[str, dict[str, bool]]:
    """Which sub-assemblies of the newest variant the two naive searches call reused, under the tool's ids.

    A search knows a sub-assembly by each of its spellings; it is found if one of them is.
    """
    roles = sig.chronology(r.dataset.variants)
    out = {}
    for by in ("exact_reference", "same_name"):
        found = baselines.under_tool_ids(baselines.search(r.raw.bom, roles, by))
        out[by] = {x["sub_assembly_id"]: x["found"] for x in _rows(found)}
    return out


def tables(r: Result) -> dict[str, dict[str, Any]]:
    """The content of each JSON artifact."""
    resolved, told = resolution(r), facts(r)
    return {
        A.NORMALIZED: normalized(r.dataset),
        A.RESOLUTION: resolved,
        A.NOTE_FACTS: told,
        A.FINDINGS: {"findings": findings(r, resolved)},
        A.SIGNATURES: {"signatures": signature_table(r)},
        A.PREDICTIONS: {"backtest": backtest_table(r)},
    }

"""Queries for what the bills of materials don't reach: files, odd cells, wordings, budgets, and a generated data set."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, findings as findings_op, normalize as N, notes as O, resolve as R, signatures as S
from ..operators.model_reader import ModelReader
from ..runtime import cut, shared_folder, ship
from ..sources import generate as G, raw as W
from ..sources.spec import load_spec
from ..sources.story import NEWEST, VARIANTS
from . import report, run as plan
from .driver_queries import NOTES_VIEW, VARIANTS_VIEW, _view

# Both dialects read these views alike. Declared variants, half of them a second time in another spelling.
DECLARED_VIEW = f"""
SELECT * FROM ({VARIANTS_VIEW}) v
UNION ALL SELECT concat('  ', variant_id, ' '), name, design_date, region, seats, bike_spaces, traction, row_number + 10000 FROM ({VARIANTS_VIEW}) w WHERE row_number % 2 = 0
"""
# Every phrase of the catalogue, in small letters and in capitals, wrapped over lines, in short and long sentences.
CUED_VIEW = """
SELECT concat('Q', cast(p_partkey AS string)) AS note_id, '1998' AS variant_id, '1998-02-28' AS date,
       concat('Vu à l''atelier. ', CASE WHEN p_partkey % 4 = 0 THEN 'La pièce ' ELSE 'Part ' END, CASE WHEN p_partkey % 9 = 0 THEN lower(replace(p_name, ' ', '-')) ELSE upper(replace(p_name, ' ', '-')) END, ' ',
              CASE WHEN p_partkey % 3 = 0 THEN upper(cue) WHEN p_partkey % 3 = 1 THEN replace(cue, ' ', '  ') ELSE cue END,
              CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE concat(' AB ', cast(100 + p_partkey AS string), ' ') END,
              CASE WHEN p_partkey % 7 = 0 THEN repeat('à la prochaine visite de la rame ', 5) ELSE 'mars 2024' END, '; le reste plus tard') AS text,
       cast(p_partkey AS bigint) AS row_number
FROM (SELECT p.*, c.cue FROM part p JOIN (CUES) c ON p.p_partkey % 27 = c.k) cued
"""
_CUES = [cue for cues in O.CUES.values() for cue in cues]
_LISTED = " UNION ALL ".join(f"SELECT {k} AS k, '{cue}' AS cue" for k, cue in enumerate(_CUES))
CUED_VIEW = CUED_VIEW.replace("CUES", _LISTED)


def duplicate_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.variants(_view(spark, sf_dir, DECLARED_VIEW)).select("row_number", "raw_id", F.explode("issues").alias("i"))
    return found.where("i.reason = 'duplicate variant'").select("row_number", "raw_id", F.col("i.field").alias("field"))


def cue_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.note_facts(_view(spark, sf_dir, CUED_VIEW)).drop("row_number")


def amounts_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices against themselves, moved by nothing, by less than the tolerance, and by more."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("a", F.col("p_retailprice").cast("double"))
    moved = F.col("a") * F.when(F.col("p_partkey") % 3 == 0, 1.0).when(F.col("p_partkey") % 3 == 1, 1.0 + 1e-10).otherwise(1.0 + 1e-8)
    unit = F.when(F.col("p_partkey") % 5 == 0, F.lit("m")).otherwise(F.lit("pcs"))
    return part.select("p_partkey", T.same_amount(F.col("a"), F.lit("pcs"), moved, unit).alias("alike"))


def designation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.array_join(F.array_sort(T.words(F.concat_ws("+ ", "p_type", "p_name", "p_type"))), "|").alias("words"))


def composed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with combining accents, capitals with accents, sharp s and odd spaces, as keys."""
    name = F.concat(F.lit("Étoile  Straße É ÔI-l\t"), "p_name", F.lit(" İ œ"))
    read = T.composed(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", name.alias("name")), "name")
    return read.select("p_partkey", T.reference_key(F.replace("name", F.lit("\u0130"), F.lit(""))).alias("reference_key"), T.text_key(F.replace("name", F.lit("\u0130"), F.lit(""))).alias("text_key"))


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 31).cast("int").alias("a"), (F.col("p_partkey") % 17 + 1).cast("int").alias("b"))
    return part.select("p_partkey", S.budget(F.col("a"), F.col("b"), S.Thresholds()).alias("budget"), S.budget(F.col("a"), F.col("b"), S.Thresholds(2, 0.4)).alias("tight"))


def story_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each case of the default specification, compared."""
    spec = load_spec(Path(G.__file__).parent / "default_spec.toml")
    item = "array<struct<c:string,u:string,q:double>>"
    side = lambda case, name: [(p, case.get("units", {}).get(p, "pcs"), float(q)) for p, q in sorted(case[name].items())]
    cases = spark.createDataFrame([(c["id"], side(c, "left"), side(c, "right")) for c in spec.story_cases], f"id string, a {item}, b {item}")
    named = cases.withColumns({f"{x}_names": F.transform(x, lambda i: i["c"]) for x in "ab"})
    found = S.compared(named, spec.thresholds).select("id", "n_parts", "n_qty", "reuse_class")
    return cases.select("id").join(found, "id", "left").select("id", F.coalesce("reuse_class", F.lit("specific")).alias("reuse_class"))


def strict_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as a file a region, with quoted cells, and read again."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    odd = F.concat(F.lit('"'), "n_name", F.lit(';""'), "n_name", F.lit('""\n  x"'))
    rows = nation.select("n_regionkey", F.struct("n_nationkey", F.concat_ws(";", F.col("n_nationkey").cast("string"), odd, F.lit(" kept ")).alias("line")).alias("r"))
    whole = rows.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]).alias("lines"))
    content = F.concat(F.lit("key;name;rest\n"), F.array_join("lines", "\n"), F.lit("\n")).cast("binary")
    return W.records_of(whole.select(F.col("n_regionkey").cast("string").alias("path"), content.alias("content")), ("key", "name", "rest"))


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return W.repeated(orders.select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").cast("long").alias("row_number")), "id")


_known: dict[str, tuple[plan.Result, list[dict]]] = {}


def _generated(spark: SparkSession) -> tuple[plan.Result, list[dict]]:
    """The default generated data set, analysed once an application; and its declared answers."""
    app = spark.sparkContext.applicationId
    if app not in _known:
        s = G.Story(load_spec(Path(G.__file__).parent / "default_spec.toml"))
        rows, notes = G.bom_rows(s, G.SEED), G.note_rows(G.SEED)
        tables = ((W.VARIANTS, [tuple(map(str, v)) for v in VARIANTS]), (W.BOM, rows), (W.NOTES, [n for n, _ in notes]))
        raw = W.Raw(*[spark.createDataFrame([(*r, k) for k, r in enumerate(cells, 1)], W.schema_of(columns)) for columns, cells in tables])
        _known[app] = plan.analyse(raw, S.Thresholds()), G.answers(s, G.against(s, notes))
    return _known[app]


def generated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule and groups by verdict, of the generated data set."""
    r, _ = _generated(spark)
    rules = findings_op.rule_counts(r.findings).select(F.col("rule_id").alias("what"), "n")
    verdicts = r.groups.groupBy(F.col("verdict").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    parts = R.canonical_components(r.canonical).agg(F.lit("components").alias("what"), F.count(F.lit(1)).alias("n"))
    return rules.unionByName(verdicts).unionByName(parts)


def generated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, claims and what there is, by label, of the backtest against the declared answers."""
    r, declared = _generated(spark)
    named = [(f"{NEWEST}:{a['sub_assembly_ref']}", a["label"], [f"{x['variant_id']}:{x['sub_assembly_ref']}" for x in a["ancestors"]]) for a in declared]
    truth = spark.createDataFrame(named, "raw string, label string, raws array<string>")
    keyed = lambda c: F.concat(F.split(c, ":")[0], F.lit(":"), T.reference_key(F.split(c, ":")[1]))
    truth = truth.select(keyed(F.col("raw")).alias("sub_assembly_id"), "label", F.transform("raws", keyed).alias("ancestors"))
    return evaluate.score(cut(truth), r.predictions)


def tables_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated data set's tables as Parquet in the shared folder, counted as they are read back."""
    folder = f"{shared_folder(spark.sparkContext)}/tables-{uuid.uuid4().hex}"
    plan.write_tables(_generated(spark)[0], folder)
    names = ("lines", "issues", "groups", "canonical", "facts", "items", "predictions", "findings")
    counts = [spark.read.parquet(f"{folder}/{name}.parquet").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in names]
    return reduce(DataFrame.unionByName, counts)


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each section of the generated data set's page, headings apart, and its script elements."""
    result = _generated(spark)[0]
    page = report.render(plan.tables(result), plan.searches(result))
    sections = re.findall(r'<section id="(\w+)">(.*?)</section>', page, re.S)
    rows = [(name, body.count("<tr>") - body.count("<tr><th>")) for name, body in sections if name in ("answer", "inconsistencies", "findings")]
    return spark.createDataFrame([*rows, ("scripts", page.count("<script"))], "section string, n long")


class FirstToken:
    """A model that calls the note's first word in capitals obsolete, and makes up a part."""

    model = "first token"

    def generate(self, prompt: str) -> str:
        found = re.search("[A-Z][A-Z0-9_-]{3,}", prompt.rpartition("Note:\n")[2])
        said = [{"kind": "obsolescence", "component_ref": found[0], "replacement_ref": "ZZ-99"}] if found else []
        return json.dumps({"facts": [*said, {"kind": "restriction", "component_ref": "ZZ-98"}]})


def model_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a model that are in their notes, and how much of what it said was not."""
    reading = ModelReader(FirstToken()).read(_view(spark, sf_dir, NOTES_VIEW))
    facts = reading.facts.select("note_id", "kind", "component_ref", "replacement_ref")
    return reading.invalid.join(facts, "note_id", "left")


def written_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts spelled as the generator spells them, and read again."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, units = (batch.column(c).to_pylist() for c in ("p_partkey", "value", "base"))
            told = [G.written_amount(v, u, G.rng(7, k)) for k, v, u in zip(keys, values, units, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("p_partkey"), *[pa.array([t[x] for t in told], pa.string()) for x in (0, 1)]], ["p_partkey", "quantity", "unit"])

    unit = F.when(F.col("p_partkey") % 3 == 0, F.lit("m")).when(F.col("p_partkey") % 3 == 1, F.lit("kg")).otherwise(F.lit("pcs"))
    value = F.when(F.col("p_partkey") % 3 == 2, (F.col("p_partkey") % 50 + 1).cast("double")).otherwise((F.col("p_partkey") % 400 + 1).cast("double") / 8)
    part = ship(spark).read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("p_partkey"), value.alias("value"), unit.alias("base"))
    read = T.with_amounts(part.mapInArrow(spelled, "p_partkey long, quantity string, unit string"))
    return read.select("p_partkey", "amount", F.col("amount_unit").alias("base"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (duplicate_variants, cue_facts, amounts_alike, designation_words, composed_keys, budgets, story_cases, strict_csv, repeated_ids, generated_counts, generated_scores, tables_written, model_facts, written_amounts, report_rows)
}

_SHAPED = "lambda x: regexp_matches(x, '[0-9]') OR x = upper(x)"
_REFERENCE = r"\b[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)+\b|\b[A-Z]{2,}[ ]?[0-9]{2,}\b"
_CUED = ", ".join(f"regexp_extract(text, '(?i){'|'.join(c.replace(' ', '[[:space:]]+') for c in cues)}') AS {kind[:3]}" for kind, cues in O.CUES.items())
_SAID = "trim(regexp_replace(regexp_extract(substr(text, 1, instr(text, res) - 1), '[^.;!?\\n]*$') || regexp_extract(substr(text, instr(text, res)), '^[^.;!?\\n]*'), '\\s+', ' ', 'g'))"
_COMPOSED = "replace(nfc_normalize('E' || chr(769) || 'toile  Stra' || chr(223) || 'e' || chr(160) || chr(201) || ' O' || chr(770) || 'I-l' || chr(9) || p_name || chr(8195) || chr(304) || ' ' || chr(339)), chr(304), '')"
ORACLE_SQL: dict[str, str] = {
    "duplicate_variants": f"SELECT row_number, variant_id AS raw_id, 'variant_id' AS field FROM (SELECT *, row_number() OVER (PARTITION BY upper(trim(variant_id)) ORDER BY row_number) AS nth FROM ({DECLARED_VIEW})) WHERE nth > 1",
    "cue_facts": f"""WITH notes AS ({CUED_VIEW}), cued AS (SELECT *, {_CUED} FROM notes),
refs AS (SELECT *, list_filter(regexp_extract_all(text, '{_REFERENCE}'), {_SHAPED}) AS found,
         list_filter(regexp_extract_all(substr(text, 1, instr(text, rep) - 1), '{_REFERENCE}'), {_SHAPED}) AS earlier,
         list_filter(regexp_extract_all(substr(text, instr(text, rep) + length(rep)), '{_REFERENCE}'), {_SHAPED}) AS later FROM cued),
said AS (SELECT *, {_SAID} AS whole FROM refs)
SELECT note_id, 'replacement' AS kind, earlier[-1] AS component_ref, coalesce(later[1], '') AS replacement_ref, '' AS scope FROM said WHERE rep <> '' AND len(earlier) > 0
UNION ALL SELECT note_id, 'obsolescence', found[1], '', '' FROM said WHERE obs <> '' AND len(found) > 0
UNION ALL SELECT note_id, 'restriction', found[1], '', CASE WHEN length(whole) > 120 THEN rtrim(substr(whole, 1, 119)) || chr(8230) ELSE whole END FROM said WHERE res <> '' AND len(found) > 0""",
    "amounts_alike": """SELECT p_partkey, (p_partkey % 5 <> 0) AND abs(a - b) <= 1e-9 * greatest(abs(a), abs(b)) AS alike FROM (
  SELECT p_partkey, p_retailprice::double AS a, p_retailprice::double * CASE p_partkey % 3 WHEN 0 THEN 1::double WHEN 1 THEN 1::double + 1e-10::double ELSE 1::double + 1e-8::double END AS b FROM part)""",
    "designation_words": r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(p_type || '+ ' || p_name || '+ ' || p_type, '[^\p{L}\p{N}]+'), lambda x: x <> ''))), '|') AS words FROM part",
    "composed_keys": f"""SELECT p_partkey, regexp_replace(translate(replace(upper(c), chr(7838), 'SS'), 'OIL', '011'), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS reference_key,
  lower(replace(trim(regexp_replace(replace(replace(c, chr(160), ' '), chr(8195), ' '), '\\s+', ' ', 'g')), chr(223), 'ss')) AS text_key FROM (SELECT p_partkey, {_COMPOSED} AS c FROM part)""",
    "budgets": "SELECT p_partkey, least(3, ceil(0.25::double * least(p_partkey % 31, p_partkey % 17 + 1)))::int AS budget, least(2, ceil(0.4::double * least(p_partkey % 31, p_partkey % 17 + 1)))::int AS tight FROM part",
    "story_cases": "SELECT * FROM (VALUES ('body_same', 'reused'), ('gear_same', 'reused'), ('seat_folding', 'reusable'), ('cycle_fewer_hooks', 'reusable'), ('anchorage_other', 'specific'), ('display_signs', 'reusable'), ('door_button', 'reusable'), ('drive_hybrid', 'specific')) t(id, reuse_class)",
    "strict_csv": "SELECT n_nationkey::string AS key, n_name || ';\"' || n_name || '\"' || chr(10) || '  x' AS name, ' kept ' AS rest, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_number FROM nation",
    "repeated_ids": "SELECT o_custkey::string AS value, count(*) AS n, min(o_orderkey)::bigint AS first, max(o_orderkey)::bigint AS last FROM orders GROUP BY 1 HAVING count(*) > 1",
    "generated_counts": """SELECT * FROM (VALUES ('resolution.duplicate_reference', 15::bigint), ('resolution.group_conflict', 13), ('resolution.group_split', 3), ('checks.unit_conflict', 3), ('checks.supplier_conflict', 5),
  ('checks.cost_conflict', 5), ('checks.note_replacement', 9), ('checks.note_obsolescence', 7), ('checks.note_restriction', 6), ('auto', 144), ('review', 13), ('reject', 3), ('components', 163)) t(what, n)""",
    "generated_scores": "SELECT * FROM (VALUES ('reused', 8::bigint, 8::bigint, 9::bigint), ('reusable', 4, 5, 4), ('new', 2, 2, 2)) t(label, hits, claimed, there)",
    "report_rows": "SELECT * FROM (VALUES ('answer', 15::bigint), ('inconsistencies', 13), ('findings', 66), ('scripts', 0)) t(section, n)",
    "tables_written": "SELECT * FROM (VALUES ('lines', 696::bigint), ('issues', 0), ('groups', 160), ('canonical', 696), ('facts', 22), ('items', 696), ('predictions', 15), ('findings', 66)) t(name, n)",
    "model_facts": f"""SELECT note_id, CASE WHEN found <> '' THEN 2 ELSE 1 END::bigint AS invalid, CASE WHEN found <> '' THEN 'obsolescence' END AS kind, nullif(found, '') AS component_ref, CASE WHEN found <> '' THEN '' END AS replacement_ref
FROM (SELECT note_id, regexp_extract(text, '[A-Z][A-Z0-9_-]{{3,}}') AS found FROM ({NOTES_VIEW}))""",
    "written_amounts": "SELECT p_partkey::bigint AS p_partkey, CASE WHEN p_partkey % 3 = 2 THEN (p_partkey % 50 + 1)::double ELSE (p_partkey % 400 + 1)::double / 8 END AS amount, CASE p_partkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'kg' ELSE 'pcs' END AS base FROM part",
}

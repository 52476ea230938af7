from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest

from partkin.operators import baselines, checks, findings, normalize as N, notes as O, resolve as R, signatures as S
from partkin.operators.model_reader import BackendError, HttpBackend, ModelReader, facts_of, read_notes
from partkin.plans import cli, report
from partkin.plans import run as plan
from partkin.runtime import cut
from partkin.sources import artifacts as A, generate as G, raw as W
from partkin.sources.guard import trespass
from partkin.sources.spec import SpecError, load_spec
from partkin.sources.truth import EvaluationError, load_truth

ROOT = Path(__file__).parent.parent
VARIANTS = [("A", "Standard car", "2019-03-14", "North", "48", "0", "electric"), ("B", "Bike car", "2021-06-02", "North", "36", "8", "electric"), ("C", "New car", "2025-02-17", "West", "44", "2", "electric")]


def line(n, variant="A", sub="SA-0101", name="Carbody shell", ref="BGI-2031", des="Bolt set M8", q="4", unit="pcs", sup="Artois Polymères", cost="12,50"):
    return (f"L{n}", variant, sub, name, ref, des, q, unit, sup, cost)


def raw(spark, bom, variants=VARIANTS, notes=()):
    table = lambda columns, rows: spark.createDataFrame([(*r, k) for k, r in enumerate(rows, 1)], W.schema_of(columns))
    return W.Raw(table(W.VARIANTS, variants), table(W.BOM, bom), table(W.NOTES, notes))


def resolved(spark, bom, **more):
    """The tables of a bill in composed characters, each computed once."""
    d = N.normalize(raw(spark, bom, **more), compose=False)
    d = N.Dataset(d.variants, cut(d.lines.coalesce(1)), d.notes, d.issues)
    g = cut(R.groups(d.lines))
    return d, g, cut(R.canonical_lines(d.lines, g))


def verdicts(g):
    return {r["reference_key"]: (r["verdict"], r["diverging"]) for r in g.collect()}


def test_spellings_merge(spark):
    _, g, c = resolved(spark, [line(1), line(2, ref="BG1-2031"), line(3, ref="bgi 2031 ")])
    assert verdicts(g) == {"BG12031": ("auto", [])}
    assert sorted(r["component_ref_raw"] for r in R.duplicate_references(c).collect()) == ["BG1-2031", "BGI-2031", "bgi 2031 "]


def test_transposition_stays_apart(spark):
    assert len(verdicts(resolved(spark, [line(1), line(2, ref="BGI-2013")])[1])) == 2


@pytest.mark.parametrize("change,attribute", [({"unit": "m"}, "unit"), ({"sup": "Other"}, "supplier"), ({"cost": "12,51"}, "cost"), ({"des": "Bolt set M8, zinc"}, "designation")])
def test_review(spark, change, attribute):
    _, g, c = resolved(spark, [line(1), line(2, **change)])
    assert verdicts(g) == {"BG12031": ("review", [attribute])}
    assert [r["row_number"] for r in R.group_conflicts(c).orderBy("row_number").collect()] == [1, 2]


def test_agreement_after_normalization(spark):
    _, g, c = resolved(spark, [line(1, q="1000", unit="mm"), line(2, q="1", unit="m", cost="12.50", sup=" ARTOIS  polymères")])
    assert verdicts(g) == {"BG12031": ("auto", [])} and checks.conflict_values(c).count() == 0


def test_split_numbers_unreadable_rows_first(spark):
    rows = [line(1, ref="SEAT-RAIL-I", des="Floor rail, stainless steel"), line(2, ref="SEAT-RAIL-1", des="Mounting rail, aluminium, mark 1"), line(3, ref="SEAT-RAIL-1", des=""), line(4, ref="SEAT-RAIL-1", des=" ")]
    _, g, c = resolved(spark, rows)
    assert verdicts(g)["SEATRA111"][0] == "reject"
    assert {r["row_number"]: r["component_id"] for r in c.collect()} == {3: "SEATRA111#1", 4: "SEATRA111#2", 1: "SEATRA111#3", 2: "SEATRA111#4"}
    assert R.group_splits(c).count() == 4


def test_signature_sums_and_units(spark):
    rows = [line(1), line(2, q="6"), line(3, ref="CABLE-9", q="2", unit="kg"), line(4, ref="CABLE-9", q="3", unit="m"), line(5, ref="CABLE-9", q="500", unit="g"), line(6, ref="X-1", q="abc"), line(7, ref="--")]
    d, _, c = resolved(spark, rows)
    items = S.signature_items(c)
    assert {r["component_id"]: (r["quantity"], r["unit"]) for r in items.collect()} == {"BG12031": (10.0, "pcs"), "CAB1E9": (2.5, "kg"), "X1": (None, None)}
    assert S.lines_left_out(d.lines, items).first()["lines_left_out"] == 2
    assert [i["c"] for i in S.signatures(items).first()["items"]] == ["BG12031", "CAB1E9"]


def test_issues(spark):
    rows = [line(1, variant="Q"), line(2, q="1.2,3", unit="cm"), line(3, sub="--", cost="-1", sup="")]
    found = {(r["row_id"], r["field"], r["reason"]) for r in N.normalize(raw(spark, rows, variants=[*VARIANTS, ("a ", "", "x", "r", "n", "1", "t")])).issues.collect()}
    assert found == {
        ("L1", "variant_id", "unknown variant"), ("L2", "quantity", "ambiguous separators"), ("L2", "unit", "unknown unit"), ("L3", "sub_assembly_ref", "empty reference"),
        ("L3", "unit_cost_eur", "not a number"), ("L3", "supplier", "empty"), ("a ", "name", "empty"), ("a ", "design_date", "not an ISO date"), ("a ", "seats", "not an integer"),
        ("a ", "variant_id", "duplicate variant"),
    }


def parts(variant, sub, counts, n0):
    return [line(n0 + k, variant, sub, ref=ref, q=str(q)) for k, (ref, q) in enumerate(counts.items())]


FOUR = {"SHELL-A": 1, "SHELL-B": 2, "ROOF-C": 1, "SEAM-D": 24}


def predicted(spark, *subs, variants=VARIANTS):
    bom, n = [], 1
    for variant, sub, counts in subs:
        bom += parts(variant, sub, counts, n)
        n += len(counts)
    d, _, c = resolved(spark, bom, variants=variants)
    items = cut(S.signature_items(c))
    p = cut(S.backtest(S.signatures(items), d.variants))
    return {r["sub_assembly_id"]: r for r in p.collect()}, S.backtest_diff(p, items).collect()


def test_backtest_reused_reusable_specific(spark):
    got, diff = predicted(
        spark, ("A", "SA-1", FOUR), ("B", "SA-2", FOUR | {"HOOK-E": 1, "SEAM-D": 24}), ("C", "SA-9", FOUR), ("C", "SA-8", FOUR | {"HOOK-E": 2}), ("C", "SA-7", {"QQ-1": 1, "QQ-2": 1, "QQ-3": 1, "QQ-4": 9})
    )
    assert (got["C:SA9"]["reuse_class"], got["C:SA9"]["ancestor_id"]) == ("reused", "A:SA1")
    assert (got["C:SA8"]["reuse_class"], got["C:SA8"]["ancestor_id"]) == ("reusable", "A:SA1")  # one difference either way: the smaller id
    assert (got["C:SA7"]["reuse_class"], got["C:SA7"]["ancestor_id"]) == ("specific", "")
    assert [(r["component_id"], r["change"], r["right_quantity"]) for r in diff] == [("H00KE", "added", 2.0)]


@pytest.mark.parametrize("size,allowed", [(4, 1), (7, 2), (8, 2), (9, 3), (12, 3), (40, 3)])
def test_budget_and_blocking_at_every_size(spark, size, allowed):
    base = {f"P-{k}": 1 for k in range(size)}
    near = dict(base)
    for k in range(allowed):
        del near[f"P-{k}"]
    far = dict(near)
    del far[f"P-{allowed}"]
    # leaving out parts also lessens the smaller size, from which the budget is read
    got, _ = predicted(spark, ("A", "SA-1", base), ("C", "SA-2", base | {f"Q-{k}": 1 for k in range(allowed)}), ("C", "SA-3", base | {f"Q-{k}": 1 for k in range(allowed + 1)}))
    assert got["C:SA2"]["reuse_class"] == "reusable" and got["C:SA2"]["n_parts"] == allowed
    assert got["C:SA3"]["reuse_class"] == "specific"


def test_unreadable_is_never_reused_and_undated_is_no_ancestor(spark):
    got, _ = predicted(spark, ("A", "SA-1", {"X-1": "?", "X-2": "?"}), ("B", "SA-1", FOUR), ("C", "SA-2", {"X-1": "?", "X-2": "?"}), ("C", "SA-3", FOUR), variants=[VARIANTS[0], ("B", "b", "soon", "r", "1", "1", "t"), VARIANTS[2]])
    assert got["C:SA3"]["reuse_class"] == "specific"
    assert "C:SA2" not in got or got["C:SA2"]["reuse_class"] == "specific"


def test_baselines(spark):
    r = raw(spark, [line(1, "A", "SA-0101"), line(2, " c", "SA-O101"), line(3, "C", "SA-0101", name=" carbody   SHELL ")])
    roles = S.chronology(N.variants(r.variants))
    exact = {x["sub_assembly_id"]: (x["reuse_class"], x["ancestor_id"]) for x in baselines.search(r.bom, roles, "exact_reference").collect()}
    name = {x["sub_assembly_id"]: (x["reuse_class"], x["ancestor_id"]) for x in baselines.search(r.bom, roles, "same_name").collect()}
    assert exact == {"C:SA-O101": ("specific", ""), "C:SA-0101": ("reused", "A:SA-0101")}
    assert name == {"C:SA-O101": ("reused", "A:SA-0101"), "C:SA-0101": ("reused", "A:SA-0101")}


NOTES = [
    ("N1", "A", "2019-05-06", "La BRK-CTRL-VALVE est remplacée\n par BRK-NEW-12."), ("N2", "A", "x", "HVAC-GRILLE-12 : fin de vie."), ("N3", "Q", "2019-05-06", "Fine. Ne pas monter TRAC-TRANSFORMER sur rames bi-mode; merci"),
    ("N4", "A", "2019-05-06", "aux-cap-bank is obsolete"), ("N5", "A", "2019-05-06", "replaced by BRK-NEW-12"), ("N6", "A", "2019-05-06", "mars 2024, RAS"), ("N7", "A", "2019-05-06", ""),
]


def test_notes(spark):
    d = N.normalize(raw(spark, [line(1, ref="TRAC-TRANSFORMER")], notes=NOTES))
    facts = O.note_facts(d.notes)
    assert {(r["note_id"], r["kind"], r["component_ref"], r["replacement_ref"], r["scope"]) for r in facts.collect()} == {
        ("N1", "replacement", "BRK-CTRL-VALVE", "BRK-NEW-12", ""), ("N2", "obsolescence", "HVAC-GRILLE-12", "", ""),
        ("N3", "restriction", "TRAC-TRANSFORMER", "", "Ne pas monter TRAC-TRANSFORMER sur rames bi-mode"),
    }
    c = R.canonical_lines(d.lines, R.groups(d.lines))
    linked = O.link(facts, c)
    assert {r["note_id"]: r["component_id"] for r in linked.collect()} == {"N1": None, "N2": None, "N3": "TRACTRANSF0RMER"}
    assert [(r["note_id"], r["carrier"], r["bom_row"]) for r in checks.note_contradictions(linked, c).collect()] == [("N3", "A", 1)]


def test_model_answers_are_checked():
    text = "AB-1 replaced by CD-2"
    good = {"kind": "replacement", "component_ref": "AB-1", "replacement_ref": "CD-2", "more": 1}
    assert facts_of(text, "no json") == ([], 1) and facts_of(text, '{"facts": 3}') == ([], 1)
    found, bad = facts_of(text, json.dumps({"facts": [good, {**good, "component_ref": "ZZ-9"}, {**good, "replacement_ref": "none"}, {**good, "kind": "x"}, {**good, "component_ref": 3}, 7]}))
    assert [f["replacement_ref"] for f in found] == ["CD-2", ""] and bad == 5


def test_model_reader(spark):
    class Fake:
        model = "fake"

        def generate(self, prompt):
            import json

            return json.dumps({"facts": [{"kind": "obsolescence", "component_ref": "HVAC-GRILLE-12"}, {"kind": "obsolescence", "component_ref": "GONE-1"}]})

    facts, bad = read_notes(N.normalize(raw(spark, [line(1)], notes=NOTES)).notes, Fake())
    assert [r["note_id"] for r in facts.collect()] == ["N2"] and bad.agg({"invalid": "sum"}).first()[0] == 13


def write(folder, bom, notes=NOTES):
    folder.mkdir()
    for name, columns, rows in (("variants.csv", W.VARIANTS, VARIANTS), ("bom.csv", W.BOM, bom), ("notes.csv", W.NOTES, notes)):
        W.write_csv(folder / name, columns, rows)
    return folder


def small_bom():
    bom = parts("A", "SA-1", FOUR, 1) + parts("C", "SA-9", FOUR | {"TRAC-TRANSFORMER": 1}, 10) + parts("C", "SA-5", FOUR, 20)
    return [*bom, line(30, "A", "SA-2", ref="SHELL-A", sup="Other <b>", des="Bolt\nset; M8")]


def test_run_artifacts_and_command_line(spark, tmp_path, capsys):
    folder, out = write(tmp_path / "raw", small_bom()), tmp_path / "out"
    before = {p.name: p.read_bytes() for p in folder.iterdir()}
    assert cli.main(["run", "--raw", str(folder), "--out", str(out)], spark) == 0
    assert {p.name for p in out.iterdir()} == set(A.RUN_ARTIFACTS) and before == {p.name: p.read_bytes() for p in folder.iterdir()}
    said = capsys.readouterr().out
    assert "reusable        1" in said and "reused          1" in said
    findings = A.load(out / A.FINDINGS)["findings"]
    assert {f["rule_id"] for f in findings} >= {"checks.supplier_conflict", "checks.note_restriction", "resolution.group_conflict"}
    assert any("shows 2 values of supplier: 'artois polymères' on A, C; 'other <b>' on A" in f["message"] for f in findings)
    page = (out / A.REPORT).read_text()
    assert "<b>" not in page and "other &lt;b&gt;" in page and "<script" not in page
    again = tmp_path / "again"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert cli.main(["run", "--raw", str(folder), "--out", str(again)], spark) == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all((out / n).read_bytes() == (again / n).read_bytes() for n in A.RUN_ARTIFACTS)
    assert cli.main(["run", "--raw", str(folder), "--out", str(folder / "x")], spark) == 2
    (tmp_path / "link").symlink_to(folder)
    assert cli.main(["normalize", "--raw", str(folder), "--out", str(tmp_path / "link" / "n.json")], spark) == 2


def test_strict_artifacts(tmp_path):
    path = tmp_path / A.FINDINGS
    good = {"findings": [{"rule_id": "r", "confidence": 0.5, "subject": "s", "message": "m", "source_rows": []}]}
    A.dump(good, path)
    assert A.load(path)["findings"] == good["findings"]
    for bad in ({"findings": [{**good["findings"][0], "confidence": True}]}, {"findings": [{**good["findings"][0], "more": 1}]}, {"findings": {}}, {"finding": []}):
        A.dump(bad, path)
        with pytest.raises(A.ModelError):
            A.load(path)
    path.write_text('{"findings": [], "schema_version": "2"}')
    with pytest.raises(A.ModelError):
        A.load(path)


@pytest.mark.parametrize("text,said", [("line_id;x\n", "header"), (";".join(W.BOM) + "\na;b\n", "2 cells in row 1"), (";".join(W.BOM) + "\n\n", "0 cells"), (";".join(W.BOM) + '\n"a;b', "read"), ("﻿" + ";".join(W.BOM) + "\n", "header")])
def test_malformed_files_are_refused(spark, tmp_path, text, said):
    folder = write(tmp_path / "raw", [])
    (folder / "bom.csv").write_text(text)
    with pytest.raises(W.IngestError, match=said):
        W.read_raw(spark, folder)


def test_lossless_reading_and_unique_ids(spark, tmp_path):
    odd = line(1, des='a;"b"\n c ', sup="")
    folder = write(tmp_path / "raw", [odd])
    assert tuple(W.read_raw(spark, folder).bom.first())[:-1] == odd
    spark.catalog.clearCache()
    write(tmp_path / "two", [line(1), line(1)])
    with pytest.raises(W.IngestError, match="L1.*rows 1 and 2"):
        W.read_raw(spark, tmp_path / "two")


SPEC = """version = "1"
[thresholds]
max_abs_diff = 3
diff_ratio = 0.25
[dataset]
min_subassembly_size = 1
default_unit = "pcs"
[[story_cases]]
id = "a"
sub_assembly = "s"
left_variant = "A"
right_variant = "B"
expected_verdict = "identical"
source = "x"
left = {X = 1}
right = {X = 1}
[[typo_families]]
id = "t"
kind = "k"
canonical = "c"
variants = ["v"]
within_rules_reach = false
note = "n"
""" + "".join(f'[[must_not_merge]]\nid = "{k}"\nleft_reference = "l"\nright_reference = "r"\nleft_true_component = "x"\nright_true_component = "y"\ncollapsing_rule = "c"\nreason = "r"\n' for k in "mn")


@pytest.mark.parametrize("old,new", [("", ""), ("max_abs_diff = 3", "max_abs_diff = 0"), ("0.25", "1.5"), ("0.25", '"x"'), ("within_rules_reach = false", "within_rules_reach = true"), ("left = {X = 1}", "left = {}"), ('version = "1"', 'version = "1"\nextra = 1'), ('id = "n"', 'id = "m"')])
def test_specification(tmp_path, old, new):
    path = tmp_path / "spec.toml"
    path.write_text(SPEC.replace(old, new, 1) if old else SPEC)
    if not old:
        assert load_spec(path).thresholds == S.Thresholds(3, 0.25)
    else:
        with pytest.raises(SpecError):
            load_spec(path)


def test_evaluate(spark, tmp_path, capsys):
    folder = write(tmp_path / "raw", small_bom())
    label = {"variant_id": "C", "sub_assembly_designation": "x", "planted_as": "new", "story_case_id": None, "unsafe": []}
    older = {"variant_id": "A", "sub_assembly_ref": "SA-1"}
    empty = {"added": [], "removed": [], "quantity_changed": []}
    truth = {
        "schema_version": "1", "spec_version": "1", "seed": 1, "newest_variant": "C", "components": [], "typo_families": [], "must_not_merge": [], "defects": [], "notes": [],
        "backtest": [
            {**label, "sub_assembly_ref": "SA-5", "label": "reused", "ancestors": [{**older, "diff": None}]}, {**label, "sub_assembly_ref": "SA-9", "label": "reusable", "ancestors": [{**older, "diff": empty}]},
            {**label, "sub_assembly_ref": "SA-77", "label": "new", "ancestors": []},
        ],
    }
    path = tmp_path / "truth.json"
    path.write_text(json.dumps(truth))
    assert cli.main(["evaluate", "--raw", str(folder), "--ground-truth", str(path)], spark) == 0
    said = capsys.readouterr().out
    assert "reused          precision 1/1" in said and "correct         2/3" in said and "same_name" in said
    truth["backtest"][0]["ancestors"] = []
    path.write_text(json.dumps(truth))
    assert cli.main(["evaluate", "--raw", str(folder), "--ground-truth", str(path)], spark) == 1


def test_report_flags_only_reuses():
    signature = {"s": {"signature": {"items": [{"component": "X"}, {"component": "Y"}]}}}
    p = {"sub_assembly_id": "s", "reuse_class": "reused"}
    assert report.flagged(p, signature, {"Y": ["cost"]}) == [("Y", ["cost"])]
    assert report.flagged({**p, "reuse_class": "specific"}, signature, {"Y": ["cost"]}) == []


def test_report_compares_the_searches_and_shows_what_a_merge_rests_on():
    predictions = [{"sub_assembly_id": k, "reuse_class": c} for k, c in (("C:1", "reused"), ("C:2", "reusable"), ("C:3", "specific"))]
    counts, said = report.compared(predictions, {"exact_reference": {"C:1": True, "C:2": False}, "same_name": {"C:2": True, "C:3": True}})
    assert [n for _, n in counts] == [2, 1, 2] and "1 that exist are not found by their reference: C:2" in said and said[1].startswith("1 have a namesake but nothing like it in content, 1")
    found = [{"rule_id": "checks.cost_conflict", "subject": "K#1"}, {"rule_id": "resolution.group_conflict", "subject": "K"}, {"rule_id": "checks.unit_conflict", "subject": "L"}]
    assert report.merged_evidence(found, [{"reference_key": "K", "components": [{"id": "K#1"}]}, {"reference_key": "L", "components": [{"id": "L"}]}]) == {"K#1": found[1]}


def test_entry_imports_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['partkin.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'backtest' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_plan_keeps_no_driver_table():
    assert plan.Result.__dataclass_fields__.keys() >= {"canonical", "items", "predictions"}


@pytest.fixture(scope="module")
def generated(tmp_path_factory):
    """The default data set, by the command line."""
    root = tmp_path_factory.mktemp("generated")
    assert cli.main(["generate", "--out", str(root / "raw"), "--ground-truth", str(root / "truth.json")]) == 0
    return root


@pytest.fixture(scope="module")
def result(spark, generated):
    return plan.run(spark, generated / "raw", S.Thresholds())


def test_generated_data_have_the_published_counts(spark, generated, result):
    data = plan.tables(result)
    normalized, groups, found = data[A.NORMALIZED], data[A.RESOLUTION]["groups"], data[A.FINDINGS]["findings"]
    assert [len(normalized[k]) for k in ("variants", "lines", "notes", "sub_assemblies", "issues")] == [5, 696, 40, 72, 0]
    assert (len(groups), sum(len(g["components"]) for g in groups)) == (160, 163)
    assert [sum(g["verdict"] == v for g in groups) for v in ("auto", "review", "reject")] == [144, 13, 3]
    rules = {r["rule_id"]: r["n"] for r in findings.rule_counts(result.findings).collect()}
    assert [sum(n for k, n in rules.items() if k.startswith(part)) for part in ("resolution", "checks.note", "checks")] == [31, 22, 35] and len(found) == 66
    assert [rules[f"checks.{k}"] for k in ("unit_conflict", "supplier_conflict", "cost_conflict", "note_replacement", "note_obsolescence", "note_restriction")] == [3, 5, 5, 9, 7, 6]
    assert [sum(p["reuse_class"] == c for p in data[A.PREDICTIONS]["backtest"]["predictions"]) for c in ("reused", "reusable", "specific")] == [8, 5, 2]
    assert all(f["source_rows"] for f in found) and findings.merged_evidence(result.findings, result.canonical).where("group_rows IS NULL").isEmpty()
    assert O.linked_count(result.linked).first().asDict() == {"facts": 22, "linked": 22}
    page = report.render(data, plan.searches(result))
    assert "resolution.group_split: 3" in page and "by reference, character by character" in page
    # three readers of the same part
    assert [r[0] for r in O.match_reference(result.canonical, "fix 2O31").collect()] == ["F1X2031"]
    assert O.match_reference(result.canonical, "TRIM-RAIL-1").count() == 2 and O.match_reference(result.canonical, "--").count() == 0


def test_generated_data_give_the_published_scores(spark, generated):
    scored = cli.scores(spark, generated / "raw", generated / "truth.json", S.Thresholds())
    rows = {name: {r["label"]: (r["hits"], r["claimed"], r["there"]) for r in df.collect()} for name, df in scored.items()}
    assert rows["tool"] == {"reused": (8, 8, 9), "reusable": (4, 5, 4), "new": (2, 2, 2)}
    assert rows["exact_reference"] == {"reused": (4, 5, 9), "reusable": (0, 0, 4), "new": (2, 10, 2)}
    assert rows["same_name"] == {"reused": (9, 15, 9), "reusable": (0, 0, 4), "new": (0, 0, 2)}


def test_keyword_reader_on_generated_notes(spark, generated, result):
    """19 of 28 true facts are told, 3 are invented, 9 missed."""
    truth = json.loads((generated / "truth.json").read_text())
    true = {(n["note_id"], f["fact_type"], f["cited_reference"]) for n in truth["notes"] for f in n["facts"]}
    said = {(r["note_id"], r["kind"], r["component_ref"]) for r in result.facts.collect()}
    assert (len(true), len(true & said), len(said - true), len(true - said)) == (28, 19, 3, 9)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_seed_moves_dirt_and_never_answers(tmp_path, generated, seed):
    spec = load_spec(Path(G.__file__).parent / "default_spec.toml")
    G.generate(spec, seed, tmp_path / "raw", tmp_path / "truth.json")
    G.generate(spec, seed, tmp_path / "again", tmp_path / "again.json")
    one, two, default = (json.loads(p.read_text()) for p in (tmp_path / "truth.json", tmp_path / "again.json", generated / "truth.json"))
    assert one == two and all((tmp_path / "raw" / n).read_bytes() == (tmp_path / "again" / n).read_bytes() for n in W.FILES)
    assert one["backtest"] == default["backtest"] and (tmp_path / "raw" / "bom.csv").read_bytes() != (generated / "raw" / "bom.csv").read_bytes()
    spelt = [r for c in one["components"] for r in c["raw_references"]]
    assert len(spelt) == len(set(spelt)) and {v for f in spec.typo_families for v in f["variants"]} <= set(spelt)
    with pytest.raises(G.GenerationError):
        G.generate(spec, seed, tmp_path / "raw", tmp_path / "raw" / "truth.json")


def test_dirt_changes_the_spelling_and_never_the_amount():
    for k in range(300):
        dice = G.rng(k, "x")
        for value, unit in ((18.5, "m"), (4.0, "pcs"), (0.75, "kg"), (36.0, "m")):
            text, shown = G.written_amount(value, unit, dice)
            assert float(text.replace(",", ".")) * {"mm": 1e-3, "g": 1e-3}.get(shown, 1) == pytest.approx(value, rel=1e-12)
        for kind in ("case_and_whitespace", "separator", "homoglyph"):
            assert G.misspelt("VENT-GRID-12", kind, dice) != "VENT-GRID-12"
    with pytest.raises(G.GenerationError):
        G.misspelt("WALNUT", "homoglyph", G.rng(1))


@pytest.mark.parametrize("change", [{"extra": 1}, {"seed": "x"}, {"newest_variant": "A"}, {"notes": [{"note_id": "N1", "language": "fr", "facts": []}] * 2}])
def test_a_truth_with_other_keys_or_no_sense_is_refused(spark, tmp_path, generated, change):
    path = tmp_path / "truth.json"
    path.write_text(json.dumps(json.loads((generated / "truth.json").read_text()) | change))
    with pytest.raises(EvaluationError):
        load_truth(spark, path)


def test_tables_as_parquet(spark, result, tmp_path):
    plan.write_tables(result, str(tmp_path / "tables"))
    back = spark.read.parquet(str(tmp_path / "tables" / "findings.parquet"))
    assert back.count() == 66 and spark.read.parquet(str(tmp_path / "tables" / "predictions.parquet")).count() == 15


def test_model_answers_are_kept_in_a_shared_folder(spark, tmp_path):
    class Counted:
        model = "a model/1"

        def generate(self, prompt):
            (tmp_path / "calls").open("a").write("x")
            return '{"facts": []}'

    notes = N.normalize(raw(spark, [line(1)], notes=NOTES)).notes
    for _ in range(2):
        told = O.extract(notes, ModelReader(Counted(), str(tmp_path / "cache")))
        assert (told.reader, told.notes_read, told.invalid_outputs, told.facts.count()) == ("a model/1", 7, 0, 0)
    assert len((tmp_path / "calls").read_text()) == 7 and all(p.name.startswith("a_model_1-N") for p in (tmp_path / "cache").iterdir())


def test_a_backend_that_fails_is_asked_again_and_then_named():
    with pytest.raises(BackendError, match="2 calls of m at http://127.0.0.1:9"):
        HttpBackend("m", "http://127.0.0.1:9", 0.2).generate("x")


def test_nothing_is_written_where_raw_files_are(tmp_path):
    folder = write(tmp_path / "raw", [])
    (tmp_path / "hard.csv").hardlink_to(folder / "bom.csv")
    (tmp_path / "soft").symlink_to(folder)
    (tmp_path / "gone.json").symlink_to(folder / "new.json")
    for bad in ("raw/x.json", "hard.csv", "soft/x/y.json", "gone.json", "raw/../raw/z"):
        assert trespass([tmp_path / "fine.json", tmp_path / bad], folder), bad
    assert trespass([tmp_path / "fine" / "x.json"], folder) is None and trespass([tmp_path / "x"], tmp_path / "none") is None

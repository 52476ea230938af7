"""What engine queries must not do with many rows: compute twice, compare copies, shuffle what a small table tells."""

from __future__ import annotations

import glob
import os

from partkin.operators import baselines, notes, resolve, signatures as S
from partkin.plans import driver_queries
from partkin.runtime import cut, kept

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def variants(spark):
    return spark.sql("SELECT * FROM VALUES ('2000', DATE'2000-01-01'), ('2001', DATE'2001-01-01') t(id, design_date)")


def sizes(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder.removeprefix('file:')}/**", recursive=True) if os.path.isfile(f))


def test_equal_targets_are_compared_once(spark, monkeypatch):
    sig = "array({}) AS items"
    item = "struct('{}' AS c, 'pcs' AS u, 1.0D AS q)"
    new, old = (sig.format(", ".join(item.format(c) for c in names)) for names in ("ABCDE", "ABCDF"))
    sigs = spark.sql(f"SELECT concat('2001:', id) AS sub_assembly_id, '2001' AS variant_id, {new} FROM range(30) UNION ALL SELECT '2000:x', '2000', {old}")
    seen, compared = [], S.compared
    monkeypatch.setattr(S, "compared", lambda pairs, t: seen.append(pairs.count()) or compared(pairs, t))
    got = S.backtest(sigs, variants(spark)).collect()
    assert seen == [1]
    assert {(r["reuse_class"], r["ancestor_id"], r["n_parts"], r["n_qty"]) for r in got} == {("reusable", "2000:x", 2, 0)}
    assert sorted(r["sub_assembly_id"] for r in got) == sorted(f"2001:{k}" for k in range(30))


def test_predictions_are_computed_once_for_the_difference(spark):
    predictions = spark.range(2).selectExpr("concat('2001:', id) AS sub_assembly_id", "'2000:x' AS ancestor_id", "'reusable' AS reuse_class")
    items = spark.sql("SELECT * FROM VALUES ('2001:0', 'A', 'pcs', 1.0D), ('2000:x', 'A', 'pcs', 2.0D), ('2001:1', 'B', 'pcs', 1.0D) t(sub_assembly_id, component_id, unit, quantity)")
    diff = S.backtest_diff(predictions, items)
    assert "Range" not in diff._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["sub_assembly_id"], r["component_id"], r["change"]) for r in diff.collect()) == [("2001:0", "A", "quantity_changed"), ("2001:1", "A", "removed"), ("2001:1", "B", "added")]


def test_search_reads_the_bill_once(spark):
    bom = spark.range(3).selectExpr("cast(2000 + id % 2 AS string) AS variant_id", "concat('S', id) AS sub_assembly_ref", "'Door' AS sub_assembly_designation")
    found = baselines.search(bom, S.chronology(variants(spark)), "same_name")
    assert "Range" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("2001:S1", "2001", "reused", "2000:S0")]


def test_lines_learn_of_few_keys_where_they_lie(spark):
    rows = [
        (1, "l1", "K", "door"), (2, "l2", "K", "door left"), (3, "l3", "R", "wall"), (4, "l4", "R", "roof"),
        (5, "l5", "R", ""), (6, "l6", "R", ""), (7, "l7", "R", "wall"), (8, "l8", "", "x"),
    ]
    lines = spark.createDataFrame(rows, "row_number long, line_id string, child_id string, designation string").selectExpr("*", "'m' AS unit", "'s' AS supplier", "1.0D AS cost")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = resolve.canonical_lines(lines, cut(resolve.groups(lines)))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r["row_number"]: r["component_id"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {1: "K", 2: "K", 3: "R#4", 7: "R#4", 4: "R#3", 5: "R#1", 6: "R#2"}


def test_kept_rows_take_less_room_than_a_checkpoint(spark):
    lines = spark.range(100_000).selectExpr("id", "concat('SA-', id % 900) AS ref", "'maker' AS supplier", "1.0D AS cost").coalesce(1)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    before = sizes(folder.get()) if folder.isDefined() else 0
    assert kept(lines).exceptAll(lines).count() == 0
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    middle = sizes(folder)
    cut(lines)
    assert 4 * (middle - before) < sizes(folder) - middle


def test_merged_evidence_leaves_notes_alone(spark, monkeypatch):
    monkeypatch.setattr(notes, "note_facts", None)
    assert driver_queries.merged_evidence(spark, SF).count() > 0


def test_bills_shuffle_lines_twice(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = driver_queries._view(spark, SF, driver_queries.BOM_VIEW)
        plan = view._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # lines with their brands, and orders
    assert "part.parquet" not in plan


def test_lines_of_four_brands_are_those_of_the_sql(spark):
    lineitem = spark.sql("SELECT * FROM VALUES (1L,1,1L,9L),(1L,2,2L,9L),(1L,3,3L,9L),(1L,4,4L,9L),(2L,1,1L,9L),(2L,2,2L,9L),(2L,3,3L,9L),(2L,4,5L,9L),"
                         "(3L,1,1L,9L),(3L,2,2L,9L),(3L,3,3L,9L),(3L,4,6L,9L),(4L,1,7L,9L),(4L,2,2L,9L),(4L,3,3L,9L),(4L,4,4L,9L),(4L,5,NULL,9L),"
                         "(NULL,1,1L,9L),(NULL,2,2L,9L),(NULL,3,3L,9L),(NULL,4,4L,9L),(5L,1,1L,9L),(5L,2,2L,9L),(5L,3,3L,9L),(5L,4,4L,9L) t(l_orderkey,l_linenumber,l_partkey,l_suppkey)")  # fmt: skip
    orders = spark.sql("SELECT * FROM VALUES (1L,7L,DATE'2000-01-01','1-URGENT'),(1L,8L,DATE'2001-01-01','5-LOW'),(2L,7L,DATE'2000-01-01','1'),(3L,7L,DATE'2000-01-01','1'),(4L,7L,DATE'2000-01-01','1') t(o_orderkey,o_custkey,o_orderdate,o_orderpriority)")
    # part 5 has the brand of part 1, part 6 none; part 7 is there twice
    part = spark.sql("SELECT * FROM VALUES (1L,'A'),(2L,'B'),(3L,'C'),(4L,'D'),(5L,'A'),(6L,NULL),(7L,'E'),(7L,'F') t(p_partkey,p_brand)")
    sql = driver_queries._FOUR_BRANDS.replace("FROM lineitem", "FROM {lineitem}").replace("JOIN orders", "JOIN {orders}").replace("JOIN part", "JOIN {part}")
    columns = "l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderdate, o_orderpriority, p_brand"
    want = spark.sql(f"SELECT {columns} {sql}", lineitem=lineitem, orders=orders, part=part).collect()
    got = driver_queries._four_brands(lineitem, orders, part).selectExpr(*columns.split(", ")).collect()
    assert len(got) == 4 * 2 + 5 and sorted(map(str, got)) == sorted(map(str, want))


def test_lines_are_kept_without_ids_that_no_one_reads(spark):
    d = driver_queries._cut(spark, SF, driver_queries.BOM_VIEW, "variant_id", ids=False)
    assert "line_id" not in spark.read.parquet(*d.lines.inputFiles()).columns
    assert d.lines.where("line_id IS NOT NULL").count() == 0


def test_flagged_parts_keeps_no_line_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(driver_queries, "kept", lambda df: seen.append(df.columns) or kept(df))
    driver_queries.flagged_parts(spark, SF)
    assert any("child_id" in c for c in seen) and not any("line_id" in c for c in seen)


def test_backtest_diff_keeps_no_line_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(driver_queries, "kept", lambda df: seen.append(df.columns) or kept(df))
    driver_queries.backtest_diff(spark, SF)
    assert any("child_id" in c for c in seen) and not any("line_id" in c for c in seen)


def test_scores_read_one_bill(spark, monkeypatch):
    read, rows = [], driver_queries._four_brands
    monkeypatch.setattr(driver_queries, "_four_brands", lambda *tables: read.append(1) or rows(*tables))
    driver_queries.evaluate_scores(spark, SF)
    assert read == [1]

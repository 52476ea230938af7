"""The pipeline on the smallest tables: each stage against what it must do to its own input."""

from __future__ import annotations

import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from partkin.llm import mixing, quality, queries, shared
from tests.llm.test_operators import removed_lines, similar_classes

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark):
    """(input rows, output rows) of every stage."""
    docs, out = shared.table(spark, SF, "documents"), []
    columns = docs.columns
    for name, f in P.STAGES:
        before = docs.collect()
        docs = shared.cut(f(spark, docs, SF))
        assert name == P.STAGES[-1][0] or docs.columns == columns
        out.append((before, docs.collect()))
    return out


def test_quality_stage_keeps_what_is_labelled_good(stages, spark):
    before, after = stages[0]
    kept = {r["doc_id"] for r in after}
    labels = {r["doc_id"]: r["quality"] for r in shared.table(spark, SF, "labels").collect()}
    unseen = [(i in kept) == bool(q) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.95 and np.mean(unseen) > 0.9
    scores = {r["doc_id"]: r["score"] for r in queries.op6_quality(spark, SF).collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.7}
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_line_stage_is_brute_force(stages):
    before, after = stages[1]
    want = removed_lines({r["doc_id"]: r["text"] for r in before})
    assert {r["doc_id"]: r["text"] for r in after} == {i: "\n".join(lines) for i, (lines, *_) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_stage_keeps_one_of_each_class(stages):
    before, after = stages[2]
    rows = {r["doc_id"]: r["text"] for r in before}
    kept = {r["doc_id"] for r in after}
    assert kept == set(similar_classes(rows, 0.8).values()) and {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_mixing_stage_takes_the_targets(stages, spark):
    before, after = stages[3]
    size = lambda t: len((t or "").encode().split())
    names = sorted({r["source"] for r in before})
    total = np.array([sum(size(r["text"]) for r in before if r["source"] == s) for s in names])
    target = mixing.water_level(total, np.array([mixing.WEIGHTS[k % 3] for k in range(len(names))]), 1.5, 2)
    for s, t in zip(names, target, strict=True):
        assert abs(sum(size(r["text"]) for r in after if r["source"] == s) - t) <= 0.02 * t + 2


def tokens_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, 1] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing_stage_packs_every_row(stages):
    """Every sequence is gapless, and its pieces are the documents' own ids: each id once."""
    before, after = stages[4]
    want = Counter((r["doc_id"], len(ids)) for r, ids in zip(before, tokens_of([r["text"] for r in before]), strict=True))
    got = Counter()
    for r in after:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert got == Counter({k: n * k[1] for k, n in want.items()})
    own = {}
    for r, ids in zip(before, tokens_of([r["text"] for r in before]), strict=True):
        own.setdefault((r["doc_id"], len(ids)), []).append(np.array(ids, "<u4"))
    for r in after:
        parts = {zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for ids in own[r["doc_id"], r["doc_tokens"]]}
        assert r["ids_crc32"] in parts
    by = {}
    for r in after:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_run_is_its_stages(stages, spark):
    """The same pieces of the same documents, whatever sequence they are in."""
    whole = lambda got: Counter((r["doc_id"], r["doc_tokens"]) for r in got for _ in range(r["length"]))
    assert whole(P.run(spark, SF).collect()) == whole(stages[4][1])


def test_without_labels_nothing_is_rejected(spark, monkeypatch):
    docs = shared.table(spark, SF, "documents").limit(20)
    monkeypatch.setattr(P, "learn", lambda *a: quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)))
    assert P.keep_quality(spark, docs, SF).count() == 20


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()
    order = lambda df: df[sorted(df.columns)].astype(str).sort_values(sorted(df.columns)).to_numpy().tolist()
    assert order(got) == order(want)


def test_held_out_fold(spark):
    got = {r["doc_id"]: r["h"] for r in spark.range(200).selectExpr("id AS doc_id").select("doc_id", shared.held_out(shared.F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}

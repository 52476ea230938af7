"""What corpus operators must not do with large groups: join a text again for each bucket, write a file for each partition."""

from __future__ import annotations

import random

from partkin.llm import near_dedup


def test_a_text_is_joined_once_however_many_buckets_it_shares(spark, monkeypatch):
    words = random.Random(3)
    base = [f"w{words.randrange(500)}" for _ in range(300)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(30)]
    plans, cut = [], near_dedup.cut
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    monkeypatch.setattr(near_dedup, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["class_id"], r["class_size"]) for r in got} == {(0, 30)}
    met = [p for p in plans if "Arrow" in p and "signature" in p and "Join" in p]
    assert met and all("Generate inline" in p and p.index("Generate inline") < p.index("Join") for p in met)


def test_few_links_make_few_files(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "a long, b long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would join small partitions, unless a session forbids it
    try:
        got = near_dedup.connected(links)
        assert got.rdd.getNumPartitions() == 1
        assert {r["id"]: r["class_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

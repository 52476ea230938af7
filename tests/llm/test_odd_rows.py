"""Every operator on the rows that break things: nulls, empty and long texts, repeated rows, other id types, clashing columns, no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from partkin.llm import exact_dedup, fingerprints, html_text, language_id, line_dedup, mixing, near_dedup, packing, quality, substring_dedup


def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")


OPERATORS = {
    "language": (lambda s, d: language_id.identify_language(d), True),
    "fingerprints": (lambda s, d: fingerprints.document_fingerprints(d), True),
    "lines": (lambda s, d: line_dedup.line_dedup(d), True),
    "near": (lambda s, d: near_dedup.near_dedup(d), True),
    "near_rows": (lambda s, d: near_dedup.without_near_copies(d), False),
    "quality": (lambda s, d: quality.score_quality(d, labels(s)), True),
    "pack": (lambda s, d: packing.pack(d), False),
    "mix": (lambda s, d: mixing.mix(d), True),
    "mixed": (lambda s, d: mixing.mixed(d), False),
    "substrings": (lambda s, d: substring_dedup.substring_dedup(d), True),
    "exact": (lambda s, d: exact_dedup.exact_dedup(d), True),
}
#: All that an operator returns or uses inside, as columns of the input.
NAMES = (
    "value key block rep label kind bucket digit n class_id class_size kept keep_id group_size row content weight d1 d2 signature bands held_out score predicted lang_pred ambiguous start length"
    " tokens ids place doc_tokens sequence_id offset size source_size target taken n_lines n_removed n_bytes n_spans kept_sha256 fingerprint near_next edited_sha256 code tail lines starts w a b first h t n_shards shard hash"
).split()
LONG = "lorem ipsum dolor sit amet consectetur " * 8_000


def documents(spark, ids=lambda k: k):
    rows = [(ids(k), f"text number {k} with some words of its own\nand a line\nand another\nof no use", "en" if k % 2 else "fr", f"s{k % 3}") for k in range(12)]
    rows += [rows[3], rows[3], (ids(3), "another text under the same id", "en", "s0"), (None, rows[4][1], "en", None), (None, None, None, None), (ids(50), None, "en", "s1"), (ids(51), "", None, "s1"), (ids(52), LONG, "en", "s2"), (ids(53), " \n\t\n ", "fr", "s2"), (ids(54), "a\u0000b   漢字 🙂", "en", "s2")]
    return rows


def table(spark, rows, kind="long", extra=True):
    docs = spark.createDataFrame([(None if i is None else str(i), *rest) for i, *rest in rows], "doc_id string, text string, lang string, source string")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumns({c: F.lit(f"own {c}") for c in NAMES}) if extra else docs


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name_change_nothing(spark, name):
    run, per_row = OPERATORS[name]
    rows = documents(spark)
    odd, plain = (run(spark, table(spark, rows, extra=extra)) for extra in (True, False))
    got, want = odd.toPandas(), plain.toPandas()
    assert len(got) == len(want) and (not per_row or len(got) == len(rows))
    shared = [c for c in want.columns if c not in ("sequence_id", "offset", "start", "length", "ids_crc32")]
    order = lambda df: sorted(map(tuple, df[shared].astype(str).to_numpy().tolist()))
    assert order(got) == order(want)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows_give_no_rows(spark, name):
    assert OPERATORS[name][0](spark, table(spark, documents(spark)).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["fingerprints", "near", "near_rows", "pack", "substrings"])
def test_ids_that_have_no_order_are_refused(spark, name):
    with pytest.raises(TypeError, match="doc_id must be a column of integers"):
        OPERATORS[name][0](spark, table(spark, documents(spark), "string"))


@pytest.mark.parametrize("name", sorted(OPERATORS.keys() - {"mixed"}))  # hashes of ids of another type choose other rows
def test_small_ids(spark, name):
    rows = documents(spark)
    got, want = (OPERATORS[name][0](spark, table(spark, rows, kind, False)).select(F.col("doc_id").cast("long").alias("i")).toPandas() for kind in ("smallint", "long"))
    assert sorted(got["i"].astype(str)) == sorted(want["i"].astype(str))


def test_pages_of_any_kind(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "own"), (1, "u", "<p>x</p>", "own"), (None, None, None, None), (2, "u", "", None), (3, "u", "<p>" + "word " * 200_000 + "</p>", "t")], "page_id long, url string, html string, text string")
    pages = pages.withColumns({c: F.lit("own") for c in ("n_chars", "lines")})
    got = html_text.extract_main_text(pages).collect()
    assert sorted((r["page_id"] or -1, r["n_chars"]) for r in got) == [(-1, 0), (1, 1), (1, 1), (2, 0), (3, 999_999)]

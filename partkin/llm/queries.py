"""The driver's queries over the corpus tables, one for each operator, and their SQL where there is any.

A query applies its operator, with production parameters, to its whole table. Operators are imported
when their query runs, so that one query never waits for the libraries of another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship
from .shared import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_language

    return identify_language(table(ship(spark), sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import document_fingerprints

    return document_fingerprints(table(ship(spark), sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text

    return extract_main_text(table(ship(spark), sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "n_lines", "n_removed")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(table(ship(spark), sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(ship(spark), sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(ship(spark), sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(ship(spark), sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_fingerprints": op2_fingerprints,
    "op3_html_text": op3_html_text,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality": op6_quality,
    "op7_pack": op7_pack,
    "op8_mix_sources": op8_mix_sources,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
}

#: Repeated three-line windows: every window but the first covers its lines, which go.
LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs})
), windows AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS r
  FROM windows WHERE c IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE r > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id
)
"""

#: Strings of 100 bytes, in hexadecimal digits: each that starts earlier too goes, runs of them joined.
SUBSTRING_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
  SELECT doc_id, i, CASE WHEN i > lag(i, 1, -200) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS fresh FROM later)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
follow AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (
  SELECT f.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS upto, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front
  FROM follow f JOIN d ON d.doc_id = f.doc_id GROUP BY f.doc_id)
SELECT d.doc_id, (length(d.h) // 2)::bigint AS n_bytes, coalesce(k.n_removed, 0)::bigint AS n_removed, coalesce(k.n_spans, 0)::bigint AS n_spans,
       sha256(unhex(coalesce(k.front || substr(d.h, 2 * k.upto + 1), d.h))) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

#: Targets by water level, blocks and quotas by highest quotients, documents in the order of their hash;
#: for sources of up to 4096 shards, which are one group.
MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(text, '')) AS t FROM documents),
totals AS (SELECT source, sum(size)::bigint AS source_size, greatest(1, ceil(count(*) / 4096.0))::bigint AS shards FROM sized GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank, 2.0::double * source_size AS cap FROM totals),
given AS (SELECT *, ([5.0::double, 2.0::double, 1.0::double])[rank % 3 + 1] AS w FROM weighed),
level AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, rank) AS k, 1.5::double * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM given),
stop AS (SELECT min(k) AS k, arg_min(rest, k) AS rest, arg_min(open, k) AS open FROM level WHERE cap > w * rest / open),
targets AS (SELECT l.*, CASE WHEN s.k IS NULL OR l.k < s.k THEN l.cap ELSE least(l.w * s.rest / s.open, l.cap) END AS target FROM level l, stop s),
cut AS (SELECT greatest(1, least(1024, min(floor(target / 200)) FILTER (target > 0)))::bigint AS block FROM targets),
seats AS (SELECT round_even(sum(target) / any_value(block), 0)::bigint AS n FROM targets, cut),
won AS (SELECT rank, count(*) AS blocks FROM (
  SELECT rank, row_number() OVER (ORDER BY target / (2.0::double * s + 1) DESC, rank, s) AS nth
  FROM (SELECT rank, target, unnest(range(0, (SELECT n FROM seats))) AS s FROM targets WHERE target > 0)) WHERE nth <= (SELECT n FROM seats) GROUP BY rank),
dealt AS (
  SELECT d.*, t.rank, t.source_size, t.target, ('0x' || substr(md5('18:' || coalesce(d.doc_id::varchar, '') || ':' || d.t), 1, 8))::bigint % t.shards AS shard
  FROM sized d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source),
words AS (SELECT rank, shard, sum(size)::bigint AS words FROM dealt GROUP BY rank, shard),
quotients AS (
  SELECT rank, shard, row_number() OVER (PARTITION BY rank ORDER BY words / (2.0::double * s + 1) DESC, shard, s) AS nth
  FROM (SELECT rank, shard, words, unnest(range(0, (2 * words + (SELECT block FROM cut) - 1) // (SELECT block FROM cut))) AS s FROM words WHERE words > 0)),
quota AS (SELECT q.rank, q.shard, count(*) AS n FROM quotients q JOIN won b ON b.rank = q.rank AND q.nth <= b.blocks GROUP BY q.rank, q.shard),
plan AS (SELECT w.rank, w.shard, w.words, least(coalesce(q.n, 0) * (SELECT block FROM cut), 2 * w.words) AS take FROM words w LEFT JOIN quota q ON q.rank = w.rank AND q.shard = w.shard),
placed AS (
  SELECT d.*, p.words, p.take, sum(d.size) OVER (PARTITION BY d.rank, d.shard ORDER BY md5('17:' || coalesce(d.doc_id::varchar, '')), d.doc_id, d.t ROWS UNBOUNDED PRECEDING) AS upto
  FROM dealt d JOIN plan p ON p.rank = d.rank AND p.shard = d.shard)
SELECT doc_id, source, size::bigint AS size, source_size, target,
       (CASE WHEN words > 0 THEN take // words * size + greatest(0, least(size, take % words - (upto - size))) ELSE 0 END)::bigint AS taken
FROM placed
"""

ORACLE_SQL: dict[str, str] = {
    "op8_mix_sources": MIX_SQL,
    "op9_substring_dedup": SUBSTRING_SQL,
    "op4_line_dedup": LINE_DEDUP_SQL.format(docs="documents")
    + """
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text,
       CASE WHEN k.n_removed = 0 THEN d.n_chars ELSE length(k.text) END AS n_chars, k.n_lines, k.n_removed
FROM documents d JOIN kept k ON k.doc_id = d.doc_id
""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
}

"""The queries opN_<name> over the whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quillgraph.llm import decontamination, html_extract, language_id, mixing, near_dedup, quality_fm, quality_rules, secret_scan, token_counts, url_filter
from quillgraph.plans.shared import cut

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.found(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality_fm.learned(docs, table(spark, sf_dir, "labels").filter(_fold(4) != 2), metadata=("n_chars",))
    return quality_fm.scored(docs, machine, metadata=("n_chars",)).select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=3, similarity=(85, 100))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learned(docs.filter(_fold(5) != 0), id_col="doc_id")
    return language_id.predicted(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(mixing.sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text"))
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_url_filters, op3_secrets, op4_decontamination, op5_quality, op6_near_dedup, op7_token_counts, op8_language_id, op9_mixing, op10_quality_rules)
}

_HOST_PATH = """
  cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM cut)"""

ORACLES: dict[str, str] = {
    "op2_url_filters": f"""
WITH {_HOST_PATH},
  judged AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged""",
    "op6_near_dedup": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sets AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM words),
  sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY ALL),
  links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    WHERE least(x.n, y.n) * 100 >= 85 * greatest(x.n, y.n)
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op9_mixing": r"""
WITH own AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS tie FROM documents),
  banded AS (SELECT *, length(bin(size)) * 4 + CASE rpad(substr(bin(size), 2, 2), 2, '0') WHEN '00' THEN 0 WHEN '01' THEN 1 WHEN '10' THEN 2 ELSE 3 END AS band,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || tie), 1, 8))::BIGINT % 256 AS cell FROM own),
  sources AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap FROM own GROUP BY source),
  weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
  levels AS (SELECT *, ((SELECT sum(source_size) FROM sources) * 150 / 100.0::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM weighed),
  found AS (SELECT arg_min(level, cap / weight) AS final FROM levels WHERE level * weight < cap),
  goal AS (SELECT source, source_size, CASE WHEN final IS NULL OR final * weight >= cap THEN cap::DOUBLE ELSE final * weight END AS target FROM levels LEFT JOIN found ON true),
  placed AS (SELECT b.*, source_size, target, row_number() OVER (PARTITION BY b.source ORDER BY band, cell, size, doc_id NULLS LAST, tie) AS r,
    ('0x' || substr(md5('mix:' || CASE WHEN b.source IS NULL THEN 'null:' ELSE 'of:' || b.source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
    FROM banded b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source),
  rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM placed)
SELECT doc_id, size, source_size, target, ((floor(r * rate + u) - floor((r - 1) * rate + u))::BIGINT * size)::BIGINT AS taken FROM rated""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

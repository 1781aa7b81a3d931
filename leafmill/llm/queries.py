"""The thin registered queries, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, language_id, line_dedup, mixing, packing, pii, simhash, token_counts, token_files, url_filter, vector_dedup, vector_search, whitening

#: The rules (verdict, host, path) of the URL query.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_spread_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "lines_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find_spans(docs, pii.fit(docs))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_groups(_table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    docs = docs.select("doc_id", "text", "lang", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    model = language_id.fit(docs, where=~F.col("held_out") & F.col("doc_id").isNotNull())
    return language_id.predict(docs, model, carry=("held_out",))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(_table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_documents(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_line_dedup, op3_pii, op4_vector_dedup, op5_url_filter, op6_language_id, op7_packing, op8_simhash, op9_vector_search, op10_mixing,
        op11_alignment, op12_token_files, op13_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, coalesce('s' || source, '') AS site, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM d),
n AS (SELECT doc_id, site, pos, trim(raw, ' ') AS line FROM l WHERE trim(raw, ' ') <> ''),
s AS (SELECT line, min((doc_id, pos)) AS first FROM n GROUP BY line HAVING count(DISTINCT site) >= 5),
g AS (SELECT n.doc_id, n.pos FROM n JOIN s USING (line) WHERE (n.doc_id, n.pos) <> s.first),
k AS (SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS kept, count(g.pos) AS gone
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(gone, 0) AS lines_removed,
       CASE WHEN text IS NULL THEN NULL ELSE length(coalesce(kept, '')) END AS n_chars,
       CASE WHEN text IS NULL THEN NULL ELSE md5(coalesce(kept, '')) END AS text_md5
FROM d LEFT JOIN k USING (doc_id)""",
    "op5_url_filter": """
WITH p AS (SELECT page_id, coalesce(url, '') AS u, position('://' IN coalesce(url, '')) AS spot FROM pages),
r AS (SELECT page_id, CASE WHEN spot > 0 THEN substr(u, spot + 3) ELSE '' END AS rest FROM p),
h AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest FROM r),
x AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT x.page_id, rule_host || rule_path AS rule, verdict,
             row_number() OVER (PARTITION BY x.page_id ORDER BY length(rule_host || rule_path) DESC) AS k
      FROM x JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT x.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM x LEFT JOIN m ON m.page_id = x.page_id AND k = 1""",
}

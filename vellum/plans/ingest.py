"""Queries for ingestion and for answers over many questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import answers as A
from vellum.operators import ingest as I  # noqa: E741
from vellum.operators import structure as S
from vellum.operators import versions as N
from vellum.sources.tables import table


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "structural_unit").dropDuplicates(["unit_id"]).withColumn("parent_id", F.nullif("parent_id", F.lit(0)))


def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    return I.clean_lines(table(spark, folder, "documents"), "doc_id", "text")


def heading_units(spark: SparkSession, folder: str) -> DataFrame:
    found = I.units_from_lines(clean_lines(spark, folder), "doc_id")
    return found.select("doc_id", "unit_no", "unit_type", "unit_number", F.length("text").cast("bigint").alias("n"))


def breadcrumb(spark: SparkSession, folder: str) -> DataFrame:
    units = _units(spark, folder)
    pairs = S.ancestor_pairs(units, "document_version_id", "unit_id", "unit_path").select("unit_id", "ancestor", F.length("ancestor_path").alias("depth"))
    titles = table(spark, folder, "document_version").dropDuplicates(["document_version_id"]).join(table(spark, folder, "legal_source").select("source_id", "title"), "source_id").select("document_version_id", "title")
    return I.breadcrumbs(units, pairs, titles)


def unit_selection(spark: SparkSession, folder: str) -> DataFrame:
    units = _units(spark, folder)
    pairs = S.ancestor_pairs(units, "document_version_id", "unit_id", "unit_path").select("unit_id", "ancestor")
    return I.select_units(units, pairs, ["paragraph"]).select("unit_id", "unit_type")


def unit_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return I.chunk_units(_units(spark, folder)).select("unit_id", "chunk_no", "tokens", F.length("text").alias("n_chars"))


def ingest_plan(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "document_version").dropDuplicates(["document_version_id"]).withColumnRenamed("content_sha256", "sha")
    fetched = N.latest(versions.select("source_id", "document_version_id", "sha"), ["source_id"], ["document_version_id"]).select("source_id", "sha")
    counts = table(spark, folder, "structural_unit").groupBy("document_version_id").agg(F.count_distinct("unit_id").alias("n"))
    return I.ingest_plan(fetched, versions.where("status = 'active'"), counts)


def pending_versions(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "document_version").where("status in ('discovered', 'ingesting')").dropDuplicates(["document_version_id"])
    return N.latest(versions.select("source_id", "document_version_id", "version_label"), ["source_id"], ["document_version_id"]).select("source_id", "document_version_id", "version_label")


def healthz(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "legal_source").agg(F.count("*").alias("sources")).join(table(spark, folder, "structural_unit").agg(F.count_distinct("unit_id").alias("units")), F.lit(True))  # one row on each side


def answer_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled evidence for every question that has hits."""
    hits = table(spark, folder, "candidate").dropDuplicates(["candidate_id"]).select("query_id", F.col("structural_unit_id").alias("unit_id"), "leg", "leg_rank")
    sources = table(spark, folder, "document_version").dropDuplicates(["document_version_id"]).join(table(spark, folder, "legal_source").select("source_id", F.lower("authority").alias("authority")), "source_id").select("document_version_id", "authority")
    units = _units(spark, folder).join(sources, "document_version_id")
    return A.gather_evidence(hits, units).select("query_id", "unit_id", "authority", "place", "label", "cost", "spent")


def structure_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """What is read around the code units of each question's evidence."""
    return S.with_structure(answer_evidence(spark, folder).select("query_id", "unit_id", "authority", "place"), _units(spark, folder), "query_id", 2_400)


def fitted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut by lines to 300 tokens."""
    from vellum.functions.text import fit_lines

    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.length(fit_lines(F.col("text"), 300)).alias("n"))


def usage_by_model(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "query_log").dropDuplicates(["query_id"]).where("model is not null")
    usage = log.select(F.col("query_id").alias("question_id"), "model", F.col("quotes_total").alias("input"), F.col("quotes_dropped").alias("output"), F.lit(1).alias("calls"))
    return A.merge_usage(usage)


_U = "WITH u AS (SELECT DISTINCT ON (unit_id) * REPLACE (nullif(parent_id, 0) AS parent_id) FROM structural_unit ORDER BY unit_id)"
_V = "v AS (SELECT DISTINCT ON (document_version_id) * FROM document_version ORDER BY document_version_id)"
_L = r"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split_regex(text, '\r?\n')), '^[\s\x0B\p{Z}]+|[\s\x0B\p{Z}]+$', '', 'g') AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
k AS (SELECT * FROM l WHERE line <> '' AND NOT regexp_matches(line, '^\s*\d{1,3}\s*$') AND NOT regexp_matches(line, '^[▲▼►◄]\s*[BM]\d*\s*$') AND NOT regexp_matches(line, '\.{4,}\s*\d+\s*$'))
"""
SQL = {
    "clean_lines": _L + "SELECT doc_id, line_no, line FROM k",
    "unit_selection": _U
    + ", p AS (SELECT x.unit_id, x.unit_type, y.unit_id AS ancestor FROM u x JOIN u y ON x.document_version_id = y.document_version_id AND starts_with(x.unit_path, y.unit_path || '/')) SELECT unit_id, unit_type FROM u WHERE unit_type = 'paragraph' OR unit_id IN (SELECT ancestor FROM p WHERE unit_type = 'paragraph')",
    "ingest_plan": f"WITH {_V}, f AS (SELECT source_id, arg_max(content_sha256, document_version_id) AS sha FROM v GROUP BY 1), c AS (SELECT document_version_id, count(DISTINCT unit_id) AS n FROM structural_unit GROUP BY 1), a AS (SELECT source_id, content_sha256 AS old, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (document_version_id) WHERE status = 'active') SELECT source_id, CASE WHEN old = sha AND n > 0 THEN 'up_to_date' ELSE 'ingest' END AS action FROM f LEFT JOIN a USING (source_id)",
    "pending_versions": f"WITH {_V} SELECT source_id, max(document_version_id) AS document_version_id, arg_max(version_label, document_version_id) AS version_label FROM v WHERE status IN ('discovered', 'ingesting') GROUP BY 1",
    "healthz": "SELECT (SELECT count(*) FROM legal_source) AS sources, (SELECT count(DISTINCT unit_id) FROM structural_unit) AS units",
    "usage_by_model": "SELECT query_id AS question_id, model, CAST(sum(coalesce(quotes_total, 0)) AS BIGINT) AS input, CAST(sum(coalesce(quotes_dropped, 0)) AS BIGINT) AS output, count(*) AS calls FROM (SELECT DISTINCT ON (query_id) * FROM query_log ORDER BY query_id) WHERE model IS NOT NULL GROUP BY ALL",
    "breadcrumb": _U
    + """, p AS (SELECT x.unit_id, y.unit_id AS ancestor, length(y.unit_path) AS depth FROM u x JOIN u y ON x.document_version_id = y.document_version_id AND starts_with(x.unit_path, y.unit_path || '/') UNION ALL SELECT unit_id, unit_id, 1000000 FROM u),
n AS (SELECT p.unit_id, string_agg(upper(a.unit_type[1]) || a.unit_type[2:] || ' ' || a.unit_number, ', ' ORDER BY depth, ancestor) FILTER (a.unit_number IS NOT NULL AND a.unit_type IN ('annex', 'chapter', 'section', 'article', 'recital', 'paragraph')) AS labels,
  max(struct_pack(d := depth, h := nullif(trim(a.heading), ''))) FILTER (nullif(trim(a.heading), '') IS NOT NULL) AS h FROM p JOIN u a ON a.unit_id = p.ancestor GROUP BY 1)
SELECT u.unit_id, concat_ws(' - ', s.title, coalesce(nullif(trim(u.context), ''), labels), h.h) AS breadcrumb FROM u JOIN n USING (unit_id) LEFT JOIN document_version v USING (document_version_id) LEFT JOIN legal_source s USING (source_id)""",
}
QUERIES = {f.__name__: f for f in (clean_lines, heading_units, breadcrumb, unit_selection, unit_chunks, ingest_plan, pending_versions, healthz, answer_evidence, structure_expansion, fitted_texts, usage_by_model)}

"""Queries for titles, numbers, names, links and messages."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import labels as L
from vellum.functions import text as T
from vellum.sources.tables import table

TOKENIZERS = os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers")


def heading_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct headings and first lines as clean titles with their number."""
    headings = table(spark, folder, "structural_unit").select("heading").unionByName(table(spark, folder, "documents").select(F.substring_index("text", "\n", 1).alias("heading")))
    titles = headings.where("heading is not null").distinct().select("heading", L.clean_title(F.col("heading")).alias("title"))
    parted = titles.withColumn("p", L.number_and_rest(F.col("title")))
    return parted.select("heading", "title", "p.number", "p.rest", F.array_join(F.transform(L.number_parts(F.col("p.number")), lambda x: F.lpad(x.cast("string"), 5, "0")), ".").alias("sort_key"), L.folded_title(F.col("heading")).alias("folded"))


def version_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of versions as consolidated or adopted, and as draft or published."""
    v = table(spark, folder, "document_version").dropDuplicates(["document_version_id"])
    name = L.version_label(F.col("celex"), F.col("doc_date"), F.coalesce(F.startswith("celex", F.lit("0")), F.lit(False)))
    return v.select("document_version_id", name.alias("label"), L.publication_label(F.when(F.col("status") == "active", "published").otherwise("draft"), F.col("doc_date")).alias("publication"))


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """File names of sources, and the keys and titles read back from them."""
    name = F.concat(F.lpad(F.col("source_id").cast("string"), 2, "0"), F.lit("_"), F.translate("title", " ", "_"), F.lit(".pdf"))
    named = table(spark, folder, "legal_source").select("source_id", name.alias("name"))
    return named.select("source_id", "name", L.key_of_file(F.col("name"), "ec").alias("key"), L.title_of_file(F.col("name")).alias("title"))


def unit_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of units: the landing page of sources without a register number, else the place in the register."""
    sources = table(spark, folder, "legal_source").select("source_id", F.when(F.col("celex_base").isNull(), F.concat(F.lit("https://library.example/"), "source_key")).alias("landing"))
    versions = table(spark, folder, "document_version").dropDuplicates(["document_version_id"]).join(sources, "source_id").select("document_version_id", "celex", "landing")
    units = table(spark, folder, "structural_unit").select("unit_id", "document_version_id", "unit_type", "unit_number", "unit_path").dropDuplicates(["unit_id"])
    link = L.unit_link("https://register.example/text", F.col("landing"), F.col("celex"), F.col("unit_type"), F.col("unit_number"), F.col("unit_path"))
    return units.join(versions, "document_version_id").select("unit_id", link.alias("link"))


def short_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of numbered units in their short form."""
    units = table(spark, folder, "structural_unit").where("unit_number is not null").select(F.concat_ws(" ", F.initcap("unit_type"), "unit_number").alias("label")).distinct()
    return units.select("label", L.short_label(F.col("label")).alias("short"))


def trace_values(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as a trace shows them, as a link title, and as a recap with their subject."""
    d = table(spark, folder, "documents").where("text is not null")
    pieces = F.array(F.coalesce("subject", F.lit("")), F.col("text"))
    return d.select("doc_id", F.md5(L.mask(F.col("text"), 300)).alias("masked"), F.md5(L.link_title(F.col("text"))).alias("link_title"), F.md5(L.recap(pieces)).alias("recap"))


def error_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of a provider: whether the quota is spent, and the seconds to wait."""
    rows = [(1, "429 RESOURCE_EXHAUSTED retryDelay': '31.5s'"), (2, "you exceeded your current quota, retry in 0.2s"), (3, "connection reset"), (4, None)]
    errors = spark.createDataFrame(rows, "id int, message string")
    return errors.select("id", L.is_quota_error(F.col("message")).alias("quota"), T.retry_seconds(F.col("message")).alias("seconds"))


def criterion_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with their intents as criterion keys."""
    log = table(spark, folder, "query_log").select("question", "intent").distinct()
    return log.select("question", "intent", L.criterion_text(F.col("question"), F.col("intent")).alias("key"))


def vector_literals(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").where("embedding is not null")
    return v.select("vec_id", L.vector_literal(F.col("embedding")).alias("literal"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of a public vocabulary, and the estimate from characters, of each document."""
    d = table(spark, folder, "documents")
    return d.select("doc_id", L.token_counter(f"{TOKENIZERS}/byte_bpe_50k.json")(F.col("text")).alias("tokens"), T.estimate_tokens(F.col("text")).alias("estimate"))


_W = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"


def _flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_W}', ' ', 'g'))"


_CUT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE rtrim({0}[1:{1} - 3]) || '...' END"
SQL = {
    "heading_titles": rf"""WITH h AS (SELECT DISTINCT heading FROM (SELECT heading FROM structural_unit UNION ALL SELECT split_part(text, chr(10), 1) FROM documents) WHERE heading IS NOT NULL),
t AS (SELECT heading, {_flat("translate(heading, chr(146) || chr(132) || chr(147) || chr(148), ' ')")} AS title, lower({_flat("heading")}) AS folded FROM h),
n AS (SELECT *, nullif(regexp_extract(title, '(?s)^(\d+(?:\.\d+)*)\.?\s+(\S.*)$', 1), '') AS number FROM t)
SELECT heading, title, number, CASE WHEN number IS NULL THEN title ELSE rtrim(regexp_extract(title, '(?s)^(\d+(?:\.\d+)*)\.?\s+(\S.*)$', 2)) END AS rest,
  array_to_string(list_transform(string_split(number, '.'), lambda x: lpad(CAST(try_cast(x AS INTEGER) AS VARCHAR), 5, '0')), '.') AS sort_key, folded FROM n""",
    "version_labels": """SELECT DISTINCT document_version_id, CASE WHEN doc_date IS NULL THEN celex WHEN coalesce(celex, '') LIKE '0%' THEN 'consolidated ' || doc_date ELSE 'as adopted ' || doc_date END AS label,
CASE WHEN status = 'active' THEN 'published ' ELSE 'draft ' END || coalesce(CAST(doc_date AS VARCHAR), '') AS publication FROM document_version""",
    "file_names": "SELECT source_id, lpad(CAST(source_id AS VARCHAR), 2, '0') || '_' || replace(title, ' ', '_') || '.pdf' AS name, 'ec-' || lower(replace(replace(title, ' ', '_'), '_', '-')) AS key, replace(title, '_', ' ') AS title FROM legal_source",
    "unit_links": """WITH u AS (SELECT DISTINCT ON (unit_id) * FROM structural_unit ORDER BY unit_id)
SELECT unit_id, CASE WHEN celex_base IS NULL THEN 'https://library.example/' || source_key ELSE 'https://register.example/text?uri=CELEX%3A' || url_encode(celex) || coalesce('#' || CASE unit_type WHEN 'paragraph' THEN 'art_' || nullif(regexp_extract(unit_path, '(?:^|/)ART_([^/]+)', 1), '') WHEN 'article' THEN 'art_' || nullif(unit_number, '')
WHEN 'annex' THEN 'anx_' || nullif(unit_number, '') WHEN 'recital' THEN 'rct_' || nullif(unit_number, '') WHEN 'chapter' THEN 'cpt_' || nullif(unit_number, '') END, '') END AS link
FROM u JOIN (SELECT DISTINCT document_version_id, source_id, celex FROM document_version) USING (document_version_id) JOIN legal_source USING (source_id)""",
    "short_labels": """WITH l AS (SELECT DISTINCT upper(unit_type[1]) || unit_type[2:] || ' ' || unit_number AS label FROM structural_unit WHERE unit_number IS NOT NULL)
SELECT label, CASE WHEN label LIKE 'Article %' THEN 'Art. ' || label[9:] WHEN label LIKE 'Recital %' THEN 'Rec. ' || label[9:] WHEN label LIKE 'Paragraph %' THEN 'Para. ' || label[11:] ELSE label END AS short FROM l""",
    "trace_values": rf"""WITH f AS (SELECT doc_id, text, {_flat("text")} AS flat, {_flat("CASE WHEN trim(coalesce(subject, '')) <> '' THEN subject || ' ' ELSE '' END || CASE WHEN trim(text, ' ') <> '' THEN text ELSE '' END")} AS whole FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text ELSE text[1:300] || '... [' || format('{{:,}}', length(text)) || ' chars]' END) AS masked,
md5(replace(replace({_CUT.format('flat', 300)}, '\', '\\'), '"', '\"')) AS link_title, md5({_CUT.format('whole', 700)}) AS recap FROM f""",
    "error_messages": "SELECT * FROM (VALUES (1, true, 31.5::DOUBLE), (2, true, 1.0::DOUBLE), (3, false, 20.0::DOUBLE), (4, false, 20.0::DOUBLE)) t(id, quota, seconds)",
    "criterion_texts": "SELECT DISTINCT question, intent, trim(coalesce(question, '') || ' - ' || coalesce(intent, ''), ' -') AS key FROM query_log",
    "vector_literals": "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: format('{:.7g}', x::DOUBLE)), ',') || ']' AS literal FROM embeddings WHERE embedding IS NOT NULL",
}
QUERIES = {f.__name__: f for f in (heading_titles, version_labels, file_names, unit_links, short_labels, trace_values, error_messages, criterion_texts, vector_literals, token_counts)}

"""Queries for the document library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.models import embedder
from vellum.operators import library as L
from vellum.operators import monitor as M
from vellum.plans.monitor import _ONE as ONE
from vellum.sources.tables import table


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "document_version").dropDuplicates(["document_version_id"])


def _works(spark: SparkSession, folder: str) -> DataFrame:
    return _versions(spark, folder).where("celex is not null").select("celex", "doc_date", L.register_id(F.concat(F.lit("https://register.example/cellar/"), F.coalesce("cellar_id", F.lit("none")), F.lit("/"))).alias("work"))


def _based(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with the number of their consolidated act; the register writes the base as this one with a leading 3."""
    based = table(spark, folder, "legal_source").where("celex_base is not null and celex_base <> ''")
    return based.select("source_id", "source_key", F.col("celex_base").alias("celex"), L.consolidated_prefix(F.concat(F.lit("3"), "celex_base")).alias("prefix"))


def base_works(spark: SparkSession, folder: str) -> DataFrame:
    return L.base_works(_based(spark, folder).select("source_id", "celex"), _works(spark, folder))


def consolidated_list(spark: SparkSession, folder: str) -> DataFrame:
    return L.consolidated_versions(_based(spark, folder).select("source_id", "prefix"), _works(spark, folder))


def resolved_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The version of each source that should be live; sources without number are local files."""
    sources = table(spark, folder, "legal_source").select("source_id", "source_key", F.when(F.coalesce("celex_base", F.lit("")) == "", F.concat("source_key", F.lit(".pdf"))).alias("local_file"), F.col("created_at").cast("date").alias("doc_date"), (F.col("source_id") % 5 > 0).alias("use_consolidated"))
    return L.targets(sources, base_works(spark, folder), consolidated_list(spark, folder))


def library_renditions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as two responses each: an address for a PDF that often gives a page, and one for the page."""
    d = table(spark, folder, "documents").where("text is not null")
    kinds = F.explode(F.array(F.lit("pdf"), F.lit("html"))).alias("kind")
    rows = d.select(F.col("doc_id").alias("name"), kinds, "text", "doc_id")
    body = F.encode(F.when((F.col("kind") == "pdf") & (F.col("doc_id") % 3 == 0), F.concat(F.lit("%PDF-1.7 "), "text")).otherwise(F.concat(F.lit("<html>"), "text")), "utf-8")
    responses = rows.select("name", "kind", F.concat(F.lit("https://library.example/"), "kind", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("doc_id") % 7 == 0, 404).otherwise(200).alias("status"), body.alias("content"))
    return L.renditions(responses)


def version_reset(spark: SparkSession, folder: str) -> DataFrame:
    """Versions after each source's newest number is ingested again, and a new one of each; with their units."""
    versions = _versions(spark, folder).select("document_version_id", "source_id", "celex", "version_label", "content_sha256", "status")
    newest = versions.where("celex is not null").groupBy("source_id").agg(F.max("celex").alias("celex"))
    incoming = newest.unionByName(newest.withColumn("celex", F.concat("celex", F.lit("-new")))).select("source_id", "celex", F.lit("again").alias("version_label"), F.md5("celex").alias("content_sha256"))
    units = table(spark, folder, "structural_unit").select("unit_id", "document_version_id").distinct()
    after, kept = L.create_versions(versions, units, incoming)
    return after.join(kept.groupBy("document_version_id").agg(F.count("*").alias("units")), "document_version_id", "left").select("document_version_id", "celex", "status", F.coalesce("units", F.lit(0)).alias("units"))


def failed_versions(spark: SparkSession, folder: str) -> DataFrame:
    versions = _versions(spark, folder).select("document_version_id", "status")
    failures = versions.where("status = 'ingesting'").select("document_version_id", F.repeat(F.concat(F.lit("fault "), F.col("document_version_id").cast("string"), F.lit("; ")), 1_000).alias("error"))
    return L.mark_failed(versions, failures).select("document_version_id", "status", F.length("error").alias("n"))


def source_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's active hash against that of its newest version; sources without any are errors."""
    versions = _versions(spark, folder)
    active = versions.where("status = 'active'").select("source_id", F.col("content_sha256").alias("mark"))
    found = versions.groupBy("source_id").agg(F.max(F.struct("document_version_id", "content_sha256")).alias("r")).select("source_id", F.col("r.content_sha256").alias("mark"), F.when(F.col("source_id") % 11 == 0, "timed out").alias("error"))
    return L.check_runs(table(spark, folder, "legal_source"), active, found)


def unit_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """What lies beside each paragraph's article."""
    units = table(spark, folder, "structural_unit").dropDuplicates(["unit_id"]).withColumn("parent_id", F.nullif("parent_id", F.lit(0)))
    found = L.unit_outlines(units.where("unit_type = 'paragraph'").select("unit_id"), units)
    return found.select("unit_id", "parent_id", "n", F.md5("outline").alias("outline"))


def contained_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of units that occur in documents."""
    headings = table(spark, folder, "structural_unit").where("heading is not null and trim(heading) <> ''").select(F.col("heading").alias("passage"))
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "text")
    return L.containing(headings, documents).select("passage", F.col("key").alias("doc_id"))


def embedded_units(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of units with vectors from a cache of the parsed ones, the others embedded once each."""
    parsed = table(spark, folder, "parsed_unit").where("text is not null").select("text").distinct()
    cache = parsed.select(F.sha2("text", 256).alias("sha"), embedder(16)(F.col("text")).alias("vector"))
    units = table(spark, folder, "structural_unit").select(F.col("unit_id").alias("key"), "text").dropDuplicates(["key"])
    rows, _ = L.embed_with_cache(units, cache, embedder(16))
    return rows.select(F.col("key").alias("unit_id"), "sha", "reused", (F.array_size("vector") == 16).alias("embedded"))


def call_waits(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds that each question's call would have waited for its model's minute."""
    log = M.one_per_question(table(spark, folder, "query_log")).where("model is not null and asked_at is not null")
    events = log.select(F.col("query_id").alias("event_id"), "model", F.unix_micros("asked_at").alias("at"), (F.coalesce("quotes_total", F.lit(0)) * 1_000).alias("tokens"))
    return L.waits(events, "model", 6_000, F.lit(2_000)).withColumn("wait", F.round("wait", 6))


_V = "v AS (SELECT DISTINCT ON (document_version_id) * FROM document_version ORDER BY document_version_id)"
_BASE = f"WITH {_V}, w AS (SELECT celex, doc_date, coalesce(cellar_id, 'none') AS work FROM v WHERE celex IS NOT NULL), s AS (SELECT * FROM legal_source WHERE coalesce(celex_base, '') <> ''), b AS (SELECT source_id, s.celex_base AS celex, max(struct_pack(d := doc_date, w := work)) FILTER (w.celex IS NOT NULL) AS r FROM s LEFT JOIN w ON w.celex = s.celex_base GROUP BY ALL), c AS (SELECT source_id, celex, doc_date, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(doc_date, DATE '0001-01-01') DESC, celex DESC) AS place FROM (SELECT DISTINCT s.source_id, w.celex, w.doc_date FROM s JOIN w ON split_part(w.celex, '-', 1) = '0' || s.celex_base))"
SQL = {
    "base_works": _BASE + " SELECT source_id, celex, r.d AS doc_date, r.w AS work FROM b",
    "consolidated_list": _BASE + " SELECT * FROM c",
    "resolved_targets": _BASE
    + """, t AS (SELECT s.source_id, CASE WHEN coalesce(celex_base, '') = '' THEN 'local' WHEN s.source_id % 5 > 0 THEN 'consolidated' ELSE 'base' END AS route, source_key, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day FROM legal_source s)
SELECT t.source_id, route, CASE route WHEN 'local' THEN source_key WHEN 'consolidated' THEN c.celex ELSE CASE WHEN b.r.w IS NOT NULL THEN b.celex END END AS celex, CASE route WHEN 'local' THEN day WHEN 'consolidated' THEN c.doc_date ELSE b.r.d END AS doc_date,
CASE WHEN route = 'consolidated' AND c.celex IS NULL OR route = 'base' AND b.r.w IS NULL THEN 'no version for route ' || route END AS error FROM t LEFT JOIN c ON c.source_id = t.source_id AND c.place = 1 LEFT JOIN b ON b.source_id = t.source_id""",
    "library_renditions": """SELECT doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'html' END AS format, CASE WHEN doc_id % 7 > 0 THEN 'https://library.example/' || format || '/' || doc_id END AS url,
CASE WHEN doc_id % 7 = 0 THEN NULL ELSE strlen(text) + CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 6 END END AS size, CASE WHEN doc_id % 7 > 0 THEN sha256(CASE WHEN doc_id % 3 = 0 THEN '%PDF-1.7 ' ELSE '<html>' END || text) END AS sha256, CASE WHEN doc_id % 7 = 0 THEN 'no usable source' END AS error FROM documents WHERE text IS NOT NULL""",
    "version_reset": f"""WITH {_V}, n AS (SELECT source_id, max(celex) AS celex FROM v WHERE celex IS NOT NULL GROUP BY 1), u AS (SELECT document_version_id, count(DISTINCT unit_id) AS units FROM structural_unit GROUP BY 1),
r AS (SELECT v.*, n.celex IS NOT NULL AS again FROM v LEFT JOIN n ON n.source_id = v.source_id AND n.celex = v.celex)
SELECT r.document_version_id, celex, CASE WHEN again THEN 'ingesting' ELSE status END AS status, CASE WHEN again THEN 0 ELSE coalesce(units, 0) END AS units FROM r LEFT JOIN u USING (document_version_id)
UNION ALL SELECT (SELECT max(document_version_id) FROM v) + row_number() OVER (ORDER BY source_id, celex), celex || '-new', 'ingesting', 0 FROM n""",
    "failed_versions": f"WITH {_V} SELECT document_version_id, CASE WHEN status = 'ingesting' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'ingesting' THEN least(4000, 1000 * length('fault ' || document_version_id || '; ')) END AS n FROM v",
    "source_checks": f"""WITH {_V}, a AS (SELECT source_id, content_sha256 AS am FROM v WHERE status = 'active'), f AS (SELECT source_id, arg_max_null(content_sha256, document_version_id) AS lm, CASE WHEN source_id % 11 = 0 THEN 'timed out' END AS e FROM v GROUP BY 1),
x AS (SELECT s.source_id, am, lm, coalesce(e, CASE WHEN lm IS NULL THEN 'nothing found' END) AS note FROM legal_source s LEFT JOIN a USING (source_id) LEFT JOIN f USING (source_id))
SELECT source_id, CASE WHEN note IS NOT NULL THEN 'error' WHEN am = lm THEN 'unchanged' ELSE 'new_version' END AS outcome, am AS active_mark, lm AS latest_mark, note FROM x""",
    "unit_outlines": r"""WITH u AS (SELECT DISTINCT ON (unit_id) * REPLACE (nullif(parent_id, 0) AS parent_id) FROM structural_unit ORDER BY unit_id),
h AS (SELECT * FROM u WHERE unit_type IN ('article', 'annex') OR regexp_matches(unit_number, '(^| )Commitment [0-9]+$')), p AS (SELECT * FROM u WHERE unit_type = 'paragraph'),
r AS (SELECT p.unit_id, length(h.unit_path) AS n, h.unit_id AS head, h.parent_id FROM p JOIN h ON h.document_version_id = p.document_version_id AND starts_with(p.unit_path, h.unit_path || '/') WHERE h.parent_id IS NOT NULL UNION ALL SELECT unit_id, length(unit_path), unit_id, parent_id FROM p WHERE parent_id IS NOT NULL),
g AS (SELECT unit_id, arg_min(parent_id, (n, head)) AS parent_id FROM r GROUP BY 1),
l AS (SELECT *, split_part(text, chr(10), 1) AS line FROM u),
o AS (SELECT parent_id, count(*) AS n, string_agg(coalesce(CASE WHEN coalesce(heading, '') = '' OR contains(line, heading) THEN line WHEN contains(line, ':') THEN split_part(line, ':', 1) || ': ' || heading ELSE line || ' ' || heading END, ''), chr(10) ORDER BY ordinal, unit_id) AS outline FROM l WHERE parent_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT unit_id, parent_id, n, md5(outline) AS outline FROM g JOIN o USING (parent_id)""",
    "contained_headings": "SELECT passage, doc_id FROM (SELECT DISTINCT heading AS passage FROM structural_unit WHERE trim(heading) <> '') JOIN documents ON contains(text, passage)",
    "embedded_units": "WITH c AS (SELECT DISTINCT text FROM parsed_unit WHERE text IS NOT NULL), u AS (SELECT DISTINCT ON (unit_id) unit_id, text FROM structural_unit ORDER BY unit_id) SELECT unit_id, sha256(u.text) AS sha, c.text IS NOT NULL AS reused, CASE WHEN u.text IS NOT NULL THEN true END AS embedded FROM u LEFT JOIN c ON c.text = u.text",
    "call_waits": ONE
    + """, e AS (SELECT query_id AS id, model, asked_at AS t0, coalesce(quotes_total, 0) * 1000 AS tokens FROM l WHERE model IS NOT NULL AND asked_at IS NOT NULL),
p AS (SELECT a.id, a.t0, b.t0 AS bt, b.id AS bid, b.tokens FROM e a JOIN e b ON a.model = b.model AND b.t0 >= a.t0 - INTERVAL 60 SECONDS AND b.t0 <= a.t0 AND (b.t0 < a.t0 OR b.id < a.id)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY id) AS used, sum(tokens) OVER (PARTITION BY id ORDER BY bt, bid) AS freed FROM p),
w AS (SELECT id, any_value(used) AS used, min(bt) FILTER (used - freed + 2000 <= 6000) AS until FROM c GROUP BY id)
SELECT e.id AS event_id, round(CASE WHEN coalesce(used, 0) + 2000 <= 6000 THEN 0.0::DOUBLE ELSE (epoch_us(until) + 60000000 - epoch_us(t0)) / 1000000 END, 6) AS wait FROM e LEFT JOIN w ON w.id = e.id""",
}
QUERIES = {
    f.__name__: f
    for f in (base_works, consolidated_list, resolved_targets, library_renditions, version_reset, failed_versions, source_checks, unit_outlines, contained_headings, embedded_units, call_waits)
}

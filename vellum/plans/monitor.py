"""Queries for monitoring, verification, evaluation, versions and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from vellum.functions.text import micros
from vellum.operators import evaluate as E
from vellum.operators import monitor as M
from vellum.operators import ranking as R
from vellum.operators import verify as V
from vellum.operators import versions as N
from vellum.session import shared_dir
from vellum.sources.tables import table
from vellum.streaming import monitor as S


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return M.one_per_question(table(spark, folder, "query_log"))


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "document_version").dropDuplicates(["document_version_id"])


def kpis(spark: SparkSession, folder: str) -> DataFrame:
    return M.kpis(_log(spark, folder))


def daily_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return M.daily(_log(spark, folder))


def daily_latency(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder).where("latency_ms > 0").withColumn("day", F.date_format("asked_at", "yyyy-MM-dd"))
    return M.rank_percentile(log, ["day"], "latency_ms", {"p50": (1, 2), "p95": (19, 20)})


def intent_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return M.by_intent(_log(spark, folder))


def model_pivot(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder).withColumn("model", F.coalesce("model", F.lit("none")))
    return log.groupBy("model").pivot("verdict", ["answered", "partial", "abstained"]).agg(F.count(F.lit(1))).na.fill(0)


def quota_share(spark: SparkSession, folder: str) -> DataFrame:
    used = _log(spark, folder).where("model is not null").groupBy("model").agg(F.sum(F.coalesce("quotes_total", F.lit(0))).alias("used"))
    return used.select("model", "used", F.round(F.least(F.lit(1.0), F.col("used") / F.lit(200_000)), 6).alias("share"))


def step_means(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.groupBy("event_type").agg(F.floor(F.avg("value")).alias("mean"), F.count("*").alias("n"))


def token_totals(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return events.groupBy("user_id").agg(F.sum("k").alias("tokens"))


def recent_25(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("query_id", "asked_at", "verdict").orderBy(F.desc("asked_at"), F.desc("query_id")).limit(25)


def sliding_window_load(spark: SparkSession, folder: str) -> DataFrame:
    return M.window_load(_log(spark, folder))


def conversation_last_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The last three steps of each thread by instant, then id; steps without a readable time come last."""
    steps = table(spark, folder, "chat_steps").groupBy("thread_id", "step_id").agg(F.max(micros(F.col("created_at"))).alias("at"))
    return R.top(steps, ["thread_id"], [F.desc_nulls_last("at"), F.desc("step_id")], 3).select("thread_id", "step_id", "place")


def verify_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Stored normalized texts as quotes of their units."""
    units = table(spark, folder, "structural_unit").dropDuplicates(["unit_id"])
    quotes = table(spark, folder, "normalized_text").select(F.col("unit_id").alias("quote_id"), "unit_id", F.col("text_normalized").alias("quote")).distinct()
    return V.verify_quotes(quotes, units.select("unit_id", "text"))


def claim_coverage(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    covered = V.coverage(F.col("quotes_total") - F.col("quotes_dropped"), F.col("quotes_total"))
    return log.select("query_id", F.round(covered, 6).alias("coverage"), V.verdict(covered, F.col("quotes_total")).alias("derived"))


def claim_basis(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest tier among each question's hits."""
    hits = table(spark, folder, "candidate").select("query_id", F.lower(F.trim("authority")).alias("authority"))
    best = hits.groupBy("query_id").agg(F.min(R.tier(F.col("authority"))).alias("t"))
    return best.select("query_id", F.element_at(F.array(*map(F.lit, (*R.TIERS, "law"))), F.col("t") + 1).alias("basis"))


def ir_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Hits ranked by score against the versions each question was answered from."""
    hits = table(spark, folder, "candidate").dropDuplicates(["candidate_id"]).withColumn("score", F.coalesce("score", F.lit(0.0)))
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")))
    expected = _log(spark, folder).select("query_id", F.array_distinct(F.coalesce("document_version_ids", F.array().cast("array<bigint>"))).alias("expected"))
    return E.ir_metrics(ranked.join(expected, "query_id").withColumnRenamed("document_version_id", "item"), "query_id")


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    m = ir_metrics(spark, folder)
    return m.agg(F.count("*").alias("cases"), *(F.round(F.avg(c), 5).alias(c) for c in ("p_at_1", "recall", "ndcg", "mrr", "pool_recall")))


def corpus_status(spark: SparkSession, folder: str) -> DataFrame:
    active = _versions(spark, folder).where("status = 'active'").select("source_id", "document_version_id", "version_label")
    counts = table(spark, folder, "structural_unit").groupBy("document_version_id").agg(F.count_distinct("unit_id").alias("units"))
    sources = table(spark, folder, "legal_source").select("source_id", "source_key")
    return sources.join(active, "source_id", "left").join(counts, "document_version_id", "left").select("source_key", "version_label", F.coalesce("units", F.lit(0)).alias("units"))


def latest_versions(spark: SparkSession, folder: str) -> DataFrame:
    found = N.consolidated(_versions(spark, folder), table(spark, folder, "legal_source"), replaced=0)  # this corpus puts the 0 before the base number
    return found.select("source_id", "celex", "document_version_id")


def version_activate(spark: SparkSession, folder: str) -> DataFrame:
    versions = _versions(spark, folder)
    newest = N.latest(versions.where("status in ('discovered', 'ingesting')").select("source_id", "document_version_id"), ["source_id"], ["document_version_id"])
    return N.activate(versions, newest)


def change_detect(spark: SparkSession, folder: str) -> DataFrame:
    versions = _versions(spark, folder).where("content_sha256 is not null").select("source_id", "document_version_id", "status", "content_sha256")
    active = versions.where("status = 'active'")
    seen = N.latest(versions.select("source_id", "document_version_id", "content_sha256"), ["source_id"], ["document_version_id"]).select("source_id", "content_sha256")
    return N.changes(active, seen, "source_id", "content_sha256")


def upsert_sources(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "legal_source").select("source_key", "title")
    return N.upsert(sources, sources.where("title like 'Code%'").withColumn("title", F.upper("title")), "source_key")


def link_parents(spark: SparkSession, folder: str) -> DataFrame:
    from vellum.operators.hierarchy import links_by_path

    links = links_by_path(table(spark, folder, "parsed_unit"), "parsed_unit", "parsed_id", "document_version_id", "parent_path", "unit_path")
    return links.where("parent is not null").select(F.col("node").alias("parsed_id"), F.col("parent").alias("parent_id"))


def _cache(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "parsed_unit").where("text is not null").select(F.sha2("text", 256).alias("sha"))


def embed_plan(spark: SparkSession, folder: str) -> DataFrame:
    return N.embed_plan(table(spark, folder, "structural_unit"), _cache(spark, folder))


def cache_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    return N.new_texts(table(spark, folder, "structural_unit"), _cache(spark, folder)).select("sha")


def dedupe_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    hit = table(spark, folder, "candidate").select(F.col("structural_unit_id").alias("unit_id"))
    law = table(spark, folder, "candidate").where("lower(trim(authority)) = 'law'").select(F.col("structural_unit_id").alias("unit_id"))
    units = table(spark, folder, "structural_unit").select("unit_id")
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "unit_id")
    return tag(units.exceptAll(units.dropDuplicates()).distinct(), "copied").unionByName(tag(units.subtract(hit), "never_hit")).unionByName(tag(hit.intersect(law), "law"))


def stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = S.daily_counts(S.event_stream(spark, folder))
    return S.run_to_table(counts, spark, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")


_ONE = "WITH l AS (SELECT * REPLACE (nullif(lower(trim(intent, ' ' || chr(9) || chr(10) || chr(13))), '') AS intent) FROM (SELECT DISTINCT ON (query_id) * FROM query_log ORDER BY query_id, logged_at DESC)), s AS (SELECT *, coalesce(intent, '') NOT IN ('greeting', 'out_of_scope') AS searched FROM l)"
_PCT = ", n AS (SELECT {g} AS g, latency_ms AS v, row_number() OVER (PARTITION BY {g} ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY {g}) AS n FROM {t} WHERE latency_ms > 0), p AS (SELECT g, max(v) FILTER (r = greatest(1, n // 2)) AS p50, max(v) FILTER (r = greatest(1, n * 19 // 20)) AS p95 FROM n GROUP BY g)"
_DAY = "strftime(asked_at AT TIME ZONE 'UTC', '%Y-%m-%d')"
_IR = """WITH l AS (SELECT DISTINCT ON (query_id) query_id, list_distinct(coalesce(document_version_ids, [])) AS expected FROM query_log ORDER BY query_id, logged_at DESC),
c AS (SELECT DISTINCT candidate_id, query_id, document_version_id AS item, coalesce(score, 0.0) AS score FROM candidate),
r AS (SELECT c.*, expected, list_contains(expected, item) AS hit, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS place FROM c JOIN l USING (query_id)),
g AS (SELECT query_id, any_value(len(expected)) AS n, max(CASE WHEN place = 1 AND hit THEN 1 ELSE 0 END) AS p_at_1, count(DISTINCT item) FILTER (hit AND place <= 4 AND score >= 0.005) AS kept,
  count(DISTINCT item) FILTER (hit) AS pooled, count(*) FILTER (hit) AS rel, coalesce(sum(1 / log2(place + 1)) FILTER (hit AND place <= 4), 0) AS dcg, min(place) FILTER (hit) AS first FROM r GROUP BY 1),
m AS (SELECT query_id, p_at_1, CASE WHEN n > 0 THEN round(kept / n, 6) ELSE 0 END AS recall,
  CASE WHEN rel > 0 THEN round(dcg / list_sum(list_transform(range(1, least(rel, 4) + 1), lambda i: 1 / log2(i + 1))), 6) ELSE 0 END AS ndcg,
  round(coalesce(1 / first, 0), 6) AS mrr, CASE WHEN n > 0 THEN round(pooled / n, 6) ELSE 0 END AS pool_recall FROM g)
"""
_V = "WITH v AS (SELECT DISTINCT ON (document_version_id) * FROM document_version ORDER BY document_version_id)"
SQL = {
    "kpis": _ONE
    + _PCT.format(g="1", t="s WHERE searched").replace("WHERE searched WHERE", "WHERE searched AND")
    + """ SELECT questions, small_talk, answer_rate, partial_rate, quote_accuracy, coverage, p50, p95 FROM (SELECT count(*) AS questions, count(*) FILTER (NOT searched) AS small_talk,
round(count(*) FILTER (searched AND verdict IN ('answered', 'partial')) / count(*) FILTER (searched), 6) AS answer_rate, round(count(*) FILTER (searched AND verdict = 'partial') / count(*) FILTER (searched), 6) AS partial_rate,
round((sum(coalesce(quotes_total, 0)) - sum(coalesce(quotes_dropped, 0))) / sum(coalesce(quotes_total, 0)), 6) AS quote_accuracy, round(avg(citation_coverage) FILTER (searched AND verdict IN ('answered', 'partial')), 6) AS coverage FROM s), p""",
    "daily_verdicts": _ONE
    + f" SELECT {_DAY} AS day, count(*) AS questions, count(*) FILTER (verdict = 'answered') AS answered, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'abstained') AS abstained, CAST(sum(coalesce(quotes_total, 0)) AS BIGINT) AS quotes, round(avg(citation_coverage), 6) AS coverage FROM l GROUP BY 1",
    "daily_latency": _ONE + _PCT.format(g=_DAY, t="l") + " SELECT g AS day, p50, p95 FROM p",
    "intent_breakdown": _ONE
    + _PCT.format(g="coalesce(intent, 'unknown')", t="l")
    + " SELECT intent, questions, answered, partial, abstained, p50 AS median FROM (SELECT coalesce(intent, 'unknown') AS intent, count(*) AS questions, count(*) FILTER (verdict = 'answered') AS answered, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'abstained') AS abstained FROM l GROUP BY 1) LEFT JOIN p ON g = intent",
    "model_pivot": _ONE + " SELECT coalesce(model, 'none') AS model, count(*) FILTER (verdict = 'answered') AS answered, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'abstained') AS abstained FROM l GROUP BY 1",
    "quota_share": _ONE + " SELECT model, CAST(sum(coalesce(quotes_total, 0)) AS BIGINT) AS used, round(least(1.0::DOUBLE, sum(coalesce(quotes_total, 0)) / 200000), 6) AS share FROM l WHERE model IS NOT NULL GROUP BY 1",
    "step_means": "SELECT event_type, CAST(floor(avg(value)) AS BIGINT) AS mean, count(*) AS n FROM events GROUP BY 1",
    "token_totals": "SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1",
    "recent_25": _ONE + " SELECT query_id, asked_at, verdict FROM l ORDER BY asked_at DESC, query_id DESC LIMIT 25",
    "sliding_window_load": _ONE
    + " SELECT query_id, model, count(*) OVER w AS requests, CAST(sum(coalesce(quotes_total, 0)) OVER w AS BIGINT) AS quotes FROM l WHERE model IS NOT NULL WINDOW w AS (PARTITION BY model ORDER BY asked_at RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)",
    "conversation_last_turns": r"""WITH s AS (SELECT thread_id, step_id, trim(created_at) AS c FROM chat_steps), t AS (SELECT thread_id, step_id, try_cast(CASE WHEN regexp_matches(c, '([zZ]|[+-]\d{2}(:?\d{2})?)$') AND regexp_matches(c, '\d:\d') THEN c ELSE c || 'Z' END AS TIMESTAMPTZ) AS t FROM s)
SELECT thread_id, step_id, row_number() OVER (PARTITION BY thread_id ORDER BY max(t) DESC NULLS LAST, step_id DESC) AS place FROM t GROUP BY thread_id, step_id QUALIFY place <= 3""",
    "claim_coverage": _ONE
    + """, c AS (SELECT query_id, quotes_total AS t, CASE WHEN coalesce(quotes_total, 0) = 0 THEN 0 ELSE (quotes_total - quotes_dropped) / quotes_total END AS c FROM l)
SELECT query_id, round(c, 6) AS coverage, CASE WHEN coalesce(t, 0) = 0 THEN 'abstained' WHEN c >= 0.8::DOUBLE THEN 'answered' WHEN c >= 0.4::DOUBLE THEN 'partial' ELSE 'abstained' END AS derived FROM c""",
    "claim_basis": "SELECT query_id, CASE min(CASE lower(trim(authority)) WHEN 'law' THEN 0 WHEN 'guidance' THEN 1 WHEN 'code' THEN 2 ELSE 3 END) WHEN 1 THEN 'guidance' WHEN 2 THEN 'code' ELSE 'law' END AS basis FROM candidate GROUP BY 1",
    "ir_metrics": _IR + "SELECT * FROM m",
    "eval_summary": _IR + "SELECT count(*) AS cases, round(avg(p_at_1), 5) AS p_at_1, round(avg(recall), 5) AS recall, round(avg(ndcg), 5) AS ndcg, round(avg(mrr), 5) AS mrr, round(avg(pool_recall), 5) AS pool_recall FROM m",
    "corpus_status": _V
    + " SELECT source_key, version_label, coalesce(units, 0) AS units FROM legal_source s LEFT JOIN (SELECT * FROM v WHERE status = 'active') a USING (source_id) LEFT JOIN (SELECT document_version_id, count(DISTINCT unit_id) AS units FROM structural_unit GROUP BY 1) c USING (document_version_id)",
    "latest_versions": _V + " SELECT DISTINCT ON (source_id) source_id, celex, document_version_id FROM v JOIN legal_source s USING (source_id) WHERE starts_with(celex, '0' || celex_base) ORDER BY source_id, coalesce(doc_date, DATE '0001-01-01') DESC, celex DESC, document_version_id DESC",
    "version_activate": _V
    + """, n AS (SELECT source_id, max(document_version_id) AS new_id FROM v WHERE status IN ('discovered', 'ingesting') GROUP BY 1)
SELECT document_version_id, source_id, CASE WHEN document_version_id = new_id THEN 'active' WHEN new_id IS NOT NULL AND status = 'active' THEN 'superseded' ELSE status END AS status,
CASE WHEN document_version_id = new_id THEN NULL WHEN new_id IS NOT NULL AND status = 'active' THEN new_id ELSE superseded_by END AS superseded_by FROM v LEFT JOIN n USING (source_id)""",
    "change_detect": _V
    + """, a AS (SELECT source_id, any_value(content_sha256) AS old FROM v WHERE status = 'active' AND content_sha256 IS NOT NULL GROUP BY 1), s AS (SELECT source_id, arg_max(content_sha256, document_version_id) AS new FROM v WHERE content_sha256 IS NOT NULL GROUP BY 1)
SELECT source_id, CASE WHEN old = new THEN 'unchanged' ELSE 'new_version' END AS outcome FROM s LEFT JOIN a USING (source_id)""",
    "upsert_sources": "SELECT source_key, CASE WHEN title LIKE 'Code%' THEN upper(title) ELSE title END AS title FROM legal_source",
    "embed_plan": "WITH c AS (SELECT DISTINCT text FROM parsed_unit WHERE text IS NOT NULL) SELECT count(*) AS total, count(*) FILTER (text IN (FROM c)) AS cached, count(DISTINCT text) FILTER (text NOT IN (FROM c)) AS to_embed FROM structural_unit WHERE text IS NOT NULL",
    "cache_anti_join": "SELECT DISTINCT sha256(text) AS sha FROM structural_unit WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM parsed_unit WHERE text IS NOT NULL)",
    "dedupe_by_hash": "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "set_operations": """SELECT 'copied' AS op, unit_id FROM structural_unit GROUP BY unit_id HAVING count(*) > 1
UNION ALL (SELECT 'never_hit', unit_id FROM structural_unit EXCEPT SELECT 'never_hit', structural_unit_id FROM candidate) UNION ALL SELECT DISTINCT 'law', structural_unit_id FROM candidate WHERE lower(trim(authority)) = 'law'""",
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
QUERIES = {
    f.__name__: f
    for f in (
        kpis, daily_verdicts, daily_latency, intent_breakdown, model_pivot, quota_share, step_means, token_totals, recent_25, sliding_window_load, conversation_last_turns, verify_quotes,
        claim_coverage, claim_basis, ir_metrics, eval_summary, corpus_status, latest_versions, version_activate, change_detect, upsert_sources, link_parents, embed_plan, cache_anti_join,
        dedupe_by_hash, set_operations, stream_daily_counts,
    )
}

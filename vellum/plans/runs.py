"""Queries over run records and evaluations. The log has no run records: they are made from its columns, in the SQL too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import evaluate as E
from vellum.operators import monitor as M
from vellum.operators import runs as N
from vellum.plans.monitor import _ONE as ONE
from vellum.sources.tables import table

MODELS = ["quillon-70b", "quillon-8b", "tessel-mini"]
LIMIT = 200_000


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """One row per question with its run record."""
    log = M.one_per_question(table(spark, folder, "query_log"))
    ms = F.greatest(F.coalesce("latency_ms", F.lit(0)), F.lit(0))
    rounds = F.coalesce(F.array_size("document_version_ids"), F.lit(0)) % 3
    cost = F.struct(F.length(F.coalesce("question", F.lit(""))).cast("bigint").alias("input"), (F.coalesce("quotes_total", F.lit(0)) * 10).cast("bigint").alias("output"), F.lit(1).alias("calls"))
    spent = F.when(F.col("model").isNotNull(), F.create_map("model", cost)).otherwise(F.create_map().cast("map<string,struct<input:bigint,output:bigint,calls:int>>"))
    step = lambda name, n: F.struct(F.lit(name).alias("node"), (ms % n).alias("ms"))
    run = F.struct(rounds.alias("rounds"), (ms % 1_000).alias("waited_ms"), spent.alias("tokens"), F.array(step("plan", 83), step("embed_query", 7), step("rerank_evidence", 89), step("verify", 97)).alias("steps"))
    return log.withColumn("run", F.when(F.col("prompt_version").isNotNull(), run)).withColumn("quotes_repaired", F.coalesce("quotes_dropped", F.lit(0)) > 2)


def _text(column: str) -> F.Column:
    """A map as text, in the order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")


def dashboard_kpis(spark: SparkSession, folder: str) -> DataFrame:
    """All key figures of the last 30 days of the log."""
    log = _log(spark, folder)
    last = table(spark, folder, "query_log").agg(F.max("asked_at").alias("now")).first()["now"]
    period = N.since(log, 30, F.lit(last))
    return M.kpis(period).drop("partial_rate").join(N.run_kpis(period), F.lit(True))  # single rows


def model_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per model on the last day of the log."""
    last = table(spark, folder, "query_log").agg(F.max(F.to_date("asked_at")).alias("day")).first()["day"]
    return N.quotas(_log(spark, folder), F.lit(last), LIMIT)


def daily_series(spark: SparkSession, folder: str) -> DataFrame:
    return N.daily_series(_log(spark, folder))


def daily_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return N.daily_tokens(_log(spark, folder), MODELS)


def run_step_means(spark: SparkSession, folder: str) -> DataFrame:
    return N.step_means(_log(spark, folder))


def intent_runs(spark: SparkSession, folder: str) -> DataFrame:
    return N.intents(_log(spark, folder)).withColumn("verdicts", _text("verdicts"))


def recent_runs(spark: SparkSession, folder: str) -> DataFrame:
    return N.recent(_log(spark, folder))


def thread_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of each saved thread by what they do, as a run record counts them."""
    kinds = F.lower(F.regexp_replace(F.coalesce("step_type", F.lit("")), r"\P{L}", ""))
    node = F.when(kinds == "usermessage", "plan").when(kinds == "tool", "rerank_evidence").when(kinds == "run", "repair").otherwise(kinds)
    steps = table(spark, folder, "chat_steps").select("thread_id", "step_id", node.alias("node")).groupBy("thread_id", "step_id").agg(F.min("node").alias("node"))
    return N.run_records(steps, "thread_id", "node").withColumn("nodes", _text("nodes"))


def eval_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The ten latest evaluation runs: here the days of the log by prompt version."""
    log = _log(spark, folder).where("prompt_version is not null")
    runs = log.groupBy(F.date_format("asked_at", "yyyy-MM-dd").alias("ran_at"), "prompt_version").agg(F.count("*").alias("cases"), F.round(F.avg((F.col("verdict") == "answered").cast("double")), 6).alias("answered"))
    return runs.orderBy(F.desc("ran_at"), F.desc("prompt_version")).limit(10)


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Questions as scored cases."""
    log = _log(spark, folder)
    total, dropped = F.coalesce("quotes_total", F.lit(0)), F.coalesce("quotes_dropped", F.lit(0))
    refuse = ~M.searched()
    bases = F.map_filter(F.create_map(F.lit("law"), total - dropped, F.lit("code"), dropped), lambda _, n: n > 0)
    return log.select(
        F.col("query_id").alias("id"), F.coalesce("intent", F.lit("unknown")).alias("category"), F.when(F.coalesce("latency_ms", F.lit(0)) < 0, "clock went backwards").alias("error"),
        F.coalesce("verdict", F.lit("abstained")).alias("verdict"), refuse.alias("should_abstain"), (F.coalesce("intent", F.lit("")) == "applicability").alias("expect_criteria"), (total > 2).alias("produced_criteria"),
        (dropped > 3).alias("leaked"), F.when(~refuse, F.col("citation_coverage")).alias("recall"), F.coalesce("citation_coverage", F.lit(0.0)).alias("coverage"), total.alias("quotes_total"), dropped.alias("quotes_dropped"),
        N.tokens("input").alias("tokens"), F.coalesce("run.waited_ms", F.lit(0)).alias("waited_ms"), F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"), bases.alias("bases"),
    )


def case_summary(spark: SparkSession, folder: str) -> DataFrame:
    return N.summary(_results(spark, folder))


def flagged_cases(spark: SparkSession, folder: str) -> DataFrame:
    return N.flagged(_results(spark, folder))


def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(spark, folder).withColumn("right", (F.col("verdict") == "abstained") == F.col("should_abstain")).withColumn("id", F.col("id").cast("string"))
    return N.report_lines(results)


def reranker_report(spark: SparkSession, folder: str) -> DataFrame:
    """Legs as rerankers of each question's pool, against the dense one."""
    hits = table(spark, folder, "candidate").dropDuplicates(["candidate_id"]).select("candidate_id", "query_id", "document_version_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("leg").alias("reranker"), F.col("chunk_id").alias("id"), (F.col("chunk_id") % 5 == 0).alias("is_recital"))
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("reranker", "query_id").orderBy(F.desc("score"), "candidate_id")))
    log = _log(spark, folder)
    expected = log.select("query_id", F.array_distinct(F.coalesce("document_version_ids", F.array().cast("array<bigint>"))).alias("expected"), (~M.searched()).alias("should_abstain"), F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"))
    pools = ranked.join(expected.select("query_id", "expected"), "query_id").withColumn("case", F.struct("reranker", "query_id")).withColumnRenamed("document_version_id", "item")
    metrics = E.ir_metrics(pools.select("case", "place", "item", "score", "expected"), "case").select("case.*", "p_at_1", "recall", "ndcg", "mrr", "pool_recall")
    extras = N.case_extras(ranked, ["reranker", "query_id"])
    cases = metrics.join(extras, ["reranker", "query_id"]).join(expected.drop("expected"), "query_id").withColumnRenamed("query_id", "id")
    return N.reranker_report(cases, "dense", 0.005)


def unscored_pools(spark: SparkSession, folder: str) -> DataFrame:
    """Pools of more than two hits without a dense one."""
    hits = table(spark, folder, "candidate").dropDuplicates(["candidate_id"])
    return N.unscored(hits, hits.where("leg = 'dense'"), ["query_id"], 2)


def ingest_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Versions by state with their units: what is live, and what it holds."""
    versions = table(spark, folder, "document_version").dropDuplicates(["document_version_id"]).select("document_version_id", "status")
    counts = table(spark, folder, "structural_unit").groupBy("document_version_id").agg(F.count_distinct("unit_id").alias("n"))
    live = F.col("status") == "active"
    return versions.join(counts, "document_version_id", "left").agg(F.count_if(live).alias("live"), F.count("*").alias("versions"), F.coalesce(F.sum(F.when(live, F.coalesce("n", F.lit(0)))), F.lit(0)).alias("units"), F.count_if(F.col("status") == "failed").alias("failed"))


def check_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Each source with its latest retrieval as its last check."""
    checks = table(spark, folder, "document_version").where("retrieved_at is not null").groupBy("source_id").agg(F.max(F.struct("retrieved_at", "document_version_id", "status")).alias("c"))
    return table(spark, folder, "legal_source").select("source_id", "source_key").join(checks, "source_id", "left").select("source_key", F.col("c.retrieved_at").alias("checked_at"), F.col("c.status").alias("outcome"))


def ordered_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The versions behind each question's hits, each once, in the order of their best rank."""
    hits = table(spark, folder, "candidate").where("leg_rank is not null and document_version_id is not null").groupBy("query_id", "document_version_id").agg(F.min("leg_rank").alias("r"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "document_version_id"))), lambda x: x["document_version_id"].cast("string")), ",").alias("versions"))


def claims_by_basis(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of each question counted by authority, unknown ones as law."""
    authority = F.lower(F.trim("authority"))
    hits = table(spark, folder, "candidate").dropDuplicates(["candidate_id"]).select("query_id", F.when(authority.isin(*N.TIERS), authority).otherwise("law").alias("basis"))
    per = hits.groupBy("query_id", "basis").agg(F.count("*").alias("n"))
    return per.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("basis", "n")))).alias("bases")).withColumn("bases", _text("bases"))


_R = (
    ONE
    + """, r AS (SELECT *, prompt_version IS NOT NULL AS has, greatest(coalesce(latency_ms, 0), 0) AS ms, CASE WHEN has THEN len(coalesce(document_version_ids, [])) % 3 ELSE 0 END AS rounds, CASE WHEN has THEN ms % 1000 ELSE 0 END AS waited,
  CASE WHEN has AND model IS NOT NULL THEN length(coalesce(question, '')) ELSE 0 END AS tin, CASE WHEN has AND model IS NOT NULL THEN coalesce(quotes_total, 0) * 10 ELSE 0 END AS tout, coalesce(quotes_dropped, 0) > 2 AS repaired FROM s)"""
)
_DAY = "strftime(asked_at AT TIME ZONE 'UTC', '%Y-%m-%d')"
_RANK = "(list_sort(list({v}) FILTER ({w})))[greatest(1, (count(*) FILTER ({w})) * {p} // {q})]"


def _rank(value: str, where: str, p: int, q: int) -> str:
    return _RANK.format(v=value, w=where, p=p, q=q)


_CASES = (
    _R
    + """, c AS (SELECT query_id AS id, coalesce(intent, 'unknown') AS category, CASE WHEN coalesce(latency_ms, 0) < 0 THEN 'clock went backwards' END AS error, coalesce(verdict, 'abstained') AS verdict, NOT searched AS refuse, coalesce(intent, '') = 'applicability' AS expects,
  coalesce(quotes_total, 0) AS total, coalesce(quotes_dropped, 0) AS dropped, total > 2 AS produced, dropped > 3 AS leaked, CASE WHEN searched THEN citation_coverage END AS recall, coalesce(citation_coverage, 0) AS coverage, tin AS tokens, waited, coalesce(latency_ms, 0) AS lat FROM r),
k AS (SELECT *, error IS NULL AS ok, verdict = 'abstained' AS ab, total - dropped AS law, dropped AS code FROM c)"""
)
SQL = {
    "dashboard_kpis": ONE.replace("FROM query_log ORDER", "FROM query_log ORDER")
    + _R[len(ONE) :].replace("FROM s)", "FROM s WHERE asked_at >= (SELECT max(asked_at) FROM query_log) - INTERVAL 30 DAY)")
    + f""" SELECT count(*) AS questions, count(*) FILTER (NOT searched) AS small_talk, round(count(*) FILTER (searched AND verdict IN ('answered', 'partial')) / nullif(count(*) FILTER (searched), 0), 6) AS answer_rate,
round((sum(coalesce(quotes_total, 0)) - sum(coalesce(quotes_dropped, 0))) / nullif(sum(coalesce(quotes_total, 0)), 0), 6) AS quote_accuracy, round(avg(citation_coverage) FILTER (searched AND verdict IN ('answered', 'partial')), 6) AS coverage,
{_rank('latency_ms', 'searched AND latency_ms > 0', 1, 2)} AS p50, {_rank('latency_ms', 'searched AND latency_ms > 0', 19, 20)} AS p95, count(*) FILTER (searched AND verdict = 'partial') AS partial,
CAST(floor(avg(waited) FILTER (searched)) AS BIGINT) AS wait_mean, CAST(floor(avg(tin) FILTER (has)) AS BIGINT) AS tokens_in, CAST(floor(avg(tout) FILTER (has)) AS BIGINT) AS tokens_out,
round(count(*) FILTER (searched AND rounds > 1) / nullif(count(*) FILTER (searched AND rounds > 0), 0), 6) AS second_round, count(*) FILTER (repaired) AS repaired FROM r""",
    "model_quotas": _R
    + f" SELECT model, CAST(sum(tin + tout) AS BIGINT) AS used, round(least(1.0::DOUBLE, sum(tin + tout) / {LIMIT}), 6) AS share FROM r WHERE has AND model IS NOT NULL AND {_DAY} = (SELECT max({_DAY}) FROM query_log) GROUP BY 1",
    "daily_series": _R
    + f""" SELECT {_DAY} AS day, count(*) FILTER (verdict = 'answered') AS answered, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'abstained') AS abstained,
round((sum(coalesce(quotes_total, 0)) - sum(coalesce(quotes_dropped, 0))) / nullif(sum(coalesce(quotes_total, 0)), 0), 3) AS quote_accuracy, round(avg(citation_coverage), 3) AS coverage, round(avg(waited) / 1000, 1) AS waiting,
round({_rank('latency_ms', 'searched AND coalesce(latency_ms, 0) <> 0', 1, 2)} / 1000, 1) AS latency_p50, round({_rank('latency_ms', 'searched AND coalesce(latency_ms, 0) <> 0', 19, 20)} / 1000, 1) AS latency_p95 FROM r GROUP BY 1""",
    "daily_tokens": _R + f" SELECT {_DAY} AS day, " + ", ".join(f"""CAST(coalesce(sum({c}) FILTER (model = '{m}'), 0) AS BIGINT) AS "{m}_{k}\"""" for m in MODELS for k, c in (("input", "tin"), ("output", "tout"))) + " FROM r GROUP BY 1",
    "run_step_means": _R + " SELECT node, CAST(floor(avg(ms)) AS BIGINT) AS ms, count(*) AS runs FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS node, ms % {k} AS ms FROM r WHERE has" for n, k in (("plan", 83), ("embed_query", 7), ("rerank_evidence", 89), ("verify", 97))) + ") GROUP BY 1",
    "intent_runs": _R
    + """, i AS (SELECT *, coalesce(intent, 'unknown') AS i FROM r), v AS (SELECT i, string_agg(verdict || ':' || n, ',' ORDER BY verdict) AS verdicts FROM (SELECT i, verdict, count(*) AS n FROM i WHERE verdict IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT i AS intent, count(*) AS count, any_value(verdicts) AS verdicts, round(avg(rounds), 2) AS rounds, round(median(latency_ms) FILTER (latency_ms <> 0) / 1000, 1) AS latency FROM i JOIN v USING (i) GROUP BY 1""",
    "recent_runs": _R
    + """ SELECT query_id, asked_at, verdict, CASE WHEN has THEN rounds END AS rounds, (coalesce(quotes_total, 0) - coalesce(quotes_dropped, 0)) || '/' || coalesce(quotes_total, 0) AS quotes,
CASE WHEN has THEN format('{:,}', tin) || ' / ' || format('{:,}', tout) ELSE '' END AS tokens, coalesce(latency_ms, 0) / 1000 AS latency, CASE WHEN has THEN 'plan → search → verify' ELSE '' END AS path FROM r ORDER BY asked_at DESC, query_id DESC LIMIT 25""",
    "thread_runs": r"""WITH k AS (SELECT thread_id, step_id, lower(regexp_replace(coalesce(step_type, ''), '\P{L}', '', 'g')) AS k FROM chat_steps),
n AS (SELECT thread_id, step_id, min(CASE k WHEN 'usermessage' THEN 'plan' WHEN 'tool' THEN 'rerank_evidence' WHEN 'run' THEN 'repair' ELSE k END) AS node FROM k GROUP BY ALL),
c AS (SELECT thread_id, node, count(*) AS n FROM n GROUP BY ALL)
SELECT thread_id, CAST(sum(n) AS BIGINT) AS steps, CAST(coalesce(sum(n) FILTER (node = 'plan'), 0) AS BIGINT) AS rounds, CAST(coalesce(sum(n) FILTER (node = 'rerank_evidence'), 0) AS BIGINT) AS searches, CAST(coalesce(sum(n) FILTER (node = 'repair'), 0) AS BIGINT) AS repaired,
CAST(coalesce(sum(n) FILTER (node = 'shorten'), 0) AS BIGINT) AS shortened, string_agg(node || ':' || n, ',' ORDER BY node) AS nodes FROM c GROUP BY 1""",
    "eval_runs": _R + f" SELECT {_DAY} AS ran_at, prompt_version, count(*) AS cases, round(avg(CASE WHEN verdict = 'answered' THEN 1.0::DOUBLE WHEN verdict IS NOT NULL THEN 0.0::DOUBLE END), 6) AS answered FROM r WHERE has GROUP BY ALL ORDER BY 1 DESC, 2 DESC LIMIT 10",
    "case_summary": _CASES
    + f""" SELECT count(*) AS cases, count(*) FILTER (NOT ok) AS errors, coalesce(round(avg(CAST(NOT ab AS INT)) FILTER (ok AND NOT refuse), 6), 0) AS answer_rate, coalesce(round(avg(CAST(ab = refuse AS INT)) FILTER (ok), 6), 0) AS abstention_accuracy,
(count(*) FILTER (ok AND refuse AND ab)) || '/' || (count(*) FILTER (ok AND refuse)) AS correct_refusals, count(*) FILTER (ok AND refuse AND NOT ab) AS false_answers, coalesce(round(avg(recall) FILTER (ok AND NOT refuse), 6), 0) AS citation_recall,
count(*) FILTER (ok AND NOT ab AND (law > 0 OR code > 0) AND law <= 0) AS without_law, CAST(sum(greatest(law, 0)) FILTER (ok) AS BIGINT) AS claims_law, 0 AS claims_guidance, CAST(sum(greatest(code, 0)) FILTER (ok) AS BIGINT) AS claims_code,
coalesce(round(avg(law / total) FILTER (ok AND total > 0), 6), 0) AS quote_accuracy, CAST(sum(total) FILTER (ok) AS BIGINT) AS quotes_total, CAST(sum(dropped) FILTER (ok) AS BIGINT) AS quotes_dropped, coalesce(round(avg(coverage) FILTER (ok AND NOT ab), 6), 0) AS mean_coverage,
(count(*) FILTER (ok AND expects AND produced)) || '/' || (count(*) FILTER (ok AND expects)) AS criteria_produced, count(*) FILTER (ok AND expects AND leaked) AS verdict_leaks, CAST(sum(tokens) FILTER (ok) AS BIGINT) AS tokens_spent, CAST(floor(avg(tokens) FILTER (ok)) AS BIGINT) AS tokens_per_case,
CAST(floor(sum(waited) FILTER (ok) / 1000) AS BIGINT) AS wait_s, CAST(floor(median(lat) FILTER (ok AND lat <> 0)) AS BIGINT) AS latency_p50, {_rank('lat', 'ok AND lat <> 0', 19, 20)} AS latency_p95 FROM k""",
    "flagged_cases": _CASES + " SELECT 'false_answer' AS flag, id FROM k WHERE ok AND refuse AND NOT ab UNION ALL SELECT 'without_law', id FROM k WHERE ok AND NOT ab AND law <= 0 AND code > 0 UNION ALL SELECT 'verdict_leak', id FROM k WHERE ok AND expects AND leaked",
    "report_lines": _CASES
    + """ SELECT CAST(id AS VARCHAR) AS id, CASE WHEN error IS NULL THEN concat_ws(' ', CASE WHEN ab = refuse THEN ' ' ELSE '!' END || rpad(CAST(id AS VARCHAR), greatest(31, length(CAST(id AS VARCHAR)))::INT, ' '), rpad(category, greatest(14, length(category))::INT, ' '), rpad(verdict, greatest(10, length(verdict))::INT, ' '),
lpad(coalesce(CAST(round(recall * 100) AS INT) || '%', '-'), 7, ' '), lpad((total - dropped) || '/' || total, 10, ' '), lpad(coalesce(nullif(concat_ws('/', CASE WHEN code > 0 THEN 'c' || code END, CASE WHEN law > 0 THEN 'l' || law END), ''), '-'), 14, ' '))
ELSE concat_ws(' ', rpad(CAST(id AS VARCHAR), greatest(32, length(CAST(id AS VARCHAR)))::INT, ' '), rpad(category, greatest(14, length(category))::INT, ' '), 'ERROR: ' || error[1:30]) END AS line FROM k""",
    "reranker_report": _R
    + f""", e AS (SELECT query_id, list_distinct(coalesce(document_version_ids, [])) AS expected, NOT searched AS refuse, coalesce(latency_ms, 0) AS lat FROM r),
h AS (SELECT DISTINCT candidate_id, query_id, document_version_id AS item, coalesce(score, 0.0) AS score, leg AS reranker, chunk_id, chunk_id % 5 = 0 AS rec FROM candidate),
p AS (SELECT h.*, expected, list_contains(expected, item) AS hit, row_number() OVER (PARTITION BY reranker, query_id ORDER BY score DESC, candidate_id) AS place FROM h JOIN e USING (query_id)),
g AS (SELECT reranker, query_id, any_value(len(expected)) AS n, max(CASE WHEN place = 1 AND hit THEN 1 ELSE 0 END) AS p_at_1, count(DISTINCT item) FILTER (hit AND place <= 4 AND score >= 0.005) AS kept, count(DISTINCT item) FILTER (hit) AS pooled, count(*) FILTER (hit) AS rel,
  coalesce(sum(1 / log2(place + 1)) FILTER (hit AND place <= 4), 0) AS dcg, min(place) FILTER (hit) AS first, max(score) AS best, count(*) FILTER (place <= 4 AND score >= 0.005 AND rec) AS recitals, list_sort(list_distinct(list(chunk_id) FILTER (place <= 4 AND score >= 0.005))) AS ids FROM p GROUP BY ALL),
m AS (SELECT g.*, refuse, lat, CASE WHEN n > 0 THEN round(kept / n, 6) ELSE 0 END AS recall, CASE WHEN rel > 0 THEN round(dcg / list_sum(list_transform(range(1, least(rel, 4) + 1), lambda i: 1 / log2(i + 1))), 6) ELSE 0 END AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr, CASE WHEN n > 0 THEN round(pooled / n, 6) ELSE 0 END AS pool_recall FROM g JOIN e USING (query_id)),
b AS (SELECT query_id, coalesce(ids, []) AS base FROM m WHERE reranker = 'dense')
SELECT reranker, count(*) AS scored, """
    + ", ".join(f"coalesce(round(avg({c}) FILTER (NOT refuse), 6), 0) AS {a}" for c, a in (("p_at_1", "p_at_1"), ("recall", "recall"), ("ndcg", "ndcg"), ("mrr", "mrr"), ("pool_recall", "pool_recall"), ("recitals", "recitals_kept")))
    + """, count(*) FILTER (NOT refuse AND recall = 0) AS missed, count(*) FILTER (NOT refuse AND best < 0.005) AS below_min, coalesce(min(best) FILTER (NOT refuse), 0) AS lowest_answerable, coalesce(max(best) FILTER (refuse), 0) AS highest_abstain,
CAST(floor(avg(lat)) AS BIGINT) AS latency_mean, count(*) FILTER (base IS NOT NULL AND coalesce(ids, []) <> base) AS differs, CAST(floor(median(lat)) AS BIGINT) AS latency_p50 FROM m LEFT JOIN b USING (query_id) WHERE reranker IS NOT NULL GROUP BY 1""",
    "unscored_pools": "SELECT query_id, count(DISTINCT candidate_id) AS n FROM candidate GROUP BY 1 HAVING count(DISTINCT candidate_id) > 2 AND count(*) FILTER (leg = 'dense') = 0",
    "ingest_summary": "WITH v AS (SELECT DISTINCT ON (document_version_id) * FROM document_version ORDER BY document_version_id), c AS (SELECT document_version_id, count(DISTINCT unit_id) AS n FROM structural_unit GROUP BY 1) SELECT count(*) FILTER (status = 'active') AS live, count(*) AS versions, CAST(coalesce(sum(n) FILTER (status = 'active'), 0) AS BIGINT) AS units, count(*) FILTER (status = 'failed') AS failed FROM v LEFT JOIN c USING (document_version_id)",
    "check_outcomes": "SELECT source_key, max(retrieved_at) AS checked_at, arg_max(status, (retrieved_at, document_version_id)) AS outcome FROM legal_source LEFT JOIN (SELECT * FROM document_version WHERE retrieved_at IS NOT NULL) USING (source_id) GROUP BY 1",
    "ordered_versions": "SELECT query_id, string_agg(document_version_id, ',' ORDER BY r, document_version_id) AS versions FROM (SELECT query_id, document_version_id, min(leg_rank) AS r FROM candidate WHERE leg_rank IS NOT NULL AND document_version_id IS NOT NULL GROUP BY ALL) GROUP BY 1",
    "claims_by_basis": "WITH b AS (SELECT query_id, CASE WHEN lower(trim(authority)) IN ('law', 'guidance', 'code') THEN lower(trim(authority)) ELSE 'law' END AS basis, count(DISTINCT candidate_id) AS n FROM candidate GROUP BY ALL) SELECT query_id, string_agg(basis || ':' || n, ',' ORDER BY basis) AS bases FROM b GROUP BY 1",
}
QUERIES = {
    f.__name__: f
    for f in (
        dashboard_kpis, model_quotas, daily_series, daily_tokens, run_step_means, intent_runs, recent_runs, thread_runs, eval_runs, case_summary, flagged_cases, report_lines, reranker_report, unscored_pools, ingest_summary,
        check_outcomes, ordered_versions, claims_by_basis,
    )
}

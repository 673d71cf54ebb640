"""Queries for fusion, ranking and packing over retrieval hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import estimate_tokens
from vellum.operators import ranking as R
from vellum.sources.tables import table

POOL = 20


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct candidates with clean authority."""
    c = table(spark, folder, "candidate").dropDuplicates(["candidate_id"])
    clean = F.lower(F.trim("authority"))
    return c.select("candidate_id", "query_id", "chunk_id", F.col("structural_unit_id").alias("unit_id"), F.when(clean.isin(*R.TIERS), clean).otherwise("other").alias("authority"), F.coalesce("score", F.lit(0.0)).alias("score"), "leg", "leg_rank")


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "structural_unit").dropDuplicates(["unit_id"])


def _pools(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best hits of each question."""
    return R.top(_hits(spark, folder), ["query_id"], [F.desc("score"), F.col("candidate_id")], POOL)


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    fused = R.fuse(table(spark, folder, "candidate"), ["query_id"], "chunk_id", {"structural": 2.0})
    return fused.withColumn("score", F.round("score", 9)).drop("ranks")


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    fused = R.fuse(table(spark, folder, "candidate"), ["query_id"], "chunk_id", {"structural": 2.0})
    return fused.where(F.col("place") <= POOL).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "place")


def rerank_topk(spark: SparkSession, folder: str) -> DataFrame:
    kept = R.keep_best(_hits(spark, folder), ["query_id"], "candidate_id")
    return kept.select("query_id", "candidate_id", "score", "place", "best_score")


def rerank_reserved_law(spark: SparkSession, folder: str) -> DataFrame:
    return R.keep_with_law(_pools(spark, folder), ["query_id"]).select("query_id", "candidate_id", "authority", "place", "promoted")


def authority_order(spark: SparkSession, folder: str) -> DataFrame:
    ordered = R.top(_pools(spark, folder).withColumnRenamed("place", "prior"), ["query_id"], [R.tier(F.col("authority")), F.col("prior")], POOL)
    return R.label(ordered).select("query_id", "candidate_id", "authority", "place", "label")


def token_budget_pack(spark: SparkSession, folder: str) -> DataFrame:
    costs = _units(spark, folder).select("unit_id", estimate_tokens(F.col("text")).alias("cost"))
    items = _pools(spark, folder).join(costs, "unit_id").select("query_id", "place", "candidate_id", "cost")
    return R.pack_budget(items, ["query_id"], "place", "cost")


def prompt_fit(spark: SparkSession, folder: str) -> DataFrame:
    costs = _units(spark, folder).select("unit_id", estimate_tokens(F.col("text")).cast("bigint").alias("cost"))
    items = _pools(spark, folder).join(costs, "unit_id").select("query_id", "place", "candidate_id", "cost")
    return R.fit_prompt(items, ["query_id"], "place", "cost", R.EVIDENCE_BUDGET)


def expand_to_parent(spark: SparkSession, folder: str) -> DataFrame:
    return R.expand_to_parents(_pools(spark, folder), _units(spark, folder), ["query_id"])


def evidence_merge(spark: SparkSession, folder: str) -> DataFrame:
    found = _pools(spark, folder).select("query_id", "unit_id", "place", "candidate_id", "score")
    return R.merge_evidence(found, ["query_id"], "unit_id", "place")


_HITS = """
WITH h AS (
  SELECT DISTINCT candidate_id, query_id, chunk_id, structural_unit_id AS unit_id,
         CASE WHEN lower(trim(authority)) IN ('law', 'guidance', 'code') THEN lower(trim(authority)) ELSE 'other' END AS authority,
         coalesce(score, 0.0) AS score, leg, leg_rank FROM candidate),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS place FROM h) WHERE place <= 20),
u AS (SELECT DISTINCT unit_id, parent_id, unit_type, CAST(trunc(length(coalesce(text, '')) / 3.6::DOUBLE) AS BIGINT) + 32 AS cost FROM structural_unit)
"""
_FUSED = (
    _HITS
    + """, legs AS (SELECT {by}, chunk_id, leg, min(leg_rank) AS leg_rank FROM h GROUP BY ALL),
f AS (SELECT {by}, chunk_id, sum(CASE WHEN leg = 'structural' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / (60 + leg_rank)) AS score,
        min(struct_pack(leg := leg, r := leg_rank)) AS first, count(*) AS legs FROM legs GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 12) DESC, first, chunk_id) AS place FROM f)
"""
)
_PACKED = (
    _HITS
    + """, i AS (SELECT p.query_id, p.place, p.candidate_id, u.cost FROM pool p JOIN u USING (unit_id)),
"""
)
SQL = {
    "rrf_fusion": _FUSED.format(by="query_id") + "SELECT query_id, chunk_id, round(score, 9) AS score, first.leg AS first_leg, first.r AS first_rank, legs, place FROM p",
    "hybrid_topk": _FUSED.format(by="query_id") + "SELECT query_id, chunk_id, round(score, 9) AS score, place FROM p WHERE place <= 20",
    "rerank_topk": _HITS
    + """, r AS (SELECT *, count(*) OVER w AS n, max(score) OVER w AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS r,
            row_number() OVER (PARTITION BY query_id ORDER BY candidate_id) AS o FROM h WINDOW w AS (PARTITION BY query_id))
SELECT query_id, candidate_id, score, CASE WHEN n <= 4 THEN o ELSE r END AS place, CASE WHEN n <= 4 THEN 0.005::DOUBLE ELSE best END AS best_score
FROM r WHERE n <= 4 OR r <= 4 AND score >= 0.005""",
    "rerank_reserved_law": _HITS
    + """, m AS (SELECT *, coalesce(bool_or(authority = 'law') FILTER (place <= 4) OVER w, false) AS has, min(place) FILTER (authority = 'law' AND place > 4) OVER w AS nxt
            FROM pool WINDOW w AS (PARTITION BY query_id))
SELECT query_id, candidate_id, authority, place, place > 4 AS promoted FROM m
WHERE CASE WHEN NOT has AND nxt IS NOT NULL THEN place <= 3 OR place = nxt ELSE place <= 4 END""",
    "authority_order": _HITS
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE authority WHEN 'law' THEN 0 WHEN 'guidance' THEN 1 WHEN 'code' THEN 2 ELSE 3 END, place) AS n FROM pool)
SELECT query_id, candidate_id, authority, n AS place, 'E' || n AS label FROM o""",
    "token_budget_pack": _PACKED
    + """n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS r FROM i),
g AS (
  WITH RECURSIVE w AS (
    SELECT query_id, place, candidate_id, cost, r, cost AS spent, true AS kept FROM n WHERE r = 1
    UNION ALL
    SELECT n.query_id, n.place, n.candidate_id, n.cost, n.r, CASE WHEN w.spent + n.cost > 2400 THEN w.spent ELSE w.spent + n.cost END, w.spent + n.cost <= 2400
    FROM w JOIN n ON n.query_id = w.query_id AND n.r = w.r + 1)
  SELECT * FROM w)
SELECT query_id, place, candidate_id, cost, spent FROM g WHERE kept""",
    "prompt_fit": _PACKED
    + """c AS (SELECT *, CAST(sum(cost) OVER w AS BIGINT) AS upto, row_number() OVER w AS r FROM i WINDOW w AS (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING))
SELECT query_id, place, candidate_id, cost, upto FROM c WHERE upto <= 2400 OR r = 1""",
    "expand_to_parent": _HITS
    + """, x AS (SELECT p.*, CASE WHEN u.unit_type = 'paragraph' AND q.unit_type = 'article' AND q.cost <= 1200 THEN q.unit_id ELSE p.unit_id END AS to_id
            FROM pool p LEFT JOIN u USING (unit_id) LEFT JOIN u q ON q.unit_id = u.parent_id)
SELECT query_id, to_id AS unit_id, max(score) AS score, count(DISTINCT chunk_id) AS hits, min(place) AS place FROM x GROUP BY ALL""",
    "evidence_merge": _HITS + "SELECT query_id, unit_id, min(place) AS place, arg_max(candidate_id, place) AS candidate_id, arg_max(score, place) AS score FROM pool GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (rrf_fusion, hybrid_topk, rerank_topk, rerank_reserved_law, authority_order, token_budget_pack, prompt_fit, expand_to_parent, evidence_merge)}

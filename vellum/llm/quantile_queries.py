"""Queries for percentiles of latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.quantiles import countable, day_runs, digest, select_ranks, week_start
from vellum.sources.tables import table

STATS = {"p50": (1, 2), "p95": (19, 20)}
#: Fixed values of the query: limits in ms, and the least size of a group.
LIMITS, LEAST = {"p50": 4_000, "p95": 20_000}, 60


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    runs = day_runs(countable(table(spark, folder, "query_log")))
    return select_ranks(runs.select(week_start(F.col("day")).alias("week_start"), "intent", "sign", "vals"), ["week_start", "intent"], STATS)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Weeks and intents whose median or 95th percentile is above its limit."""
    above = F.lit(False)
    for stat, limit in LIMITS.items():
        above = above | ((F.col("stat") == stat) & (F.col("value") > limit))
    return _ranks(spark, folder).where((F.col("n") >= LEAST) & above).select("week_start", "intent", "stat")


def p2_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles per week and intent."""
    return _ranks(spark, folder).select("week_start", "intent", "stat", "n", "value")


def p2_daily_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Mergeable counts per day and intent."""
    return digest(countable(table(spark, folder, "query_log")))


_ONCE = """
WITH once AS (
  SELECT query_id, arg_max(asked_at, logged_at) AS asked_at, arg_max(latency_ms, logged_at) AS v,
         coalesce(nullif(lower(trim(arg_max(coalesce(intent, ''), logged_at), ' ' || chr(9) || chr(10) || chr(13))), ''), 'unknown') AS intent
  FROM query_log WHERE latency_ms > 0 AND asked_at IS NOT NULL GROUP BY query_id)
"""
_RANKS = (
    _ONCE
    + """, o AS (
  SELECT strftime(date_trunc('week', asked_at AT TIME ZONE 'UTC'), '%Y-%m-%d') AS week_start, intent, v,
         row_number() OVER (PARTITION BY date_trunc('week', asked_at AT TIME ZONE 'UTC'), intent ORDER BY v) AS r,
         count(*) OVER (PARTITION BY date_trunc('week', asked_at AT TIME ZONE 'UTC'), intent) AS n FROM once),
s AS (SELECT week_start, intent, 'p50' AS stat, n, v AS value FROM o WHERE r = (n + 1) // 2
      UNION ALL SELECT week_start, intent, 'p95', n, v FROM o WHERE r = (n * 19 + 19) // 20)
"""
)
SQL = {
    "p2_found": _RANKS + "SELECT week_start, intent, stat FROM s WHERE n >= 60 AND (stat = 'p50' AND value > 4000 OR stat = 'p95' AND value > 20000)",
    "p2_quantiles": _RANKS + "SELECT * FROM s",
    "p2_daily_digest": _ONCE
    + """, b AS (SELECT date_diff('day', DATE '1970-01-01', CAST(asked_at AT TIME ZONE 'UTC' AS DATE)) AS day, intent, v, 1 << greatest(0, length(bin(v)) - 7) AS w FROM once)
SELECT day, intent, v // w * w AS bucket_low, w AS bucket_width, count(*) AS n FROM b GROUP BY ALL""",
}
QUERIES = {"p2_found": p2_found, "p2_quantiles": p2_quantiles, "p2_daily_digest": p2_daily_digest}

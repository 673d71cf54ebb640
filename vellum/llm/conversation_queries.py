"""Queries for rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.conversations import prepared, rebuild
from vellum.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Threads to drop, and why. A thread without steps is empty."""
    threads = table(spark, folder, "chat_threads").select("thread_id").where(F.col("thread_id").isNotNull()).distinct()
    rebuilt = rebuild(prepared(table(spark, folder, "chat_steps"))).withColumn("has_steps", F.lit(True))
    reason = F.when(F.col("has_steps").isNull(), "empty").otherwise(F.col("reason"))
    return threads.join(rebuilt, "thread_id", "left").select("thread_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def p4_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of kept threads in order, with roles."""
    threads = table(spark, folder, "chat_threads").select("thread_id").distinct()
    steps = rebuild(prepared(table(spark, folder, "chat_steps")), messages=True)
    kept = steps.where(F.col("reason").isNull() & F.col("role").isin("user", "assistant", "system")).join(threads, "thread_id", "left_semi")
    return kept.select("thread_id", "position", "depth", "channel", "role", "step_id", "parent_id", "text")


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """The likeliest parent of each step whose stated parent is missing and of each surplus root, with its score."""
    steps = rebuild(prepared(table(spark, folder, "chat_steps")), messages=True)
    return steps.where("inferred or surplus").select("thread_id", "step_id", F.col("likely").alias("parent_id"), "score")


def p4_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Per role: links of sound threads, and how many of them the score alone finds again, each hidden in turn."""
    steps = rebuild(prepared(table(spark, folder, "chat_steps")), messages=True, every=True)
    known = steps.where("parent_id is not null and (reason is null or reason <> 'broken')")
    return known.groupBy("role").agg(F.count("*").alias("links"), F.count_if(F.col("likely") == F.col("parent_id")).alias("found"))


SQL = {
    "p4_found": r"""
WITH RECURSIVE one AS (
  SELECT step_id, arg_min(struct_pack(t := thread_id, p := parent_id, y := step_type, x := output_text, e := coalesce(is_error, false)), is_streaming::INT) AS r
  FROM chat_steps GROUP BY step_id),
s AS (
  SELECT step_id, r.t AS thread_id, r.p AS parent_id, r.e AS is_error,
         regexp_replace(lower(r.y), '[^\p{L}]', '', 'g') AS kind,
         regexp_full_match(coalesce(r.x, ''), '[\p{Z}\p{Cc}\p{Cf}]*') AS blank FROM one),
up AS (
  SELECT thread_id, step_id, kind = 'usermessage' AND NOT blank AS ask, CASE WHEN kind = 'usermessage' AND NOT blank THEN step_id END AS question
  FROM s WHERE parent_id IS NULL
  UNION ALL
  SELECT s.thread_id, s.step_id, s.kind = 'usermessage' AND NOT s.blank, CASE WHEN s.kind = 'usermessage' AND NOT s.blank THEN s.step_id ELSE up.question END
  FROM up JOIN s ON s.parent_id = up.step_id AND s.thread_id = up.thread_id),
reached AS (SELECT thread_id, count(DISTINCT step_id) AS n FROM up GROUP BY 1),
answered AS (SELECT DISTINCT up.question FROM up JOIN s USING (step_id) WHERE s.kind = 'assistantmessage' AND NOT s.blank AND NOT s.is_error AND NOT up.ask),
t AS (
  SELECT thread_id, count(*) AS n, count(*) FILTER (parent_id IS NULL) AS starts, count(*) FILTER (kind = 'usermessage' AND NOT blank) AS asked,
         count(*) FILTER (kind = 'usermessage' AND NOT blank AND step_id NOT IN (SELECT question FROM answered WHERE question IS NOT NULL)) AS open
  FROM s GROUP BY 1)
SELECT * FROM (
  SELECT c.thread_id, CASE WHEN t.n IS NULL THEN 'empty' WHEN starts <> 1 OR t.n <> coalesce(reached.n, 0) THEN 'broken' WHEN asked = 0 THEN 'empty' WHEN open > 0 THEN 'no_reply' END AS reason
  FROM (SELECT DISTINCT thread_id FROM chat_threads) c LEFT JOIN t USING (thread_id) LEFT JOIN reached USING (thread_id)) WHERE reason IS NOT NULL
"""
}
QUERIES = {"p4_found": p4_found, "p4_conversations": p4_conversations, "p4_links": p4_links, "p4_recall": p4_recall}

"""Retrieval metrics per question, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ir_metrics(ranked: DataFrame, by: str, k: int = 4, min_score: float = 0.005) -> DataFrame:
    """Per question: precision at 1, recall at k, nDCG at k, reciprocal rank, recall of the whole pool.

    `ranked`: by, place (from 1), item, score, expected (array of items). Recall counts items at or
    above the threshold among the first k; the other metrics use the full ranking. Expected items
    that are empty give recall 0.
    """
    hit = F.array_contains("expected", F.col("item"))
    expected = F.size("expected")
    gain = F.lit(1.0) / F.log2(F.col("place") + F.lit(1.0))
    sums = ranked.groupBy(by).agg(
        F.max(F.when((F.col("place") == 1) & hit, 1).otherwise(0)).alias("p_at_1"),
        F.count_distinct(F.when(hit & (F.col("place") <= k) & (F.col("score") >= min_score), F.col("item"))).alias("kept"),
        F.count_distinct(F.when(hit, F.col("item"))).alias("pooled"),
        F.count_if(hit).alias("relevant"),
        F.sum(F.when(hit & (F.col("place") <= k), gain).otherwise(0.0)).alias("dcg"),
        F.min(F.when(hit, F.col("place"))).alias("first"),
        F.first(expected).alias("n"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, i: s + F.when(i <= F.col("relevant"), F.lit(1.0) / F.log2(i + F.lit(1.0))).otherwise(0.0))
    share = lambda x: F.when(F.col("n") > 0, F.round(F.col(x) / F.col("n"), 6)).otherwise(0.0)
    return sums.select(
        by,
        "p_at_1",
        share("kept").alias("recall"),
        F.when(F.col("relevant") > 0, F.round(F.col("dcg") / ideal, 6)).otherwise(0.0).alias("ndcg"),
        F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        share("pooled").alias("pool_recall"),
    )

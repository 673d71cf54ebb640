"""Monitoring aggregates over a log of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Intents that are no search.
SMALL_TALK = ("greeting", "out_of_scope")


def one_per_question(log: DataFrame) -> DataFrame:
    """The latest logged row of each query_id, with a clean intent (null stays null)."""
    rest = [c for c in log.columns if c not in ("query_id", "logged_at")]
    once = log.where("query_id is not null").groupBy("query_id").agg(F.max(F.struct("logged_at", *rest)).alias("r")).select("query_id", "r.*")
    return once.withColumn("intent", F.nullif(F.lower(F.regexp_replace("intent", r"(?U)^\s+|\s+$", "")), F.lit("")))


def searched() -> Column:
    """Everything but small talk; an unknown intent counts as searched."""
    return ~F.coalesce(F.col("intent").isin(*SMALL_TALK), F.lit(False))


def rank_percentile(df: DataFrame, by: list[str], value: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """sorted[max(0, int(n * share) - 1)] per group: (*by, one column per share).

    Values are counted first, so that a group costs as many rows as it has distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    order, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    upto = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(whole))
    picks = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.expr(f"n * {p} div {q}")), F.col(value))).alias(name) for name, (p, q) in shares.items()]
    return upto.groupBy(*by).agg(*picks)


def kpis(log: DataFrame) -> DataFrame:
    """One row: questions, small talk, answer rate, partial rate, quote accuracy, coverage, latency."""
    answered = searched() & F.col("verdict").isin("answered", "partial")
    n = F.count_if(searched())
    total, dropped = F.sum(F.coalesce("quotes_total", F.lit(0))), F.sum(F.coalesce("quotes_dropped", F.lit(0)))
    main = log.agg(
        F.count("*").alias("questions"),
        F.count_if(~searched()).alias("small_talk"),
        F.when(n > 0, F.round(F.count_if(answered) / n, 6)).alias("answer_rate"),
        F.when(n > 0, F.round(F.count_if(searched() & (F.col("verdict") == "partial")) / n, 6)).alias("partial_rate"),
        F.when(total > 0, F.round((total - dropped) / total, 6)).alias("quote_accuracy"),
        F.round(F.avg(F.when(answered, F.col("citation_coverage"))), 6).alias("coverage"),
    )
    positive = log.where(searched() & (F.col("latency_ms") > 0)).withColumn("one", F.lit(1))
    latency = rank_percentile(positive, ["one"], "latency_ms", {"p50": (1, 2), "p95": (19, 20)}).drop("one")
    return main.join(latency, F.lit(True), "left")  # one row on each side


def daily(log: DataFrame) -> DataFrame:
    """Per UTC day: questions by verdict, quote totals, coverage."""
    day = F.date_format("asked_at", "yyyy-MM-dd")
    verdicts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("answered", "partial", "abstained")]
    return log.groupBy(day.alias("day")).agg(
        F.count("*").alias("questions"), *verdicts, F.sum(F.coalesce("quotes_total", F.lit(0))).alias("quotes"), F.round(F.avg("citation_coverage"), 6).alias("coverage")
    )


def by_intent(log: DataFrame) -> DataFrame:
    """Per intent, null as unknown: questions, verdict counts and the median latency of all rows."""
    named = log.withColumn("intent", F.coalesce("intent", F.lit("unknown")))
    counts = named.groupBy("intent").agg(F.count("*").alias("questions"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("answered", "partial", "abstained")))
    medians = rank_percentile(named.where("latency_ms > 0"), ["intent"], "latency_ms", {"median": (1, 2)})
    return counts.join(medians, "intent", "left")


def window_load(log: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests and quotes of the same model in the last `seconds`, both ends included: (query_id, model, requests, quotes)."""
    w = Window.partitionBy("model", "hour").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    stamped = log.where("model is not null and asked_at is not null").select("query_id", "model", F.unix_micros("asked_at").alias("at"), F.coalesce("quotes_total", F.lit(0)).alias("q"))
    # a model may hold a third of all rows: windows run per hour, and the end of the hour before is added to each
    hour = F.expr("at div 3600000000")
    both = stamped.withColumn("hour", F.explode(F.when(F.expr(f"(at + {seconds} * 1000000) div 3600000000") > hour, F.array(hour, hour + 1)).otherwise(F.array(hour)))).withColumn("own", F.col("hour") == hour)
    loads = both.withColumn("requests", F.count("*").over(w)).withColumn("quotes", F.sum("q").over(w))
    return loads.where("own").select("query_id", "model", "requests", "quotes")

"""Aggregates over run records: how each question was answered, what it cost, and how evaluations ended.

A run record is a struct with rounds, searches, waited_ms, tokens (map model -> struct(input, output,
calls)) and steps (array of struct(node, ms)); a null record counts as one without rounds and waits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.monitor import rank_percentile, searched

# Periods in days, and the one that stands for any other; steps that a path leaves out, and those it renames.
PERIODS, PERIOD = (1, 7, 30), 7
QUIET = ("embed_query", "retrieve_evidence", "expand_evidence")
RENAMED = {"rerank_evidence": "search"}
VERDICTS = ("answered", "partial", "abstained")
TIERS = ("law", "guidance", "code")


def since(log: DataFrame, days: int, now: Column) -> DataFrame:
    """Rows asked in the last days; a length that is no period stands for a week."""
    span = days if days in PERIODS else PERIOD
    return log.where(F.col("asked_at") >= now - F.make_dt_interval(F.lit(span)))


def tokens(kind: str) -> Column:
    """Tokens of a run over all its models; 0 without a record."""
    return F.coalesce(F.aggregate(F.map_values("run.tokens"), F.lit(0).cast("bigint"), lambda s, x: s + x[kind]), F.lit(0))


def run_kpis(log: DataFrame) -> DataFrame:
    """One row: partial, wait_mean, tokens_in, tokens_out, second_round, repaired."""
    rounds = F.coalesce("run.rounds", F.lit(0))
    reviewed = F.count_if(searched() & (rounds > 0))
    mean = lambda x: F.coalesce(F.floor(F.avg(x)), F.lit(0))
    return log.agg(
        F.count_if(searched() & (F.col("verdict") == "partial")).alias("partial"),
        mean(F.when(searched(), F.coalesce("run.waited_ms", F.lit(0)))).alias("wait_mean"),
        mean(F.when(F.col("run").isNotNull(), tokens("input"))).alias("tokens_in"),
        mean(F.when(F.col("run").isNotNull(), tokens("output"))).alias("tokens_out"),
        F.when(reviewed > 0, F.round(F.count_if(searched() & (rounds > 1)) / reviewed, 6)).alias("second_round"),
        F.count_if("quotes_repaired").alias("repaired"),
    )


def quotas(log: DataFrame, day: Column, limit: int) -> DataFrame:
    """(model, used, share) of one UTC day: tokens of each model against a limit."""
    spent = log.where(F.to_date("asked_at") == day).select(F.explode("run.tokens").alias("model", "t"))
    used = spent.groupBy("model").agg(F.sum(F.col("t.input") + F.col("t.output")).alias("used"))
    return used.select("model", "used", F.round(F.least(F.lit(1.0), F.col("used") / F.lit(limit)), 6).alias("share"))


def daily_series(log: DataFrame) -> DataFrame:
    """Per UTC day: verdicts, quote accuracy, coverage, latency of searches in seconds, mean wait."""
    days = log.withColumn("day", F.date_format("asked_at", "yyyy-MM-dd"))
    total = F.sum(F.coalesce("quotes_total", F.lit(0)))
    main = days.groupBy("day").agg(
        *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS),
        F.when(total > 0, F.round((total - F.sum(F.coalesce("quotes_dropped", F.lit(0)))) / total, 3)).alias("quote_accuracy"),
        F.round(F.avg("citation_coverage"), 3).alias("coverage"),
        F.round(F.avg(F.coalesce("run.waited_ms", F.lit(0))) / 1000, 1).alias("waiting"),
    )
    latency = rank_percentile(days.where(searched() & (F.coalesce("latency_ms", F.lit(0)) != 0)), ["day"], "latency_ms", {"latency_p50": (1, 2), "latency_p95": (19, 20)})
    seconds = [F.round(F.col(c) / 1000, 1).alias(c) for c in ("latency_p50", "latency_p95")]
    return main.join(latency.select("day", *seconds), "day", "left")


def daily_tokens(log: DataFrame, models: list[str]) -> DataFrame:
    """Per UTC day one column per model and kind; days without a model's tokens have 0."""
    spent = log.select(F.date_format("asked_at", "yyyy-MM-dd").alias("day"), F.explode_outer("run.tokens").alias("model", "t"))
    pivoted = spent.groupBy("day").pivot("model", models).agg(F.sum("t.input").alias("input"), F.sum("t.output").alias("output"))
    return pivoted.na.fill(0)


def step_means(log: DataFrame) -> DataFrame:
    """(node, ms, runs): mean time of each step, truncated."""
    steps = log.select(F.explode("run.steps").alias("s"))
    return steps.groupBy(F.col("s.node").alias("node")).agg(F.floor(F.avg("s.ms")).alias("ms"), F.count("*").alias("runs"))


def median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(*by, median): the mean of the two middle values, from value counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*by)
    upto = counts.withColumn("upto", F.sum("c").over(whole.orderBy(value))).withColumn("n", F.sum("c").over(whole))
    middle = lambda plus: F.min(F.when(F.col("upto") >= F.expr(f"(n + {plus}) div 2"), F.col(value)))
    return upto.groupBy(*by).agg(((middle(1) + middle(2)) / 2).alias("median"))


def intents(log: DataFrame) -> DataFrame:
    """(intent, count, verdicts, rounds, latency): verdicts as a map, mean rounds, median latency in seconds; null intents are unknown."""
    named = log.withColumn("intent", F.coalesce("intent", F.lit("unknown")))
    per = named.groupBy("intent", "verdict").agg(F.count("*").alias("n"), F.sum(F.coalesce("run.rounds", F.lit(0))).alias("r"))
    whole = per.groupBy("intent").agg(F.sum("n").alias("count"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("verdict").isNotNull(), F.struct("verdict", "n"))))).alias("verdicts"), F.round(F.sum("r") / F.sum("n"), 2).alias("rounds"))
    seconds = median(named.where(F.coalesce("latency_ms", F.lit(0)) != 0), ["intent"], "latency_ms")
    return whole.join(seconds.select("intent", F.round(F.col("median") / 1000, 1).alias("latency")), "intent", "left")


def recent(log: DataFrame, n: int = 25) -> DataFrame:
    """The last n questions with what they cost and the steps they took, each search once."""
    names = F.create_map(*(F.lit(x) for pair in RENAMED.items() for x in pair))
    loud = F.filter("run.steps", lambda s: ~s["node"].isin(*QUIET))
    path = F.array_join(F.transform(loud, lambda s: F.coalesce(F.try_element_at(names, s["node"]), s["node"])), " → ")
    total = F.coalesce("quotes_total", F.lit(0))
    quotes = F.concat((total - F.coalesce("quotes_dropped", F.lit(0))).cast("string"), F.lit("/"), total.cast("string"))
    cost = F.when(F.col("run").isNotNull(), F.concat(F.format_number(tokens("input"), 0), F.lit(" / "), F.format_number(tokens("output"), 0))).otherwise("")
    shown = log.orderBy(F.desc("asked_at"), F.desc("query_id")).limit(n)
    return shown.select("query_id", "asked_at", "verdict", F.col("run.rounds").alias("rounds"), quotes.alias("quotes"), cost.alias("tokens"), (F.coalesce("latency_ms", F.lit(0)) / 1000).alias("latency"), F.coalesce(path, F.lit("")).alias("path"))


def run_records(steps: DataFrame, by: str, node: str) -> DataFrame:
    """(by, steps, rounds, searches, repaired, shortened, nodes): counts of the named steps, and of all by name."""
    per = steps.groupBy(by, node).agg(F.count("*").alias("n"))
    named = lambda name: F.coalesce(F.sum(F.when(F.col(node) == name, F.col("n"))), F.lit(0))
    return per.groupBy(by).agg(
        F.sum("n").alias("steps"), named("plan").alias("rounds"), named("rerank_evidence").alias("searches"), named("repair").alias("repaired"), named("shorten").alias("shortened"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(node).isNotNull(), F.struct(node, "n"))))).alias("nodes"),
    )


def summary(results: DataFrame) -> DataFrame:
    """One row over scored cases; `flagged` lists the cases behind its counts.

    `results`: id, error, verdict, should_abstain, expect_criteria, produced_criteria, leaked, recall,
    coverage, quotes_total, quotes_dropped, tokens, waited_ms, latency_ms, bases (map tier -> claims).
    Cases with an error count only as such. Means over nothing are 0. The 95th percentile needs two
    latencies; zero latencies are none.
    """
    ok = F.col("error").isNull()
    abstained = F.col("verdict") == "abstained"
    answerable, refusable = ok & ~F.col("should_abstain"), ok & F.col("should_abstain")
    mean = lambda where, x: F.coalesce(F.round(F.avg(F.when(where, x)), 6), F.lit(0.0))
    share = lambda some, of: F.concat(F.count_if(some).cast("string"), F.lit("/"), F.count_if(of).cast("string"))
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    claims = lambda tier: F.coalesce(F.try_element_at("bases", F.lit(tier)), F.lit(0))
    assessed = ok & F.col("expect_criteria")
    main = results.agg(
        F.count("*").alias("cases"),
        F.count_if(~ok).alias("errors"),
        mean(answerable, (~abstained).cast("double")).alias("answer_rate"),
        mean(ok, (abstained == F.col("should_abstain")).cast("double")).alias("abstention_accuracy"),
        share(refusable & abstained, refusable).alias("correct_refusals"),
        F.count_if(refusable & ~abstained).alias("false_answers"),
        mean(answerable, F.col("recall")).alias("citation_recall"),
        F.count_if(ok & ~abstained & (F.size("bases") > 0) & (claims("law") == 0)).alias("without_law"),
        *(F.coalesce(F.sum(F.when(ok, claims(t))), F.lit(0)).alias(f"claims_{t}") for t in TIERS),
        mean(ok & (F.col("quotes_total") > 0), (F.col("quotes_total") - F.col("quotes_dropped")) / F.col("quotes_total")).alias("quote_accuracy"),
        total("quotes_total").alias("quotes_total"),
        total("quotes_dropped").alias("quotes_dropped"),
        mean(ok & ~abstained, F.col("coverage")).alias("mean_coverage"),
        share(assessed & F.col("produced_criteria"), assessed).alias("criteria_produced"),
        F.count_if(assessed & F.col("leaked")).alias("verdict_leaks"),
        total("tokens").alias("tokens_spent"),
        F.coalesce(F.floor(F.avg(F.when(ok, F.col("tokens")))), F.lit(0)).alias("tokens_per_case"),
        F.floor(total("waited_ms") / 1000).alias("wait_s"),
        F.count_if(ok & (F.col("latency_ms") != 0)).alias("timed"),
    )
    timed = results.where(ok & (F.col("latency_ms") != 0)).withColumn("one", F.lit(1))
    p95 = rank_percentile(timed, ["one"], "latency_ms", {"p95": (19, 20)})
    both = main.join(median(timed, ["one"], "latency_ms").drop("one"), F.lit(True), "left").join(p95.drop("one"), F.lit(True), "left")  # single rows
    return both.select(*(c for c in main.columns if c != "timed"), F.coalesce(F.floor("median"), F.lit(0)).alias("latency_p50"), F.when(F.col("timed") >= 2, F.col("p95")).otherwise(F.lit(0)).alias("latency_p95"))


def flagged(results: DataFrame) -> DataFrame:
    """(flag, id): false answers, answers without binding law, and leaked verdicts, one row each. `results` as for summary."""
    ok, answered = F.col("error").isNull(), F.col("verdict") != "abstained"
    flags = F.array_compact(
        F.array(
            F.when(ok & answered & F.col("should_abstain"), "false_answer"),
            F.when(ok & answered & (F.size("bases") > 0) & F.try_element_at("bases", F.lit("law")).isNull(), "without_law"),
            F.when(ok & F.col("expect_criteria") & F.col("leaked"), "verdict_leak"),
        )
    )
    return results.select(F.explode(flags).alias("flag"), "id")


def reranker_report(cases: DataFrame, baseline: str, min_score: float) -> DataFrame:
    """Per reranker: means over answerable cases, extremes of the best scores, latencies, and cases whose kept items differ from the baseline's.

    `cases`: reranker, id, should_abstain, p_at_1, recall, ndcg, mrr, pool_recall, recitals_kept,
    best_score, latency_ms, kept (array).
    """
    base = cases.where(F.col("reranker") == baseline).select("id", F.array_sort(F.array_distinct("kept")).alias("base"))
    both = cases.join(base, "id", "left").withColumn("differs", F.col("base").isNotNull() & (F.array_sort(F.array_distinct("kept")) != F.col("base")))
    answerable = ~F.col("should_abstain")
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(answerable, F.col(c))), 6), F.lit(0.0)).alias(c)
    main = both.groupBy("reranker").agg(
        F.count("*").alias("scored"),
        *(mean(c) for c in ("p_at_1", "recall", "ndcg", "mrr", "pool_recall", "recitals_kept")),
        F.count_if(answerable & (F.col("recall") == 0)).alias("missed"),
        F.count_if(answerable & (F.col("best_score") < min_score)).alias("below_min"),
        F.coalesce(F.min(F.when(answerable, F.col("best_score"))), F.lit(0.0)).alias("lowest_answerable"),
        F.coalesce(F.max(F.when(~answerable, F.col("best_score"))), F.lit(0.0)).alias("highest_abstain"),
        F.coalesce(F.floor(F.avg("latency_ms")), F.lit(0)).alias("latency_mean"),
        F.count_if("differs").alias("differs"),
    )
    middle = median(cases, ["reranker"], "latency_ms").select("reranker", F.floor("median").alias("latency_p50"))
    return main.join(middle, "reranker", "left")


def case_extras(ranked: DataFrame, by: list[str], k: int = 4, min_score: float = 0.005) -> DataFrame:
    """(*by, best_score, recitals_kept, kept): the best score of a pool, and of the first k items above the threshold the recitals and ids.

    `ranked`: by, place, id, score, is_recital.
    """
    kept = (F.col("place") <= k) & (F.col("score") >= min_score)
    return ranked.groupBy(*by).agg(F.max("score").alias("best_score"), F.count_if(kept & F.col("is_recital")).alias("recitals_kept"), F.array_sort(F.collect_list(F.when(kept, F.col("id")))).alias("kept"))


def report_lines(results: DataFrame) -> DataFrame:
    """(id, line): fixed-width lines of a report; a mark before cases that were decided wrongly.

    `results`: id, category, error, verdict, right, recall, quotes_total, quotes_dropped, bases.
    """
    recall = F.coalesce(F.concat(F.round(F.col("recall") * 100).cast("int").cast("string"), F.lit("%")), F.lit("-"))
    quotes = F.concat((F.col("quotes_total") - F.col("quotes_dropped")).cast("string"), F.lit("/"), F.col("quotes_total").cast("string"))
    basis = F.array_join(F.transform(F.array_sort(F.map_entries("bases")), lambda e: F.concat(F.substring(e["key"], 1, 1), e["value"].cast("string"))), "/")
    wide = lambda c, n: F.rpad(c, F.greatest(F.lit(n), F.length(c)), F.lit(" "))
    good = F.concat_ws(" ", F.concat(F.when(F.col("right"), " ").otherwise("!"), wide(F.col("id"), 31)), wide(F.col("category"), 14), wide(F.col("verdict"), 10), F.lpad(recall, 7, " "), F.lpad(quotes, 10, " "), F.lpad(F.coalesce(F.nullif(basis, F.lit("")), F.lit("-")), 14, " "))
    bad = F.concat_ws(" ", wide(F.col("id"), 32), wide(F.col("category"), 14), F.concat(F.lit("ERROR: "), F.substring("error", 1, 30)))
    return results.select("id", F.when(F.col("error").isNull(), good).otherwise(bad).alias("line"))


def unscored(pools: DataFrame, cache: DataFrame, by: list[str], keep: int) -> DataFrame:
    """Pools that a scorer still has to score: those above `keep` items that the cache lacks."""
    large = pools.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > keep)
    return large.join(cache.select(*by).distinct(), by, "left_anti")

"""Answers over many questions: evidence, verified claims, merged rounds, case scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import ranking as R
from vellum.operators import verify as V

# Rounds at most; phrases that state a verdict on the asker's system.
MAX_ROUNDS = 2
VERDICTS = (
    "your system is high-risk",
    "your system is a high-risk",
    "is a high-risk ai system",
    "your tool is high-risk",
    "you are a provider",
    "you must comply",
    "this is prohibited",
    "your system is not high-risk",
    "is not high-risk",
    "you do not need to",
)


def gather_evidence(hits: DataFrame, units: DataFrame, by: str = "query_id", candidates: int = 20, budget: int = R.EVIDENCE_BUDGET) -> DataFrame:
    """(by, unit_id, authority, place, label, spent): fused hits, expanded to units, law first, packed, labelled.

    One shuffle on the question for fusion, one on the unit for its text, one on the question for
    packing; texts join only after the pools are cut to `candidates`.
    """
    fused = R.fuse(hits, [by], "unit_id", {"structural": 2.0}).where(F.col("place") <= candidates)
    expanded = R.expand_to_parents(fused.withColumn("chunk_id", F.col("unit_id")), units, [by])
    priced = expanded.join(units.select("unit_id", "authority", R.estimate_tokens(F.col("text")).alias("cost")), "unit_id")
    ordered = R.top(priced.withColumnRenamed("place", "prior"), [by], [R.tier(F.col("authority")), F.col("prior"), F.col("unit_id")], candidates)
    return R.label(R.pack_budget(ordered.select(by, "unit_id", "authority", "score", "place", "cost"), [by], "place", "cost", budget))


def verify_answers(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, claim_no, verified, rejected, survives, basis) of each claim.

    `claims`: question_id, claim_no, claim, quotes array<struct<label, quote>>; `evidence`:
    question_id, label, unit_id, authority, text. Blank claims and quotes are skipped; a claim
    survives with at least one verified quote; its basis is the strongest tier among those.
    """
    quotes = claims.where("trim(claim) <> ''").select("question_id", "claim_no", F.posexplode_outer("quotes").alias("quote_no", "q"))
    asked = quotes.where("trim(q.quote) <> ''").select("question_id", "claim_no", "quote_no", F.col("q.label").alias("label"), F.col("q.quote").alias("quote"))
    sources = evidence.select("question_id", "label", F.col("unit_id").alias("source_unit"), "authority")
    named = asked.join(sources, ["question_id", "label"], "left").withColumn("quote_id", F.struct("question_id", "claim_no", "quote_no"))
    checked = V.verify_quotes(named.select("quote_id", F.col("source_unit").alias("unit_id"), "quote"), evidence.select("unit_id", "text"))
    good = F.col("method").isin("exact", "elided")
    per_claim = named.drop("quote").join(checked.select("quote_id", "method"), "quote_id").groupBy("question_id", "claim_no").agg(F.count_if(good).alias("verified"), F.count_if(~good).alias("rejected"), F.min(F.when(good, R.tier(F.col("authority")))).alias("t"))
    tiers = F.array(*map(F.lit, (*R.TIERS, "law")))
    stated = claims.where("trim(claim) <> ''").select("question_id", "claim_no").join(per_claim, ["question_id", "claim_no"], "left")
    return stated.select("question_id", "claim_no", F.coalesce("verified", F.lit(0)).alias("verified"), F.coalesce("rejected", F.lit(0)).alias("rejected"), (F.coalesce("verified", F.lit(0)) > 0).alias("survives"), F.when(F.col("t").isNotNull(), F.element_at(tiers, F.col("t") + 1)).alias("basis"))


def outcomes(checked: DataFrame) -> DataFrame:
    """(question_id, claims, kept, coverage, verdict, needs_repair) from verified claims."""
    per = checked.groupBy("question_id").agg(F.count("*").alias("claims"), F.count_if("survives").alias("kept"), F.sum("rejected").alias("rejected"))
    covered = V.coverage(F.col("kept"), F.col("claims"))
    return per.select("question_id", "claims", "kept", covered.alias("coverage"), V.verdict(covered, F.col("kept")).alias("verdict"), ((F.col("rejected") > 0) & (covered < V.ANSWERED)).alias("needs_repair"))


def merge_rounds(rounds: DataFrame) -> DataFrame:
    """(question_id, rounds, claims, verdict): abstained follow-ups are dropped; partial if any kept round is."""
    kept = rounds.where((F.col("round") == 1) | (F.col("verdict") != "abstained")).where(F.col("round") <= MAX_ROUNDS)
    whole = kept.groupBy("question_id").agg(F.count("*").alias("rounds"), F.sum("claims").alias("claims"), F.count_if(F.col("verdict") == "partial").alias("partial"), F.count_if(F.col("verdict") == "answered").alias("answered"))
    return whole.select("question_id", "rounds", "claims", F.when(F.col("partial") > 0, "partial").when(F.col("answered") > 0, "answered").otherwise("abstained").alias("verdict"))


def merge_usage(usage: DataFrame) -> DataFrame:
    """Token use added up by question and model: (question_id, model, input, output, calls)."""
    return usage.groupBy("question_id", "model").agg(F.sum(F.coalesce("input", F.lit(0))).alias("input"), F.sum(F.coalesce("output", F.lit(0))).alias("output"), F.sum(F.coalesce("calls", F.lit(0))).alias("calls"))


def score_cases(results: DataFrame) -> DataFrame:
    """(id, recall, right, leaked) of each case against its expectation.

    `results`: id, expected array, cited array of labels (`Article 6`, `Paragraph 6(2)`, `Annex III`),
    should_abstain, verdict, blob, and where there are any expected_annexes (array of numbers) and
    expect_criteria: then only assessments leak. Recall is 1 where nothing is expected.
    """
    label = lambda c: F.coalesce(
        F.nullif(F.regexp_extract(c, r"^(?:Article|Paragraph)\s+(\d+[a-z]?)", 1), F.lit("")), F.nullif(F.concat(F.lit("anx:"), F.regexp_extract(c, r"^Annex\s+([IVXLC]+)", 1)), F.lit("anx:"))
    )
    cited = F.array_distinct(F.filter(F.transform("cited", label), lambda x: x.isNotNull()))
    wanted = F.array_distinct("expected")
    if "expected_annexes" in results.columns:
        wanted = F.array_union(wanted, F.transform(F.coalesce("expected_annexes", F.array().cast("array<string>")), lambda a: F.concat(F.lit("anx:"), a)))
    found, expected = F.size(F.array_intersect(wanted, cited)), F.size(wanted)
    abstained = F.col("verdict") == "abstained"
    blob = F.lower(F.coalesce("blob", F.lit("")))
    leak = F.exists(F.array(*map(F.lit, VERDICTS)), lambda phrase: F.contains(blob, phrase))
    if "expect_criteria" in results.columns:
        leak = leak & F.coalesce("expect_criteria", F.lit(False))
    return results.select("id", F.when(expected == 0, F.lit(1.0)).otherwise(found / expected).alias("recall"), (abstained == F.col("should_abstain")).alias("right"), leak.alias("leaked"))


def within_budget(costs: DataFrame, order: str, cost: str, budget: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Cases that start before the budget is spent: those whose predecessors cost less than it, per run where `by` names runs. A case list is small by nature."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return costs.withColumn("before", before).where(F.col("before") < budget)

"""From questions to answers over many questions at once: what is searched, what is read, and how a round ends.

Each step of the control flow is a projection or a join keyed by question, round and side. Drafts of
a language model are rows of a table: the model is called elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.labels import criterion_text, link_title, one_spaced, short_label
from vellum.functions.text import named_articles
from vellum.operators import ranking as R
from vellum.operators import verify as V

# The provisions behind each legal test (articles, annexes); sides and rounds at most.
LEGAL_TESTS = {
    "high_risk": (["6"], ["III"]),
    "prohibited": (["5"], []),
    "transparency": (["50"], []),
    "scope": (["2"], []),
    "gpai": (["51", "53", "55"], []),
    "definition": (["3"], []),
}
SIDES, ROUNDS = 3, 2
# Kinds of document in a prompt; headings of claims by what they rest on.
TAGS = {"law": "BINDING LAW", "guidance": "COMMISSION GUIDANCE (not binding)", "code": "VOLUNTARY CODE OF PRACTICE (not binding)"}
BASES = {"law": "Legal requirement", "guidance": "Commission guidance", "code": "Practical implementation"}


def standalone(question: Column, previous: Column, rewritten: Column, refused: Column) -> Column:
    """A follow-up that stands alone: the rewritten one; where the rewrite was refused, the previous
    question and this one; a question without history, or an empty rewrite, as it is."""
    both = F.concat_ws(" ", previous, question)
    chosen = F.when(previous.isNull(), question).when(refused, both).otherwise(F.trim(rewritten))
    return F.coalesce(F.nullif(chosen, F.lit("")), question)


def plan(questions: DataFrame) -> DataFrame:
    """(question_id, round, side, query, label, articles, annexes, named_only): the searches of a round.

    `questions`: question_id, round, question, intent, articles, annexes, sides, legal_test, and
    follow_up with follow_kind and follow_sides where a review asked for one. A comparison of two
    sides or more searches each of the first three alone; an applicability question also searches the
    provisions of its test; a follow-up searches the articles it names.
    """
    empty = F.array().cast("array<string>")
    follows = F.col("follow_up").isNotNull()
    focus = F.coalesce("follow_up", "question")
    intent = F.when(follows, F.col("follow_kind")).otherwise(F.col("intent"))
    sides = F.coalesce(F.when(follows, F.col("follow_sides")).otherwise(F.col("sides")), empty)
    test = lambda i: F.create_map(*(x for k, v in LEGAL_TESTS.items() for x in (F.lit(k), F.array(*map(F.lit, v[i])).cast("array<string>"))))
    articles, annexes = (F.try_element_at(test(i), F.col("legal_test")) for i in (0, 1))
    names = F.array_join(F.concat(F.transform(articles, lambda a: F.concat(F.lit("Article "), a)), F.transform(annexes, lambda a: F.concat(F.lit("Annex "), a))), ", ")

    def task(side, query, label, arts, anns, named) -> Column:
        return F.struct(side.cast("int").alias("side"), query.alias("query"), label.alias("label"), F.coalesce(arts, empty).alias("articles"), F.coalesce(anns, empty).alias("annexes"), F.lit(named).alias("named_only"))

    own = task(F.lit(0), focus, F.when(follows, F.concat(F.lit("for: "), focus)).otherwise(""), F.when(follows, named_articles(focus)).otherwise(F.col("articles")), F.when(follows, empty).otherwise(F.col("annexes")), False)
    tested = task(F.lit(1), focus, F.concat(F.lit("the legal test in "), names), articles, annexes, True)
    compared = F.transform(F.slice(sides, 1, SIDES), lambda s, i: task(i, s, F.concat(F.lit("for: "), s), empty, empty, False))
    tasks = (
        F.when((intent == "comparison") & (F.size(sides) > 1), compared)
        .when(~follows & (intent == "applicability") & articles.isNotNull(), F.array(own, tested))
        .otherwise(F.array(own))
    )
    return questions.select("question_id", "round", F.explode(tasks).alias("t")).select("question_id", "round", "t.*")


def collect(found: DataFrame, budget: int = R.EVIDENCE_BUDGET) -> DataFrame:
    """(question_id, unit_id, authority, score, place, label, cost): the evidence of a round from its searches.

    `found`: question_id, side, unit_id, authority, score, place, cost. Each side orders its units by
    authority and spends its own share of the budget; a unit of several sides keeps the first place
    and the last values; then all are ordered by authority again.
    """
    by = ["question_id", "side"]
    sides = found.groupBy("question_id").agg(F.count_distinct("side").alias("n"))
    order = Window.partitionBy(*by).orderBy(R.tier(F.col("authority")), "place", "unit_id")
    placed = found.join(sides, "question_id").withColumn("place", F.row_number().over(order).cast("bigint"))
    packed = R.pack_budget(placed.withColumn("share", F.floor(F.lit(budget) / F.col("n"))), by, "place", "cost", "share")
    once = R.merge_evidence(packed.withColumn("at", F.struct("side", "place")).select("question_id", "unit_id", "at", "authority", "score", "cost"), ["question_id"], "unit_id", "at")
    whole = Window.partitionBy("question_id").orderBy(R.tier(F.col("authority")), "at")
    return R.label(once.withColumn("place", F.row_number().over(whole).cast("bigint"))).select("question_id", "unit_id", "authority", "score", "place", "label", "cost")


def after_collect(evidence: Column, best: Column, rounds: Column) -> Column:
    """`generate` if there is evidence and its best score passes; else `finalise` after an earlier round, or `abstain`."""
    enough = (F.coalesce(evidence, F.lit(0)) > 0) & (F.coalesce(best, F.lit(0.0)) >= R.MIN_SCORE)
    return F.when(enough, "generate").when(F.coalesce(rounds, F.lit(0)) > 0, "finalise").otherwise("abstain")


def needs_shorter(overran: Column, shortened: Column, round_: Column) -> Column:
    return overran & ~shortened & (round_ == 1)


def needs_repair(round_: Column, attempted: Column, rejected: Column, coverage: Column) -> Column:
    return (round_ == 1) & ~attempted & (rejected > 0) & (coverage < V.ANSWERED)


def follows_up(verdict: Column, round_: Column, intent: Column, complete: Column, kind: Column, question: Column, focus: Column) -> Column:
    """Whether a review leads to another round: never after an abstention, the last round or an
    applicability question; else where it found something missing and asks something new."""
    may = (verdict != "abstained") & (round_ < ROUNDS) & (F.coalesce(intent, F.lit("")) != "applicability")
    asks = F.nullif(F.trim(question), F.lit(""))
    return F.coalesce(may & ~complete & kind.isin("lookup", "comparison") & (asks != focus), F.lit(False))


def round_outcome(rounds: DataFrame) -> DataFrame:
    """(question_id, round, verdict, reason) of each round.

    `rounds`: question_id, round, intent, claims, kept, overran, answerable. Without a kept claim a
    round abstains, as it does where the draft calls itself unable to answer (an assessment cannot).
    """
    coverage = V.coverage(F.col("kept"), F.col("claims"))
    none = F.coalesce("kept", F.lit(0)) == 0
    unable = (F.coalesce("intent", F.lit("")) != "applicability") & ~F.coalesce("answerable", F.lit(True))
    verdict = F.when(none | unable, "abstained").otherwise(V.verdict(coverage, F.col("kept")))
    reason = F.when(none & F.col("overran"), "overran").when(none, "unsupported").when(unable, "no_evidence").when(verdict == "abstained", "unsupported")
    return rounds.select("question_id", "round", verdict.alias("verdict"), reason.alias("reason"))


def surviving_criteria(criteria: DataFrame, claims: DataFrame) -> DataFrame:
    """Criteria whose claim survived: the key of a criterion is its claim's text.

    `criteria`: question_id, criterion, explanation, status; `claims`: question_id, text of kept claims.
    """
    keyed = criteria.withColumn("text", criterion_text(F.col("criterion"), F.col("explanation")))
    return keyed.join(claims.select("question_id", "text").distinct(), ["question_id", "text"], "left_semi").drop("text")


def final_attempts(attempts: DataFrame) -> DataFrame:
    """(question_id, round, attempts, overran, rejected, coverage, path): how the drafts of each round went.

    `attempts`: question_id, round, attempt (from 1), overran, rejected, coverage, as drafted. Of a first
    round one shorter draft follows an overrun, and one repair follows a verified draft that needs it
    (which may again be shortened no more); further attempts are not read. Other rounds have one.
    """
    rows = attempts.groupBy("question_id", "round").agg(F.array_sort(F.collect_list(F.struct("attempt", "overran", "rejected", "coverage"))).alias("a"))  # a handful per round
    step = """aggregate(a, struct(false as done, false as shortened, false as repaired, 0 as n, false as overran, 0L as rejected, 0.0D as coverage, cast(array() as array<string>) as path), (s, x) -> CASE WHEN s.done THEN s
      WHEN round = 1 AND x.overran AND NOT s.shortened THEN struct(false as done, true as shortened, s.repaired as repaired, s.n + 1 as n, x.overran as overran, cast(x.rejected as bigint) as rejected, cast(x.coverage as double) as coverage, concat(s.path, array('generate', 'shorten')) as path)
      WHEN round = 1 AND NOT x.overran AND NOT s.repaired AND x.rejected > 0 AND x.coverage < {bound} THEN struct(false as done, false as shortened, true as repaired, s.n + 1 as n, x.overran as overran, cast(x.rejected as bigint) as rejected, cast(x.coverage as double) as coverage, concat(s.path, array('generate', 'verify', 'repair')) as path)
      ELSE struct(true as done, s.shortened as shortened, s.repaired as repaired, s.n + 1 as n, x.overran as overran, cast(x.rejected as bigint) as rejected, cast(x.coverage as double) as coverage, concat(s.path, array('generate', 'verify')) as path) END)"""
    done = rows.withColumn("s", F.expr(step.replace("{bound}", str(V.ANSWERED))))
    return done.select("question_id", "round", F.col("s.n").alias("attempts"), "s.overran", "s.rejected", "s.coverage", F.array_join("s.path", " > ").alias("path"))


def evidence_block(label: Column, citation: Column, heading: Column, authority: Column, version: Column, context: Column, text: Column) -> Column:
    """One piece of evidence as a prompt shows it: what it is, how binding, where it sits, its own text."""
    tags = F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair))
    source = F.concat_ws("; ", F.try_element_at(tags, authority), version)
    head = F.concat(F.lit("["), label, F.lit("] "), citation, F.coalesce(F.concat(F.lit(" - "), F.nullif(heading, F.lit(""))), F.lit("")), F.when(source != "", F.concat(F.lit("  ("), source, F.lit(")"))).otherwise(""))
    sits = F.concat(F.lit("\nWhere it sits: "), F.regexp_replace(F.nullif(context, F.lit("")), r"^(Section \d+): [^›|]*", "$1 "))
    return F.concat(head, F.coalesce(sits, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))


def prompts(evidence: DataFrame, by: str) -> DataFrame:
    """(by, evidence): the blocks of each question in order. `evidence`: by, place, block; at most a budget's worth."""
    rows = evidence.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "block"))).alias("b"))
    return rows.select(by, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("evidence"))


def user_prompt(question: Column, evidence: Column, rejected: Column, assessment: Column) -> Column:
    """The user's turn: question or situation, evidence, instruction, and the rejected quotes of an earlier draft."""
    heading = F.when(assessment, "THE USER'S SITUATION").otherwise("QUESTION")
    instruction = F.when(assessment, "Set out the criteria the Regulation applies. Do not state a verdict.").otherwise("Answer the question using only the evidence above.")
    note = F.when(F.size(rejected) > 0, F.concat(F.lit("\n\nREJECTED QUOTES\n"), F.array_join(F.transform(rejected, lambda q: F.concat(F.lit("  - "), q)), "\n"))).otherwise("")
    return F.concat(heading, F.lit("\n"), question, F.lit("\n\nEVIDENCE\n\n"), evidence, F.lit("\n\n"), instruction, F.coalesce(note, F.lit("")))


def citation_links(citations: Column) -> Column:
    """Links of a claim's citations (array of struct(label, link, quote)), each label once."""
    labels = F.transform(citations, lambda c: short_label(c["label"]))
    shown = lambda c: F.when(c["link"].isNotNull(), F.concat(F.lit("["), short_label(c["label"]), F.lit("](<"), c["link"], F.lit('> "'), link_title(c["quote"]), F.lit('")'))).otherwise(F.concat(F.lit("`"), short_label(c["label"]), F.lit("`")))
    first = F.filter(F.transform(citations, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: F.array_position(labels, short_label(x["c"]["label"])) == x["i"] + 1)
    return F.array_join(F.transform(first, lambda x: shown(x["c"])), " ")


def rendered_claims(claims: DataFrame) -> DataFrame:
    """(question_id, body): each question's claims with their links; under headings by basis where they rest on several.

    `claims`: question_id, claim_no, claim, basis, citations.
    """
    line = F.trim(F.concat_ws(" ", F.trim("claim"), F.nullif(citation_links(F.col("citations")), F.lit(""))))
    rows = claims.select("question_id", R.tier(F.col("basis")).alias("tier"), "claim_no", line.alias("line"), "basis")
    grouped = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("tier", "claim_no", "line", "basis"))).alias("c"))
    several = F.size(F.array_distinct(F.transform("c", lambda x: x["basis"]))) > 1
    headings = F.create_map(*(F.lit(x) for pair in BASES.items() for x in pair))
    first = lambda x, i: (i == 0) | (F.get("c", i - 1)["basis"] != x["basis"])
    parts = F.transform("c", lambda x, i: F.when(several & first(x, i), F.concat(F.lit("**"), F.coalesce(F.try_element_at(headings, x["basis"]), x["basis"]), F.lit("**\n\n"), x["line"])).otherwise(x["line"]))
    plain = F.transform(F.array_sort(F.transform("c", lambda x: F.struct(x["claim_no"].alias("n"), x["line"].alias("line")))), lambda x: x["line"])
    return grouped.select("question_id", F.array_join(F.when(several, parts).otherwise(plain), "\n\n").alias("body"))


def history(steps: DataFrame, by: str, order: list[Column], turns: int = 3) -> DataFrame:
    """(by, turns): the last turns of each conversation, oldest first, as a prompt shows them.

    `steps`: by, question, answer and what `order` reads. Rows without question are no turn.
    """
    last = R.top(steps.where(F.coalesce(one_spaced(F.col("question")), F.lit("")) != ""), [by], order, turns)
    text = F.concat(F.lit("User: "), "question", F.lit("\nAssistant: "), F.coalesce("answer", F.lit("")))
    rows = last.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("p"), text.alias("t")))).alias("ts"))
    return rows.select(by, F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n").alias("turns"))

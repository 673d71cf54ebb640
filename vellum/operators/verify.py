"""Mechanical verification of quotes against their source text, and verdicts from what survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.labels import closeness

# Shortest quote in characters and words; coverage for the two verdicts.
MIN_CHARS, MIN_WORDS = 24, 4
ANSWERED, PARTIAL = 0.8, 0.4


def verify_quotes(quotes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(quote_id, unit_id, method, start, end, shown) of each quote.

    `quotes`: quote_id, unit_id, quote; `evidence`: unit_id, text. The folded, trimmed quote has to
    occur in the folded text letter by letter; the parts of an elided quote one after the other.
    method: `exact`, `elided`, or the reason for rejection: `unknown` unit, too `short`, `not_found`.
    `shown` is the original text of the span. A null or blank quote is too short.
    """
    quoted = evidence.join(quotes.select("unit_id").distinct(), "unit_id", "left_semi")  # only these are folded
    folded = quoted.dropDuplicates(["unit_id"]).select("unit_id", "text", T.normalize(F.col("text")).alias("f"))
    needle = T.trim_boundary(T.normalize_text(F.coalesce("quote", F.lit(""))))
    asked = quotes.select("quote_id", "unit_id", needle.alias("needle"))
    pairs = asked.join(folded, "unit_id", "left").withColumn("parts", T.segments(F.col("needle")))
    # the fold carries (position after the last part, start of the first); 0 once a part is missing
    spans = F.expr(
        """aggregate(parts, struct(1 as pos, 0 as first), (a, s) -> CASE
             WHEN a.pos = 0 OR locate(s, f.text, a.pos) = 0 THEN struct(0 as pos, a.first as first)
             ELSE struct(locate(s, f.text, a.pos) + length(s) as pos, if(a.first = 0, locate(s, f.text, a.pos), a.first) as first) END)"""
    )
    short = (F.length("needle") < MIN_CHARS) | (F.size(F.filter(F.split("needle", r"\s+"), lambda w: w != "")) < MIN_WORDS)
    method = (
        F.when(F.col("f").isNull() | F.col("f.text").isNull(), "unknown").when(short, "short").when(F.col("span.pos") == 0, "not_found").when(F.size("parts") > 1, "elided").otherwise("exact")
    )
    found = pairs.withColumn("span", spans).withColumn("method", method)
    good = F.col("method").isin("exact", "elided")
    start, end = F.when(good, F.col("span.first") - 1), F.when(good, F.col("span.pos") - 1)
    return found.select("quote_id", "unit_id", "method", start.alias("start"), end.alias("end"), T.original_slice(F.col("text"), F.col("f.offsets"), start, end).alias("shown"))


def diagnose(checked: DataFrame, quotes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(quote_id, unit_id, closeness) of quotes that were not found: how near they come to their unit, 0 to 100.

    It accepts nothing. `checked`: from verify_quotes; `quotes` and `evidence` as there.
    """
    lost = checked.where("method = 'not_found'").select("quote_id", "unit_id").join(quotes, ["quote_id", "unit_id"])
    texts = evidence.join(lost.select("unit_id").distinct(), "unit_id", "left_semi").dropDuplicates(["unit_id"])
    near = closeness(T.normalize_text(F.col("quote")), T.normalize_text(F.col("text")))
    return lost.join(texts, "unit_id").select("quote_id", "unit_id", near.alias("closeness"))


def verdict(coverage: Column, claims: Column) -> Column:
    """abstained without claims or below the lower bound, else partial or answered."""
    return F.when(F.coalesce(claims, F.lit(0)) == 0, "abstained").when(coverage >= ANSWERED, "answered").when(coverage >= PARTIAL, "partial").otherwise("abstained")


def coverage(kept: Column, total: Column) -> Column:
    """kept / total, 0 where there is nothing."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(kept / total)

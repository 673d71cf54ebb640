import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import text as T


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n ­​’…‑ﬁ½a"), st.characters(codec="utf-8")), max_size=60))
def test_fold_is_idempotent_with_rising_offsets(text):
    folded, offsets = T.fold_text(text)
    assert T.fold_text(folded)[0] == folded
    assert len(offsets) == len(folded) and offsets == sorted(offsets)


@pytest.mark.parametrize("raw, folded", [("a b", "a b"), ("“x” ‘y’", "\"x\" 'y'"), ("pre‑market", "pre-market"), ("soft­hyphen", "softhyphen"), ("wait…", "wait..."), ("  a \n b ", "a b"), ("", "")])
def test_fold(raw, folded):
    assert T.fold_text(raw)[0] == folded


def test_offsets_lead_to_the_characters():
    text = " “ﬁne” –  wait… "
    folded, offsets = T.fold_text(text)
    assert folded == '"fine" - wait...' and offsets == [1, 2, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 14, 14]


def test_segments_lose_boundary_punctuation(spark):
    row = spark.createDataFrame([("the documentation ..., make it available ... .",)], "q string").select(T.segments(F.col("q"))).first()
    assert row[0] == ["the documentation", "make it available"]


def test_columns(spark):
    row = spark.createDataFrame([("Compare Articles 53 and 54a with article 6; see commitment 1.2 and Sub-Measure 3", "[...] one [...] two ...", "\"'(quote).\" ")], "q string, e string, b string")
    got = row.select(
        T.named_articles(F.col("q")).alias("articles"),
        T.code_parts(F.col("q")).alias("parts"),
        T.segments(F.col("e")).alias("segments"),
        T.trim_boundary(F.col("b")).alias("trimmed"),
        T.estimate_tokens(F.lit("x" * 36)).alias("tokens"),
        T.estimate_tokens(F.lit(None).cast("string")).alias("none"),
    ).first()
    assert got["articles"] == ["53", "54a", "6"] and got["parts"] == ["Commitment 1.2", "Sub-measure 3"]
    assert got["segments"] == ["one", "two"] and got["trimmed"] == "quote" and (got["tokens"], got["none"]) == (42, 32)


def test_headings_and_links(spark):
    df = spark.createDataFrame([("Article 6a Scope \"",), ("CHAPTER III Duties",), ("ANNEX IV",), ("Recital",)], "t string")
    got = [tuple(r["h"]) for r in df.select(T.classify_heading(F.col("t")).alias("h")).collect()]
    assert got == [("article", "6a", "Scope"), ("chapter", "III", "Duties"), ("annex", "IV", ""), (None, None, "Recital")]
    units = spark.createDataFrame([("article", "6", "ART_6", "law"), ("paragraph", "2", "CH_I/ART_7/PAR_2", "law"), ("point", "a", "X/PT_a", "law"), ("section", None, "S", "code")], "u string, n string, p string, a string")
    out = units.select(T.deeplink("b", F.lit("0X"), F.col("u"), F.col("n"), F.col("p")).alias("l"), T.citation_label(F.col("u"), F.col("n"), F.col("p"), F.col("a"), F.lit("Code")).alias("c")).collect()
    assert [r["l"] for r in out] == ["b?uri=CELEX%3A0X#art_6", "b?uri=CELEX%3A0X#art_7", "b?uri=CELEX%3A0X", "b?uri=CELEX%3A0X"]
    assert [r["c"] for r in out] == ["Article 6", "Paragraph 2", "X/PT_a", "Code"]

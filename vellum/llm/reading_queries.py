"""Queries for reading levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.reading import document_frequencies, familiar_words, features, reading_levels
from vellum.session import Cuts
from vellum.sources.tables import table


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Reading level of each document."""
    documents = table(spark, folder, "documents")
    cuts = Cuts(spark)
    stated = cuts.cut(document_frequencies(documents))
    told = document_frequencies(documents, familiar_words(stated))
    lists = familiar_words(cuts.cut(stated.unionByName(told).groupBy("lang", "word").agg(F.sum("n").alias("n"))))
    found = cuts.cut(features(documents, lists))
    return reading_levels(found, table(spark, folder, "reading_label"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents at level 4."""
    return p9_levels(spark, folder).where("reading_level = 4").select("doc_id").distinct()


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and words by language and level."""
    return p9_levels(spark, folder).groupBy("lang", "reading_level").agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"))


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile}

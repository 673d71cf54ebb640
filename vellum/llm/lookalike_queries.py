"""Queries for texts that read the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.lookalikes import classes, confusables, fingerprints, lookalike_pairs, normalized
from vellum.session import Cuts
from vellum.sources.tables import table


def _prints(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "structural_unit").where("unit_id is not null")
    return Cuts(spark).cut(fingerprints(units))  # read three times below


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of units whose texts differ in characters but read the same."""
    return lookalike_pairs(_prints(spark, folder))


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Units whose form has several texts, with the class of the form."""
    return classes(_prints(spark, folder))


def p6_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of each unit's text, with offsets to the text."""
    return normalized(table(spark, folder, "structural_unit").select("unit_id", "text").distinct())


def p6_confusables(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of mixed scripts, and tokens spelled as a whole in letters of another script."""
    return confusables(table(spark, folder, "structural_unit").select("unit_id", "text"))


SQL: dict[str, str] = {}
QUERIES = {"p6_found": p6_found, "p6_classes": p6_classes, "p6_normalized": p6_normalized, "p6_confusables": p6_confusables}

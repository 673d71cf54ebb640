"""Queries for token budgets by source, language and authority."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.budget import count_tokens
from vellum.sources.tables import table

TOKENIZERS = os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers")
AUTHORITIES = ("law", "guidance", "code")


def _name(key: Column) -> Column:
    """Letters and digits in lower case, joined by single hyphens; blank gives ''."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(key, F.lit(""))), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def unit_slices(spark: SparkSession, folder: str) -> DataFrame:
    """(unit_id, source_key, lang, authority) of units with a candidate row.

    The source is the candidate's, as written in legal_source, or that of the unit's version; the
    authority is the candidate's, or that of the source. Popular units count once per distinct
    statement; candidates whose unit or version is unknown give no slice.
    """
    sources = table(spark, folder, "legal_source").select("source_id", "source_key", F.lower("authority").alias("source_authority"), _name(F.col("source_key")).alias("name")).where("source_key is not null")
    by_name = sources.groupBy("name").agg(F.min(F.struct("source_key", "source_authority")).alias("named"))
    versions = table(spark, folder, "document_version").select("document_version_id", "source_id", "lang").dropDuplicates(["document_version_id"])
    versions = versions.join(sources.select("source_id", F.struct("source_key", "source_authority").alias("own")).dropDuplicates(["source_id"]), "source_id", "left")
    authority = F.regexp_replace(F.lower(F.coalesce("authority", F.lit(""))), r"\P{L}", "")
    stated = (
        table(spark, folder, "candidate")
        .where(F.col("structural_unit_id").isNotNull())
        .select(F.col("structural_unit_id").alias("unit_id"), _name(F.col("source_key")).alias("name"), F.when(authority.isin(*AUTHORITIES), authority).alias("authority"))
        .distinct()
    )
    units = table(spark, folder, "structural_unit").where(F.col("unit_id").isNotNull()).groupBy("unit_id").agg(F.min("document_version_id").alias("document_version_id"))
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    placed = stated.join(units, "unit_id").join(versions.select("document_version_id", lang.alias("lang"), "own"), "document_version_id").join(by_name, "name", "left")
    source = F.coalesce("named", "own")
    return placed.select("unit_id", source["source_key"].alias("source_key"), "lang", F.coalesce("authority", source["source_authority"]).alias("authority")).distinct()


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    """Each unit once, with its tokens and its slice; of several statements the smallest stands."""
    slices = unit_slices(spark, folder).groupBy("unit_id").agg(F.min(F.struct("source_key", "authority", "lang")).alias("s"), F.collect_set(F.struct("source_key", "lang", "authority")).alias("all"))
    texts = table(spark, folder, "structural_unit").select("unit_id", "text").join(slices.select("unit_id"), "unit_id", "left_semi")
    counted = count_tokens(texts, f"{TOKENIZERS}/piece_bpe_32k.model").groupBy("unit_id").agg(F.max("tokens").alias("tokens"), F.max("n_chars").alias("n_chars"))
    return counted.join(slices, "unit_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Slices with at least one unit that has a candidate row."""
    slices = _counted(spark, folder).select(F.explode("all").alias("s"), "tokens").groupBy("s").agg(F.count("tokens").alias("units"), F.sum("tokens").alias("tokens"))
    return slices.where("units > 0").select("s.source_key", "s.lang", "s.authority")


def p5_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Units, characters and tokens of each slice, each unit counted once."""
    return (
        _counted(spark, folder)
        .groupBy("s.source_key", "s.lang", "s.authority")
        .agg(F.count("*").alias("units"), F.sum("n_chars").alias("n_chars"), F.sum("tokens").alias("tokens"))
    )


SQL = {
    "p5_found": r"""
WITH src AS (SELECT source_id, source_key, authority FROM legal_source),
c AS (SELECT DISTINCT structural_unit_id AS unit_id, regexp_replace(lower(trim(coalesce(source_key, ''))), '[^a-z0-9]+', '-', 'g') AS name,
        CASE WHEN lower(trim(authority)) IN ('law', 'guidance', 'code') THEN lower(trim(authority)) END AS authority FROM candidate),
u AS (SELECT DISTINCT unit_id, document_version_id FROM structural_unit)
SELECT DISTINCT coalesce(n.source_key, o.source_key) AS source_key, lower(substr(trim(v.lang), 1, 2)) AS lang,
       coalesce(c.authority, n.authority, o.authority) AS authority
FROM c JOIN u USING (unit_id) JOIN document_version v USING (document_version_id) LEFT JOIN src o USING (source_id) LEFT JOIN src n ON n.source_key = c.name
"""
}
QUERIES = {"p5_found": p5_found, "p5_tokens": p5_tokens}

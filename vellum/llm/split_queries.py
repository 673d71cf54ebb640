"""Queries for splitting oversized texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.split import split_all, split_long
from vellum.sources.tables import table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "structural_unit").select(F.lit("structural_unit").alias("tbl"), F.col("unit_id").alias("record_id"), "text")
    parsed = table(spark, folder, "parsed_unit").select(F.lit("parsed_unit").alias("tbl"), F.col("parsed_id").alias("record_id"), "text")
    return stored.unionByName(parsed)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records above the limit with the first kind of break at which they fit it."""
    return split_long(_texts(spark, folder)).where("piece_no = 0").select("tbl", "record_id", "boundary").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All texts as ordered pieces."""
    return split_all(_texts(spark, folder))


SQL = {
    "p1_found": r"""
WITH t AS (
  SELECT DISTINCT 'structural_unit' AS tbl, unit_id AS record_id, text FROM structural_unit WHERE length(text) > 2000
  UNION SELECT DISTINCT 'parsed_unit', parsed_id, text FROM parsed_unit WHERE length(text) > 2000
), m AS (
  SELECT tbl, record_id,
    list_max(list_transform(regexp_split_to_array(text, '\r?\n(?:[ \t]*\r?\n)+'), lambda s: length(trim(s, ' ' || chr(9) || chr(10) || chr(13))))) AS paragraph,
    list_max(list_transform(regexp_split_to_array(text, '\r?\n'), lambda s: length(trim(s, ' ' || chr(9) || chr(10) || chr(13))))) AS line,
    list_max(list_transform(regexp_split_to_array(regexp_replace(text, '([.;:!?])[ \t\r\n]+', '\1' || chr(10), 'g'), '\r?\n'), lambda s: length(trim(s, ' ' || chr(9) || chr(10) || chr(13))))) AS sentence,
    list_max(list_transform(regexp_split_to_array(text, '[ \t\r\n]+'), lambda s: length(s))) AS word
  FROM t)
SELECT DISTINCT tbl, record_id, CASE WHEN paragraph <= 2000 THEN 'paragraph' WHEN line <= 2000 THEN 'line' WHEN sentence <= 2000 THEN 'sentence' WHEN word <= 2000 THEN 'word' ELSE 'none' END AS boundary
FROM m
"""
}
QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}

"""Queries for parent-child links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.hierarchy import all_ancestors, descendants, hierarchy, links_by_id, links_by_path
from vellum.sources.tables import table


def _links(spark: SparkSession, folder: str) -> DataFrame:
    stored = links_by_id(table(spark, folder, "structural_unit"), "structural_unit", "unit_id", "document_version_id", "parent_id", "unit_path")
    parsed = links_by_path(table(spark, folder, "parsed_unit"), "parsed_unit", "parsed_id", "document_version_id", "parent_path", "unit_path")
    return stored.unionByName(parsed)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Units without a root, and why."""
    found = hierarchy(_links(spark, folder), paths=False).where(F.col("state") != "rooted")
    return found.select(F.col("space").alias("tbl"), F.col("node").alias("record_id"), "state")


def p3_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Each unit with its full path, depth, root, ancestors and number of descendants."""
    found = hierarchy(_links(spark, folder))
    return found.select(F.col("space").alias("tbl"), F.col("node").alias("record_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", "path", all_ancestors().alias("ancestors"), "n_descendants", "state", "closes_cycle")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """One row per unit and descendant."""
    found = descendants(hierarchy(_links(spark, folder)))
    return found.select(F.col("space").alias("tbl"), F.col("ancestor").alias("ancestor_id"), F.col("node").alias("record_id"), "distance")


_LINKS_SQL = """
WITH RECURSIVE s AS (
  SELECT unit_id AS node, min(document_version_id) AS scope, min(nullif(parent_id, 0)) AS stated FROM structural_unit GROUP BY unit_id
), p AS (
  SELECT parsed_id AS node, min(document_version_id) AS scope,
         min(regexp_replace(upper(regexp_replace(trim(coalesce(parent_path, ''), ' ' || chr(9) || chr(10) || chr(13)), '^/+|/+$', '', 'g')), '/+', '/', 'g')) AS stated,
         min(regexp_replace(upper(regexp_replace(trim(coalesce(unit_path, ''), ' ' || chr(9) || chr(10) || chr(13)), '^/+|/+$', '', 'g')), '/+', '/', 'g')) AS own
  FROM parsed_unit GROUP BY parsed_id
), known AS (SELECT scope, own, min(node) AS node FROM p WHERE own <> '' GROUP BY scope, own),
links AS (
  SELECT 'structural_unit' AS tbl, s.node, q.node AS parent, s.stated IS NOT NULL AND q.node IS NULL AS dangling
  FROM s LEFT JOIN s q ON q.node = s.stated AND q.scope = s.scope
  UNION ALL
  SELECT 'parsed_unit', p.node, k.node, p.stated <> '' AND k.node IS NULL
  FROM p LEFT JOIN known k ON k.own = p.stated AND k.scope = p.scope
), up AS (
  SELECT tbl, node, parent AS above, 1 AS n FROM links WHERE parent IS NOT NULL
  UNION
  SELECT up.tbl, up.node, l.parent, up.n + 1 FROM up JOIN links l ON l.tbl = up.tbl AND l.node = up.above
  WHERE l.parent IS NOT NULL AND up.above <> up.node AND up.n < 500
), ring AS (SELECT DISTINCT tbl, node FROM up WHERE above = node)
"""

SQL = {
    "p3_found": _LINKS_SQL
    + """
SELECT l.tbl, l.node AS record_id,
       CASE WHEN r.node IS NOT NULL THEN 'cycle'
            WHEN EXISTS (SELECT 1 FROM up JOIN ring g ON g.tbl = up.tbl AND g.node = up.above WHERE up.tbl = l.tbl AND up.node = l.node) THEN 'below_cycle'
            ELSE 'orphan' END AS state
FROM links l LEFT JOIN ring r ON r.tbl = l.tbl AND r.node = l.node
WHERE r.node IS NOT NULL OR l.dangling
   OR EXISTS (SELECT 1 FROM up JOIN ring g ON g.tbl = up.tbl AND g.node = up.above WHERE up.tbl = l.tbl AND up.node = l.node)
   OR EXISTS (SELECT 1 FROM up JOIN links o ON o.tbl = up.tbl AND o.node = up.above AND o.dangling WHERE up.tbl = l.tbl AND up.node = l.node)
""",
    "p3_descendants": _LINKS_SQL
    + """
SELECT tbl, above AS ancestor_id, node AS record_id, min(n) AS distance FROM up WHERE above <> node GROUP BY ALL
""",
}
QUERIES = {"p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants}

"""Immutable versions: latest, activation, change detection, content-addressed reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order columns of each group, nulls smallest."""
    rest = [c for c in df.columns if c not in (*by, *order)]
    return df.groupBy(*by).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*by, "r.*")


def consolidated(versions: DataFrame, sources: DataFrame, replaced: int = 1) -> DataFrame:
    """The newest consolidated version of each source: its number starts with 0 in place of the
    base's first `replaced` characters. Sources without a base number have none."""
    based = sources.where("celex_base is not null and celex_base <> ''").select("source_id", "celex_base")
    own = versions.join(based, "source_id").where(F.startswith(F.col("celex"), F.concat(F.lit("0"), F.substr("celex_base", F.lit(replaced + 1)))))
    return latest(own.select("source_id", F.coalesce("doc_date", F.lit("0001-01-01").cast("date")).alias("doc_date"), "celex", "document_version_id"), ["source_id"], ["doc_date", "celex"])


def activate(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """A new snapshot in which each chosen version is active and its source's active ones are superseded by it."""
    new = chosen.select("source_id", F.col("document_version_id").alias("new_id")).dropDuplicates(["source_id"])
    joined = versions.join(new, "source_id", "left")
    becomes = F.col("document_version_id") == F.col("new_id")
    leaves = F.col("new_id").isNotNull() & ~becomes & (F.col("status") == "active")
    status = F.when(becomes, "active").when(leaves, "superseded").otherwise(F.col("status"))
    return joined.select("document_version_id", "source_id", status.alias("status"), F.when(leaves, F.col("new_id")).when(becomes, None).otherwise(F.col("superseded_by")).alias("superseded_by"))


def changes(active: DataFrame, seen: DataFrame, by: str, mark: str) -> DataFrame:
    """(by, outcome) of a check: new_version if nothing is active or the mark differs, else unchanged."""
    known = active.select(by, F.col(mark).alias("old")).dropDuplicates([by])
    return seen.join(known, by, "left").select(by, F.when(F.col("old").eqNullSafe(F.col(mark)), "unchanged").otherwise("new_version").alias("outcome"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All incoming rows, and the stored ones without an incoming row of their key."""
    return incoming.unionByName(stored.join(incoming.select(key), key, "left_anti"))


def embed_plan(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(total, cached, to_embed): rows, rows whose text is cached, and distinct texts that are not."""
    marked = texts.where("text is not null").select(F.sha2("text", 256).alias("sha")).join(cache.select("sha").distinct().withColumn("hit", F.lit(True)), "sha", "left")
    return marked.agg(F.count("*").alias("total"), F.count_if(F.col("hit")).alias("cached"), F.count_distinct(F.when(F.col("hit").isNull(), F.col("sha"))).alias("to_embed"))


def new_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts that the cache lacks: (sha, text)."""
    hashed = texts.where("text is not null").select(F.sha2("text", 256).alias("sha"), "text")
    return hashed.join(cache.select("sha").distinct(), "sha", "left_anti").dropDuplicates(["sha"])

"""Ingestion as dataflow: lines, headings, units, breadcrumbs, chunks, and what has to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import classify_heading, estimate_tokens
from vellum.operators.structure import fitting_pieces, greedy_chunks

# Unit types that are embedded; smallest own text of a container; chunk target.
EMBEDDED = ("article", "annex", "recital", "section", "chapter")
CONTAINER_TOKENS, TARGET = 60, 500
# Lines that are page numbers, marker lines, or table-of-contents rows.
NOISE = (r"^\s*\d{1,3}\s*$", r"^[▲▼►◄]\s*[BM]\d*\s*$", r"\.{4,}\s*\d+\s*$")
LEVELS = ("annex", "chapter", "section", "article")


def clean_lines(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): trimmed non-empty lines that are no noise. Null texts give no line."""
    lines = pages.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))
    kept = lines.withColumn("line", F.regexp_replace("line", r"^[\s\x0B\p{Z}]+|[\s\x0B\p{Z}]+$", "")).where("line <> ''")
    for pattern in NOISE:
        kept = kept.where(~F.col("line").rlike(pattern))
    return kept


def join_lines(lines: Column) -> Column:
    """Lines as one text; a line that ends in a soft hyphen is glued to the next."""
    return F.regexp_replace(F.array_join(lines, "\n"), "\u00ad\n", "")


def units_from_lines(lines: DataFrame, key: str) -> DataFrame:
    """(key, unit_no, unit_type, unit_number, heading, text): each heading line opens a unit, up to the next.

    Lines before the first heading are unit 0 without type. A document without headings is one unit.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("h", classify_heading(F.col("line"))).withColumn("unit_no", F.count("h.type").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = marked.groupBy(key, "unit_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "h"))).alias("ls"))
    first = F.col("ls")[0]["h"]
    named = first["type"].isNotNull()
    body = F.transform(F.when(named, F.slice("ls", 2, 1_000_000_000)).otherwise(F.col("ls")), lambda x: x["line"])
    return grouped.select(key, "unit_no", first["type"].alias("unit_type"), first["number"].alias("unit_number"), F.when(named, first["heading"]).alias("heading"), join_lines(body).alias("text"))


def glossary(lines: DataFrame, key: str, separator: str = "\t") -> DataFrame:
    """(key, term, meaning) of two-column rows; a row without term continues the meaning above it."""
    parts = F.split("line", separator, 2)
    term = F.nullif(F.trim(parts[0]), F.lit(""))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(F.contains(F.col("line"), F.lit(separator))).select(key, "line_no", term.alias("own"), F.trim(parts[1]).alias("part"))
    owned = rows.withColumn("n", F.count("own").over(order)).where("n > 0")
    grouped = owned.groupBy(key, "n").agg(F.max("own").alias("term"), F.array_sort(F.collect_list(F.struct("line_no", "part"))).alias("ps"))
    return grouped.select(key, "term", F.array_join(F.transform("ps", lambda p: p["part"]), " ").alias("meaning"))


def breadcrumbs(units: DataFrame, ancestors: DataFrame, titles: DataFrame) -> DataFrame:
    """(unit_id, breadcrumb): title - labels of ancestors and unit - nearest heading; a context, where given, stands for the labels.

    `units`: unit_id, document_version_id, unit_type, unit_number, heading, context; `ancestors`:
    unit_id, ancestor, depth; `titles`: document_version_id, title.
    """
    label = F.when(F.col("unit_number").isNotNull() & F.col("unit_type").isin(*LEVELS, "recital", "paragraph"), F.concat(F.initcap("unit_type"), F.lit(" "), F.col("unit_number")))
    own = units.select("unit_id", label.alias("label"), F.nullif(F.trim("heading"), F.lit("")).alias("heading"))
    chain = ancestors.select("unit_id", "ancestor", "depth").unionByName(units.select("unit_id", F.col("unit_id").alias("ancestor"), F.lit(1_000_000).alias("depth")))
    named = chain.join(own.withColumnRenamed("unit_id", "ancestor"), "ancestor").groupBy("unit_id").agg(
        F.array_sort(F.collect_list(F.struct("depth", "ancestor", "label"))).alias("ls"), F.max(F.when(F.col("heading").isNotNull(), F.struct("depth", "heading"))).alias("h")
    )
    labels = F.array_join(F.filter(F.transform("ls", lambda x: x["label"]), lambda x: x.isNotNull()), ", ")
    full = units.select("unit_id", "document_version_id", F.nullif(F.trim("context"), F.lit("")).alias("context")).join(named, "unit_id").join(titles, "document_version_id", "left")
    return full.select("unit_id", F.concat_ws(" - ", "title", F.nullif(F.coalesce("context", labels), F.lit("")), F.col("h.heading")).alias("breadcrumb"))


def select_units(units: DataFrame, pairs: DataFrame, types: list[str]) -> DataFrame:
    """Units of the given types, and all their ancestors. `pairs`: unit_id, ancestor."""
    chosen = units.where(F.col("unit_type").isin(types)).select("unit_id")
    above = pairs.join(chosen, "unit_id", "left_semi").select(F.col("ancestor").alias("unit_id"))
    return units.join(chosen.unionByName(above).distinct(), "unit_id", "left_semi")


def chunk_units(units: DataFrame) -> DataFrame:
    """(unit_id, chunk_no, text, tokens): chunks of embeddable units, packed from their paragraphs.

    A unit's pieces are its own text and then its paragraphs in order, oversize ones cut by paragraph,
    line, sentence and word, so that no chunk passes TARGET. Containers that have children
    other than paragraphs and fewer than CONTAINER_TOKENS of own text give no chunk.
    """
    cost = estimate_tokens(F.col("text"))
    children = units.where("parent_id is not null").groupBy(F.col("parent_id").alias("unit_id")).agg(F.count("*").alias("children"), F.count_if(F.col("unit_type") == "paragraph").alias("paragraphs"))
    hosts = units.where(F.col("unit_type").isin(*EMBEDDED)).join(children, "unit_id", "left").where(~((F.coalesce("children", F.lit(0)) > 0) & (F.coalesce("paragraphs", F.lit(0)) == 0) & (cost < CONTAINER_TOKENS)))
    own = hosts.select("unit_id", F.lit(0).cast("bigint").alias("piece"), "text")
    paragraphs = units.where("unit_type = 'paragraph'").select(F.col("parent_id").alias("unit_id"), (F.col("ordinal").cast("bigint") * 1_000_000_000 + F.col("unit_id")).alias("piece"), "text").join(hosts.select("unit_id"), "unit_id", "left_semi")
    pieces = own.unionByName(paragraphs).where("trim(text) <> ''")
    pieces = pieces.select("unit_id", "piece", F.posexplode(fitting_pieces(F.col("text"), TARGET)).alias("part", "text")).select("unit_id", F.struct("piece", "part").alias("piece"), "text").withColumn("tokens", cost)
    numbered = greedy_chunks(pieces, "unit_id", "piece", "tokens", TARGET).select("unit_id", "piece", "chunk_no")
    packed = pieces.join(numbered, ["unit_id", "piece"]).groupBy("unit_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("ps"), F.sum("tokens").alias("tokens"))
    return packed.select("unit_id", "chunk_no", F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n").alias("text"), "tokens")


def ingest_plan(fetched: DataFrame, stored: DataFrame, counts: DataFrame) -> DataFrame:
    """(source_id, action): up_to_date if the active version has the fetched hash and has units, else ingest.

    `fetched`: source_id, sha; `stored`: source_id, document_version_id, sha of active versions;
    `counts`: document_version_id, n.
    """
    known = stored.join(counts, "document_version_id", "left").select("source_id", F.col("sha").alias("old"), F.coalesce("n", F.lit(0)).alias("n"))
    return fetched.join(known, "source_id", "left").select("source_id", F.when((F.col("old") == F.col("sha")) & (F.col("n") > 0), "up_to_date").otherwise("ingest").alias("action"))


def zip_strict(drafts: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Drafts with their vectors by position; a draft or vector left over is an error when the rows are read."""
    joined = drafts.withColumn("_d", F.lit(True)).join(vectors.withColumn("_v", F.lit(True)), key, "full")
    fault = F.raise_error(F.concat(F.lit("drafts and vectors differ at "), F.col(key).cast("string"))).cast("boolean")
    return joined.where(F.when(F.col("_d") & F.col("_v"), F.lit(True)).otherwise(fault)).drop("_d", "_v")

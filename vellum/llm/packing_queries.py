"""Queries for filled containers."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.bpe import Encoder
from vellum.llm.packing import CAPACITY, fill_containers
from vellum.session import Cuts
from vellum.sources.tables import table

TOKENIZERS = os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers")


def sized(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, tokens, source, cluster): sizes by the tokenizer; documents of one cluster have the
    same letters and digits in the same order, whatever their case, spacing and punctuation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kept = Encoder(path), re.compile(r"[\W_]+").sub
        for batch in batches:
            texts = batch.column(2).to_pylist()
            tokens = [encoder.count(t) for t in texts]
            clusters = []
            for t in texts:
                letters = kept("", t.lower()) if t else ""
                clusters.append(xxhash.xxh3_64_intdigest(letters.encode("utf-8", "surrogatepass")) - (1 << 63) if letters else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int32()), batch.column(1), pa.array(clusters, pa.int64())], names=["doc_id", "tokens", "source", "cluster"])

    return documents.select("doc_id", F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, tokens int, source string, cluster bigint")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or its pieces, in a container of 2,048 tokens."""
    items = Cuts(spark).cut(sized(table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))
    return fill_containers(items)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of the space that is used."""
    filled = p8_containers(spark, folder).where("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("tokens"))
    return filled.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * CAPACITY)).alias("used"))


def p8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, those that hold a source twice, and those that hold more than their capacity."""
    filled = p8_containers(spark, folder).where("container_id is not null").join(table(spark, folder, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id")
    per = filled.groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"), F.count_distinct("source").alias("sources"))
    return per.agg(F.count("*").alias("containers"), F.count_if(F.col("items") > F.col("sources")).alias("repeating"), F.count_if(F.col("tokens") > CAPACITY).alias("over"))


SQL: dict[str, str] = {}
QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_repeats": p8_repeats}

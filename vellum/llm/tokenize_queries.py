"""Queries for the encoded corpus."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.bpe import encode
from vellum.sources.tables import table

TOKENIZERS = os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of each document."""
    return encode(table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


SQL: dict[str, str] = {}
QUERIES = {"p7_ids": p7_ids}

"""File sources and sinks: documents as bytes, JSON query results, YAML cases, manifests, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_documents(spark: SparkSession, pattern: str, magic: bytes = b"%PDF-") -> DataFrame:
    """(path, name, size, sha256, valid, content) of files; valid: the content begins with `magic`."""
    files = spark.read.format("binaryFile").load(pattern)
    head = F.substring(F.col("content"), 1, len(magic))
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), (head == F.lit(magic)).alias("valid"), "content")


def missing(wanted: DataFrame, landed: DataFrame, key: str = "name") -> DataFrame:
    """Read-through cache: what is wanted and not landed yet."""
    return wanted.join(landed.select(key), key, "left_anti")


def query_results(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """Rows of SPARQL JSON result files; an unbound variable is null."""
    schema = "results struct<bindings: array<struct<" + ", ".join(f"`{c}`: struct<value: string>" for c in columns) + ">>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).select(F.explode("results.bindings").alias("b"))
    return rows.select(*(F.col(f"b.{c}.value").alias(c) for c in columns))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of one YAML file, a list of mappings. A case file is small by nature."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    rows = [(c["id"], c.get("category"), c["question"], c.get("expected_articles") or [], c.get("expected_annexes") or [], bool(c.get("should_abstain"))) for c in yaml.safe_load(text) or []]
    return spark.createDataFrame(rows, "id string, category string, question string, expected_articles array<string>, expected_annexes array<string>, should_abstain boolean")


def write_manifest(documents: DataFrame, path: str) -> None:
    """One JSON line per document, without its content."""
    documents.drop("content").write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Append to an audit table; rows keep their day as partition when they have asked_at."""
    if "asked_at" in rows.columns:
        rows.withColumn("day", F.to_date("asked_at")).write.mode("append").partitionBy("day").parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def publish(rows: DataFrame, root: str) -> str:
    """Write a new immutable snapshot, then swap the pointer file to it. Readers use `current`.

    A failed write leaves the pointer, and so the active snapshot, as it was."""
    spark = rows.sparkSession
    path = f"{root}/snapshot-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    jvm = spark._jvm
    pointer, staged = (jvm.org.apache.hadoop.fs.Path(f"{root}/{n}") for n in ("CURRENT", f"CURRENT-{uuid.uuid4().hex}"))
    files = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(staged, True)
    out.write(bytearray(path.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(staged, pointer, options)  # readers see the old pointer or the new one
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot that the pointer names."""
    return spark.read.parquet(spark.read.text(f"{root}/CURRENT").first()[0])


class Lock:
    """One writer per source: an exclusive file in the shared folder, named by the key's checksum; fails fast."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        import zlib

        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(f"{root}/lock-{zlib.crc32(key.encode()):08x}")
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def __enter__(self):
        if not self.files.createNewFile(self.path):
            raise RuntimeError("another ingestion of this source is running")
        return self

    def __exit__(self, *_):
        self.files.delete(self.path, False)

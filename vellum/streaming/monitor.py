"""Streaming counterparts: daily counts, and a sliding-window load per model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW_SECONDS = 60


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A file stream over one table, with its time as an instant."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path if path.endswith("*") else _files(spark, path))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _files(spark: SparkSession, path: str) -> str:
    """A stream reads folders: a single file is given as a pattern that matches only it."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    is_file = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    return path[:-1] + "[t]" if is_file else path


def daily_counts(stream: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Events per UTC day and type."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def run_to_table(stream: DataFrame, spark: SparkSession, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return the result table, which lies beside the checkpoint.

    In complete mode every batch replaces the table; in append mode a batch is one folder, so that a
    batch that is run again after a failure replaces its own rows."""
    root = checkpoint.rstrip("/") + "-result"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{root}/batch=-1")

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/batch={batch if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(root).select(*stream.columns)


def window_load(stream: DataFrame, key: str = "event_type") -> DataFrame:
    """Per event the number of events of its key in the last 60 seconds, from state that keeps only those.

    Events of a key have to arrive in order of time within a batch's sorting; older ones see what is left.
    """
    output = T.StructType([T.StructField(key, T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("load", T.IntegerType())])
    state = T.StructType([T.StructField("times", T.ArrayType(T.LongType()))])

    def step(group, frames, kept):
        import pandas as pd

        times = list(kept.get[0]) if kept.exists else []
        rows = pd.concat(list(frames)).sort_values("ts")
        loads = []
        for at in rows["ts"].astype("int64") // (1000 if rows["ts"].dtype == "datetime64[ns]" else 1):
            times = [t for t in times if t >= at - WINDOW_SECONDS * 1_000_000] + [int(at)]
            loads.append(len(times))
        kept.update((times,))
        yield pd.DataFrame({key: group[0], "ts": rows["ts"].values, "load": loads})

    return stream.groupBy(key).applyInPandasWithState(step, output, state, "append", "NoTimeout")

"""Spark session, and the shared folder in which long plans are cut."""

from __future__ import annotations

import atexit
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in local tests.
LOCAL_SHARED = "file:///tmp/vellum-shared"


def local_session(cores: str = "8", app: str = "vellum", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir), or a local one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_SHARED


class Cuts:
    """Tables written to the shared folder to cut lineage; a lost executor costs only a re-read.

    `keep` bounds how many of the newest tables stay on disk while a loop runs.
    """

    def __init__(self, spark: SparkSession, keep: int | None = None):
        self.spark, self.keep, self.paths = spark, keep, []
        self.root = f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        self.paths.append(path)
        if self.keep is not None and len(self.paths) > self.keep:
            self.drop(self.paths[-self.keep - 1])
        return self.spark.read.schema(schema).parquet(path)

    def clear(self) -> None:
        """Remove all tables; at the end of the session at the latest."""
        try:
            self.drop(self.root)
        except Exception:  # the session is gone
            pass

    def drop(self, path: str) -> None:
        hadoop, files = _path(self.spark, path)
        files.delete(hadoop, True)


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def sweep(spark: SparkSession, hours: float = 48.0) -> int:
    """Remove cut tables that killed drivers left in the shared folder longer ago than that; how many there were."""
    root, files = _path(spark, shared_dir(spark))
    if not files.exists(root):
        return 0
    stale = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("vellum-") and s.getModificationTime() < (time.time() - hours * 3600) * 1000]
    for path in stale:
        files.delete(path, True)
    return len(stale)

"""A folder of one's own where driver and executors share files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; only in local mode a temporary folder takes the place of a missing setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lexloom-"))
    return f"{root.rstrip('/')}/lexloom/{label}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """Tables of one job in a folder of its own, as compressed Parquet, so that later steps read only the columns they use."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, shared_folder(spark, label)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return a reader of the written table."""
        df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self) -> None:
        """Delete all tables; only when no open result reads them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

"""Shared pieces of the training-data operators: scratch tables and text expressions."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only in local mode, where one machine does everything, a temporary folder takes the place of a missing setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return _own_root[app]


class Scratch:
    """Tables that one operator call writes to the shared folder, so that lineage ends there."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/lexloom/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return a reader of the written table."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them; only for tables that no open result reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def share(spark: SparkSession, model: Any) -> Callable[[], Any]:
    """A getter for use on workers. A worker unpacks the model once and keeps it, with its caches, for later tasks;
    when it meets another model it lets go of the one before, so that a long-lived worker holds one at most."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    name = uuid.uuid4().hex

    def get() -> Any:
        # the function travels by value, so what outlasts a task lives in a module of its own
        held = sys.modules.setdefault("_lexloom_worker", types.ModuleType("_lexloom_worker")).__dict__
        if held.get("name") != name:
            held.pop("model", None)
            held["model"], held["name"] = cloudpickle.loads(shared.value), name
        return held["model"]

    return get


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches that pass to Python hold at most this many rows: with whole texts the usual 10 000 take some hundred MB of each task in both processes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; all-ASCII texts take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def word_count(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text has this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))

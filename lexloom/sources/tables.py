"""Readers of the table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows of a batch that passes to Python; whole texts make the usual 10 000 too large for several tasks in one executor.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over several tasks a core: a table of narrow columns is one small file, hence one task, whatever the work on each of its rows.

    Only for the few columns that the work reads, before it.
    """
    return df.repartition(4 * max(2, df.sparkSession.sparkContext.defaultParallelism))

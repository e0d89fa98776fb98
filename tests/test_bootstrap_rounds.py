"""The registered bootstrap runs as many rounds as the engine's constant says."""

from pyspark.sql import functions as F

from lexloom import config
from lexloom.operators import evaluation as E
from lexloom.plans import catalog


def test_paired_bootstrap_runs_all_rounds(spark, tmp_path):
    labels = spark.createDataFrame([(i, int(i * 7919 % 5 < 3)) for i in range(40)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    pairs = labels.select("doc_id", (F.col("quality") * 0.9).alias("a"), (F.col("doc_id") % 7 / 7.0).alias("b"))
    got, want = (df.first().asDict() for df in (catalog.QUERIES["paired_bootstrap"](spark, str(tmp_path)), E.paired_bootstrap(pairs, "doc_id", "a", "b", rounds=config.BOOTSTRAP_ROUNDS)))
    assert all(abs(got[c] - want[c]) < 1e-6 for c in ("low", "high")) and config.BOOTSTRAP_ROUNDS == 10_000

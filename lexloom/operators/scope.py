"""Scope of a question: documents of one owner. There is no way to search everything."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.sources.scratch import Scratch


@dataclass(frozen=True)
class Scope:
    """Refuses to exist without documents or without an owner."""

    doc_ids: tuple
    owner_id: str

    def __post_init__(self) -> None:
        object.__setattr__(self, "doc_ids", tuple(self.doc_ids))
        if not self.doc_ids:
            raise ValueError("a scope needs at least one document")
        if not self.owner_id:
            raise ValueError("a scope needs an owner")

    def contains(self, doc_id) -> bool:
        return doc_id in self.doc_ids

    def frame(self, spark: SparkSession, id_type: str = "long") -> DataFrame:
        return spark.createDataFrame([(d, self.owner_id) for d in self.doc_ids], f"doc_id {id_type}, owner_id string")

    def rows(self, df: DataFrame) -> DataFrame:
        """Rows of df whose document and owner are in scope."""
        return df.join(self.frame(df.sparkSession, df.schema["doc_id"].dataType.simpleString()), ["doc_id", "owner_id"], "left_semi")


def requested(ids: Column, corpus: Column) -> Column:
    """The requested ids that the corpus has; the whole corpus where it has none of them."""
    common = F.array_intersect(ids, corpus)
    return F.when(F.coalesce(F.size(common), F.lit(0)) > 0, common).otherwise(corpus)


def searchable(chunks: DataFrame, owner: str, indexed: str = "bm25_indexed") -> DataFrame:
    """An owner's indexed chunks, or all of them where none is indexed. One flag per owner moves, not the chunks."""
    some = chunks.groupBy(F.col(owner).alias("__owner")).agg(F.max(indexed).alias("__some"))
    some = Scratch(chunks.sparkSession, "scope").save(some, "owners")  # its measured size lets Spark broadcast it
    joined = chunks.join(some, F.col(owner).eqNullSafe(F.col("__owner")))
    return joined.where(F.col(indexed) | ~F.coalesce("__some", F.lit(False))).drop("__owner", "__some")


def in_order(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with their place in the document's own order."""
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])))

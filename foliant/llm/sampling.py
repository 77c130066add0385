"""A bounded sample of labelled rows, for the classifiers that learn from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import common

#: Labelled rows a classifier is fitted on, at most.
TRAIN_ROWS = 12_000
HELD_OUT = 2


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int = TRAIN_ROWS) -> DataFrame:
    """text, fold and the label columns of at most rows labelled documents outside the held-out fold, in the
    order of a hash of the id. Stored, since a fit reads it more than once.

    Null ids and null labels are left out; of repeated ids the largest label counts.
    """
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in columns])
    known = known.dropna().withColumn("fold", common.fold4("doc_id")).filter(F.col("fold") != HELD_OUT)
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    # at most rows ids and numbers: bounded by the parameter
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "fold", *columns))
    return common.store(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("text", "fold", *columns), "labelled")

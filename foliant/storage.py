"""Written tables that cut lineage, who deletes them, and numbering of sorted rows."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables that store() has written and nothing has deleted yet.
_STORED: list[DataFrame | Folder] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share, as spark.checkpoint.dir names it. Only where all run in one process, as in
    tests, it may be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return f"{tempfile.gettempdir()}/foliant-checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, nothing depends on an executor's disk. The table
    stays until discard(), or until the scratch() around the call ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/foliant/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _STORED.append(out)
    return out


class Folder:
    """A folder of its own in the shared one, for what a caller writes itself. Owned like a stored table."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.sparkSession = spark
        self.path = self._stored_at = f"{shared_dir(spark).rstrip('/')}/foliant/{name}-{uuid.uuid4().hex}"
        _STORED.append(self)


def discard(df: DataFrame | Folder | None) -> None:
    """Delete a table that store() wrote, once nothing reads it any more; other tables are left alone."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _STORED[:] = [x for x in _STORED if x._stored_at != path]


def stored_paths() -> list[str]:
    """Folders of the tables that are stored now."""
    return [x._stored_at for x in _STORED]


@contextlib.contextmanager
def scratch(keep: Callable[[], DataFrame | None] = lambda: None) -> Iterator[None]:
    """Owns what store() writes inside: it goes at the end, also after an error, but for the table that keep() gives.
    Around a query and the writing or collecting of its rows it leaves no table behind."""
    before = set(stored_paths())
    kept = None
    try:
        yield
        kept = getattr(keep(), "_stored_at", None)
    finally:
        for x in [x for x in _STORED if x._stored_at not in before and x._stored_at != kept]:
            discard(x)


def discard_all() -> None:
    """Delete every table that store() has written; for callers that have written a query's rows."""
    for x in list(_STORED):
        discard(x)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name: 1 for the first row of the order, and so on, without any task that sees all rows.

    A range-partitioned sort is written once, each row with its partition and its place in that; the sizes of the
    partitions before lift the places. Sizes and places are of the same written rows, so they agree."""
    sorted_ = df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    placed = store(sorted_, "sorted")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # a row per partition of the sort
    offsets = F.broadcast(sizes.select(F.col("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")))
    return placed.join(offsets, "_p").withColumn(name, F.col("_k") + F.col("_o") + 1).drop("_p", "_k", "_o")

"""Helpers the operators share: tables and batch-wise mapping; stored tables are those of the library."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.storage import discard, discard_all, scratch, shared_dir, store, stored_paths

__all__ = ["discard", "discard_all", "scratch", "shared_dir", "store", "stored_paths"]

#: Rows handled at once inside a Python worker; bounds its memory beside one Arrow batch.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_slices(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over bounded slices. fn gets a RecordBatch of df and yields RecordBatches in the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield from fn(batch.slice(at, SLICE_ROWS))

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces_of(df: DataFrame) -> int:
    """Input splits of df, a measure of its size that costs no job."""
    return max(1, df.rdd.getNumPartitions())


def bytes_of(df: DataFrame) -> int:
    """Bytes of the files that df reads, as its plan has them; costs no job. 0 for what is no file or of unknown size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def fold4(column) -> F.Column:
    """crc32 of the id's decimal text, mod 4: the fold by which labelled rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now rather than at its next collection."""
    gc.collect()
    spark._jvm.System.gc()

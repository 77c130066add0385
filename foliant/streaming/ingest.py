"""Import of files as they arrive: a stateful stream that keeps what importing them batch by batch would keep.

Two states follow each other. By the hash of its bytes a file is new or known; known ones are skipped, whatever they are
called. By its work a new file takes its place: files of a work's first batch replace each other format by format, later ones
attach where the work has no file of their format, and otherwise become versions or, without keep_both, replace the first.
State is the owner of each hash and the last version of each work's formats, so a batch costs what it brings. Changes are
appended under the number of their batch, which a replay after a failure writes again in the same place.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliant.plans import ingest

FILE = "path string, modificationTime timestamp, length bigint, content binary"
#: A file on its way; seq is its batch and path, by which files of a batch are ordered.
ARRIVED = "group_key string, title string, format_class string, format_detail string, file_hash string, path string, size_bytes long, word_count long"
CHANGED = f"{ARRIVED}, action string, version int, place int"
#: State stores of these processors; Spark's default store does not hold several states for a key.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Files of one key in a batch, by path."""
    return pd.concat(list(parts), ignore_index=True).sort_values("path", kind="stable")


class ByHash(StatefulProcessor):
    """Passes the first file of each content; others are skipped, with the group of the first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "group_key string, title string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        files = in_order(rows)
        known = self.owner.exists()
        if not known:
            first = files.iloc[0]
            self.owner.update((first["group_key"], first["title"]))
        group, title = self.owner.get()
        yield files.assign(group_key=group, title=title, action=["skipped_duplicate" if known or k else "new" for k in range(len(files))])

    def close(self) -> None:
        pass


class ByWork(StatefulProcessor):
    """Gives each new file of a work its version."""

    def __init__(self, keep_both: bool) -> None:
        self.keep_both = keep_both

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "format_detail string", "version int")
        self.known = handle.getValueState("known", "files long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        files = in_order(rows)
        had = self.known.get()[0] if self.known.exists() else 0
        actions, versions, stored = [], [], 0
        for detail, skipped in zip(files["format_detail"], files["action"] == "skipped_duplicate", strict=True):
            if skipped:
                actions.append("skipped_duplicate")
                versions.append(None)
                continue
            stored += 1
            last = self.last.getValue((detail,))[0] if self.last.containsKey((detail,)) else 0
            if not had:
                action, version = "create_work", 1
            elif not last:
                action, version = "attach", 1
            else:
                action, version = ("keep_both", last + 1) if self.keep_both else ("replace", 1)
            self.last.updateValue((detail,), (max(last, version),))
            actions.append(action)
            versions.append(version)
        self.known.update((had + stored,))
        yield files.assign(action=actions, version=pd.array(versions, "Int32"), place=range(1, len(files) + 1))

    def close(self) -> None:
        pass


def changes(files: DataFrame, keep_both: bool = False) -> DataFrame:
    """A row for every file of the stream: what became of it, and its version. files: path, content."""
    found = ingest.group_key(ingest.inspect(files.select("path", "content")))
    title = F.coalesce("parsed.title", ingest.formats.stem(F.col("name")))
    arrived = found.select("group_key", title.alias("title"), F.col("format.class").alias("format_class"), F.col("format.detail").alias("format_detail"), "file_hash", "path", "size_bytes", "word_count")
    fresh = arrived.groupBy("file_hash").transformWithStateInPandas(statefulProcessor=ByHash(), outputStructType=f"{ARRIVED}, action string", outputMode="Append", timeMode="None")
    return fresh.groupBy("group_key").transformWithStateInPandas(statefulProcessor=ByWork(keep_both), outputStructType=CHANGED, outputMode="Append", timeMode="None")


def watch(spark: SparkSession, path: str, out: str, checkpoint: str, keep_both: bool = False, files_a_batch: int = 10_000):
    """Start a stream over the files that are or come below path. Changes go to the table out, a folder per batch; a
    batch that is replayed after a failure replaces its own folder. Ends when there are no more files. Bytes that were
    stored once are known for good, also after another file has replaced them."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").load(path)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(spark, *PROVIDER):
        return changes(files, keep_both).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextlib.contextmanager
def settings(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for a query that starts inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def versions(table: DataFrame) -> DataFrame:
    """The stored files after all changes: of each work, format and version the last; of a format the last one is current,
    the others are archived. table: as watch() writes it."""
    order = F.struct("batch", "path")
    stored = table.filter("action <> 'skipped_duplicate'")
    last = stored.groupBy("group_key", "format_detail", "version").agg(F.max_by(F.struct("title", "format_class", "file_hash", "path", "size_bytes", "word_count", "batch"), order).alias("f")).select("group_key", "format_detail", "version", "f.*")
    newest = F.max(order).over(Window.partitionBy("group_key", "format_detail"))
    return last.withColumn("role", F.when(order == newest, "current").otherwise("archived")).drop("batch")


def each_batch(spark: SparkSession, path: str, commit: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream over the files of path that hands each batch of (path, content) and its number to commit, for
    callers with a catalog of their own. Batches are numbered and replayed alike after a failure."""
    files = spark.readStream.format("binaryFile").schema(FILE).load(path).select("path", "content")
    return files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

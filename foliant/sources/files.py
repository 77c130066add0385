"""Files of a library as data sources: listing and reading whole files, and writing them in two phases.

library_listing lists files below the given paths: tasks walk a folder each, the driver looks only into as many folders
as give every task one. Names that begin with a dot are left out, and so is what lies in folders of such names, but
for paths that are named themselves; names that begin with an underscore are listed. read() groups listed files by their
bytes, so that no task reads much more than another, and gives path, content and error.

library_tree writes rows of rel_path and content as files, and library_lines rows of one string column as lines. Tasks write into
a draft folder beside the target, each file under a name of its own that is renamed when it is whole, so that a task that
runs twice leaves one file. The draft becomes the target by one rename when all tasks are done; if one fails it is removed.

Paths are local ones or URIs that pyarrow's file systems open; a cluster's tasks must all see them.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from foliant import storage

#: Folders that a listing is divided into, about, and bytes of files that a task reads, about.
LISTING_TASKS, TASK_BYTES = 64, 64 << 20
LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("error", pa.string())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def hidden(path: str) -> bool:
    return posixpath.basename(path.rstrip("/")).startswith(".")


def shown(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


@dataclass
class Folders(InputPartition):
    """Folders to walk, and paths that are listed as they are."""

    folders: list[str]
    files: list[str]


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library_listing"

    def schema(self) -> str:
        return "path string, length long, error string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(json.loads(self.options["paths"]), int(self.options.get("tasks", LISTING_TASKS)))


class ListingReader(DataSourceReader):
    def __init__(self, paths: list[str], tasks: int) -> None:
        self.paths, self.tasks = paths, tasks

    def partitions(self) -> list[InputPartition]:
        folders, files = [], []
        for path in dict.fromkeys(map(shown, self.paths)):
            system, at = opened(path)
            (folders if system.get_file_info(at).type == fs.FileType.Directory else files).append(path)
        # a level deeper while there are fewer folders than tasks
        while folders and len(folders) < self.tasks:
            below: list[str] = []
            for folder in folders:
                system, at = opened(folder)
                for info in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                    if not hidden(info.path):
                        (below if info.type == fs.FileType.Directory else files).append(info.path)
            folders = below
        own = [Folders([f], []) for f in folders]
        size = max(1, -(-len(files) // self.tasks))
        return own + [Folders([], files[k : k + size]) for k in range(0, len(files), size)] or [Folders([], [])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, int | None, str | None]] = []
        for path in partition.files:
            system, at = opened(path)
            info = system.get_file_info(at)
            found.append((path, info.size, None) if info.type == fs.FileType.File else (path, None, "no such file"))
        todo = list(partition.folders)
        while todo:
            system, at = opened(todo.pop())
            try:
                for info in system.get_file_info(fs.FileSelector(at)):
                    if hidden(info.path):
                        continue
                    if info.type == fs.FileType.Directory:
                        todo.append(info.path)
                    else:
                        found.append((info.path, info.size, None))
            except OSError as e:
                found.append((at, None, e.strerror or str(e)))
            if len(found) >= 10_000:
                yield self.batch(found)
                found = []
        yield self.batch(found)

    def batch(self, found: list) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LISTED, strict=True)], schema=LISTED)


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length and error of the files below paths, each once."""
    spark.dataSource.register(Listing)
    return spark.read.format("library_listing").option("paths", json.dumps(paths)).load().dropDuplicates(["path"])


def read(listing: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """path, content and error of listed files. Files are laid side by side in the order of their paths and cut into
    bins of task_bytes; a file that cannot be read has an error and no content."""
    placed = storage.store(listing.select("path", F.coalesce("length", F.lit(0)).alias("length"), "error").orderBy("path").withColumn("_p", F.spark_partition_id()), "listing")
    sizes = placed.groupBy("_p").agg(F.sum("length").alias("_n"))
    # a row per partition of the sort
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("length").over(Window.partitionBy("_p").orderBy("path"))
    bins = placed.withColumn("_in", inside).join(F.broadcast(before), "_p").withColumn("bin", F.floor((F.col("_in") + F.col("_before")) / F.lit(task_bytes)))
    n = bins.agg(F.count_distinct("bin")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for path, error in zip(batch["path"].to_pylist(), batch["error"].to_pylist(), strict=True):
                content = None
                if error is None:
                    try:
                        system, at = opened(path)
                        with system.open_input_stream(at, compression=None) as f:
                            content = f.read()
                    except OSError as e:
                        error = str(e)
                yield pa.RecordBatch.from_pydict({"path": [path], "content": [content], "error": [error]}, schema)

    return bins.repartitionByRange(max(n, 1), "bin").select("path", "error").mapInArrow(run, "path string, content binary, error string")


@dataclass
class Written(WriterCommitMessage):
    """How many files a task wrote; a number, however many they are."""

    files: int


class DraftWriter(DataSourceArrowWriter):
    """Writes below a draft that becomes the target at once. overwrite replaces a target, else one that exists fails."""

    def __init__(self, target: str, overwrite: bool) -> None:
        self.target, self.overwrite = shown(target).rstrip("/"), overwrite
        system, at = opened(self.target)
        if not overwrite and system.get_file_info(at).type != fs.FileType.NotFound:
            raise FileExistsError(f"{target} is there already")
        self.draft = posixpath.join(posixpath.dirname(self.target), f".{posixpath.basename(self.target)}.{uuid.uuid4().hex}")
        # made here, once; tasks make folders in it only, so one that runs on after abort() fails
        system.create_dir(opened(self.draft)[1])

    def put(self, system: fs.FileSystem, root: str, rel_path: str, content: bytes) -> None:
        whole = posixpath.normpath(posixpath.join(root, rel_path))
        if whole == root or not whole.startswith(root + "/"):
            raise ValueError(f"{rel_path} is outside the folder")
        folders = posixpath.relpath(posixpath.dirname(whole), root).split("/")
        for k in range(len(folders)) if folders != ["."] else ():
            system.create_dir(posixpath.join(root, *folders[: k + 1]), recursive=False)
        part = f"{whole}.{uuid.uuid4().hex}.part"
        try:
            with system.open_output_stream(part, compression=None) as f:
                f.write(content)
            system.move(part, whole)
        except BaseException:
            if system.get_file_info(part).type != fs.FileType.NotFound:
                system.delete_file(part)
            raise

    def commit(self, messages: list) -> None:
        system, draft = opened(self.draft)
        _, target = opened(self.target)
        if self.overwrite and system.get_file_info(target).type != fs.FileType.NotFound:
            old = f"{draft}.old"
            system.move(target, old)
            system.move(draft, target)
            system.delete_dir(old)
        else:
            system.move(draft, target)

    def abort(self, messages: list) -> None:
        system, draft = opened(self.draft)
        if system.get_file_info(draft).type != fs.FileType.NotFound:
            # out of the way of tasks that still write, and then deleted
            gone = f"{draft}.aborted"
            system.move(draft, gone)
            for _ in range(20):
                try:
                    system.delete_dir(gone)
                    return
                except OSError:
                    time.sleep(0.1)


class TreeWriter(DraftWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.draft)
        n = 0
        for batch in iterator:
            for rel_path, content in zip(batch["rel_path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if rel_path is None or content is None:
                    raise ValueError(f"a file without {'a path' if rel_path is None else 'content'}: {rel_path}")
                self.put(system, root, rel_path, content)
                n += 1
        return Written(n)


class LinesWriter(DraftWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, root = opened(self.draft)
        # of a task that runs twice both write this file, and the one renamed last stays, with the same lines
        name = f"part-{TaskContext.get().partitionId():05d}.jsonl"
        part = f"{root}/{name}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part, compression=None) as f:
            for batch in iterator:
                for line in batch.column(0).to_pylist():
                    f.write((line or "").encode("utf-8", "surrogatepass") + b"\n")
        system.move(part, f"{root}/{name}")
        return Written(1)


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library_tree"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TreeWriter(self.options["path"], overwrite)


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library_lines"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return LinesWriter(self.options["path"], overwrite)


def write_tree(rows: DataFrame, target: str, overwrite: bool = False) -> None:
    """Files of rows: rel_path, content, as the folder target: all of them or nothing."""
    rows.sparkSession.dataSource.register(Tree)
    rows.select("rel_path", F.col("content").cast("binary").alias("content")).write.format("library_tree").mode("overwrite" if overwrite else "append").save(target)


def write_json(rows: DataFrame, target: str, overwrite: bool = False) -> None:
    """Rows as JSON lines in the folder target, nulls named: all of them or nothing."""
    rows.sparkSession.dataSource.register(Lines)
    lines = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.format("library_lines").mode("overwrite" if overwrite else "append").save(target)

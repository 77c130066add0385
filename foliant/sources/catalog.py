"""A versioned catalog of Parquet snapshots. An edit computes the next table and writes it as a new snapshot. Numbered
pointer files name the tables of each state; the one with the highest number holds. A pointer is created as a whole
under a number of its own, so readers see one state or the next, never a mixture, and of two writers who start from
the same state the second fails."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant import storage
from foliant.functions import codes, dates, formats, text

#: Version of the tables' columns that this code writes.
SCHEMA_VERSION = 2
#: Columns that came with a version, with the value they have in tables written before.
ADDED: dict[int, dict[str, dict[str, str]]] = {
    1: {},
    2: {"works": {"my_comment": "cast(null as string)", "source_tags": "cast(array() as array<string>)", "completed_at": "cast(null as string)"}, "pending": {"dismissed": "false"}},
}


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, dict]:
        """Number and content of the pointer that holds."""
        folder, fs = self._folder()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n[len("state-") :]) for n in names if n.startswith("state-") and n[len("state-") :].isdigit()]
        if not numbers:
            return 0, {"version": SCHEMA_VERSION, "tables": {}}
        return max(numbers), json.loads(self.spark.read.text(f"{self.root}/state-{max(numbers):012d}", wholetext=True).first()[0])

    def snapshot(self) -> dict[str, str]:
        """Table names and the folders that hold them now."""
        return self._state()[1]["tables"]

    def version(self) -> int:
        """Version of the columns that the tables have, read without touching them."""
        return self._state()[1]["version"]

    def table(self, name: str) -> DataFrame:
        """A table as this code's version has it; columns it was written without have their default."""
        state = self._state()[1]
        return migrated(self.spark.read.parquet(state["tables"][name]), name, state["version"])

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Write all tables and then switch to them at once; other tables stay as they are, in the present version."""
        number, state = self._state()
        current = dict(state["tables"])
        written = dict(tables)
        if state["version"] < SCHEMA_VERSION:
            written = {n: self.table(n) for n in current if n not in tables} | written
        for name, df in written.items():
            folder = f"{self.root}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(folder)
            current[name] = folder
        _, fs = self._folder()
        path = lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        draft, final = path(f"draft-{uuid.uuid4().hex}"), path(f"state-{number + 1:012d}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": SCHEMA_VERSION, "tables": current}).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError("another writer has committed since; compute the edit again")

    def write_json(self, path: str, rows: DataFrame) -> None:
        """Rows as JSON lines, for other programs."""
        rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def migrated(df: DataFrame, name: str, version: int) -> DataFrame:
    for number in range(version + 1, SCHEMA_VERSION + 1):
        for column, value in ADDED[number].get(name, {}).items():
            if column not in df.columns:
                df = df.withColumn(column, F.expr(value))
    return df


def in_memory(tables: dict[str, DataFrame]) -> None:
    """The tables as temporary views, for SQL without a folder."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def fill_missing(works: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """found: id and columns. Sets only what is null; a word count only where there is none above 0."""
    new = found.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    value = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) <= 0, F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)) if c == "word_count" else F.coalesce(c, f"_new_{c}")
    return works.join(new, works["id"] == new["_id"], "left").select(*[value(c).alias(c) if c in columns else F.col(c) for c in works.columns])


def edit(works: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """edits: id and columns; null keeps a value, an empty string clears it, a negative count keeps it."""
    new = edits.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_new_{c}") for c in columns])

    def value(c: str):
        n = F.col(f"_new_{c}")
        if c == "word_count":
            return F.when(n >= 0, n).otherwise(F.col(c))
        return F.when(n.isNull(), F.col(c)).otherwise(F.nullif(n, F.lit("")))

    return works.join(new, works["id"] == new["_id"], "left").select(*[value(c).alias(c) if c in columns else F.col(c) for c in works.columns])


def insert(works: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows with ids after the largest, in the order of their external id, title and other columns. new has no id column; of
    rows with one external id the first by title enters, and none whose external id the table has."""
    fresh = new
    if "external_id" in new.columns:
        fresh = new.join(works.select("external_id").filter("external_id is not null"), "external_id", "left_anti")
        named = fresh.filter("external_id is not null").groupBy("external_id").agg(F.min_by(F.struct(*new.columns), "title").alias("_r")).select("_r.*")
        fresh = fresh.filter("external_id is null").unionByName(named)
    top = works.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # the other columns break ties, so that a rerun numbers alike
    first = [c for c in ("external_id", "title") if c in new.columns]
    order = [F.col(c) for c in first] + [F.to_json(F.struct(*sorted(set(new.columns) - set(first))))] * (len(first) < len(new.columns))
    numbered = storage.numbered(fresh, order, "_n").withColumn("id", F.col("_n") + F.lit(top)).drop("_n")
    return works.unionByName(numbered, allowMissingColumns=True)


def insert_record_only(works: DataFrame, new: DataFrame) -> DataFrame:
    """Append works without a file. new: title, author. Titles are trimmed and must not be empty, blank authors are null."""
    title, author = F.trim("title"), F.nullif(F.trim("author"), F.lit(""))
    checked = F.when(F.coalesce(title, F.lit("")) == "", F.raise_error("a title must not be empty")).otherwise(title)
    return insert(works, new.select(checked.alias("title"), author.alias("author"), F.lit(0).cast("long").alias("word_count"), F.lit("record_only").alias("status")))


def require_works(works: DataFrame, ids: DataFrame) -> None:
    """Fails, with some of them, if works lacks any of ids: id."""
    lost = [r.id for r in ids.select("id").distinct().join(works.select("id"), "id", "left_anti").orderBy("id").limit(10).collect()]
    if lost:
        raise ValueError(f"no works with ids {', '.join(map(str, lost))}")


def edit_works(works: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: id and any of title, author, summary, my_comment, language, language_label, status, word_count, published,
    published_approx, completed. Null keeps a value and an empty string clears it, but a title is only replaced by one
    that is not blank, a negative count keeps the old one, and what was set by hand says so in its source. Unknown
    statuses and dates that can't be read fail the edit as a whole."""
    has = lambda c: c in edits.columns
    new = edits.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_new_{c}") for c in edits.columns if c != "id"])
    joined = works.join(new, works["id"] == new["_id"], "left")
    values: dict[str, Column] = {}
    if has("title"):
        values["title"] = F.coalesce(F.nullif(F.trim("_new_title"), F.lit("")), "title")
    for c in ("author", "summary", "my_comment", "language", "language_label"):
        if has(c):
            typed = F.trim(f"_new_{c}") if c.startswith("language") else F.col(f"_new_{c}")
            values[c] = F.when(typed.isNull(), F.col(c)).otherwise(F.nullif(typed, F.lit("")))
    if has("status"):
        typed = F.col("_new_status")
        values["status"] = F.when(typed.isNull(), F.col("status")).when(typed.isin(*codes.STATUSES), typed).otherwise(F.raise_error(F.concat(F.lit("unknown status "), typed)).cast("string"))
    if has("word_count"):
        counted = F.col("_new_word_count") >= 0
        values["word_count"] = F.when(counted, F.col("_new_word_count")).otherwise(F.col("word_count"))
        values["word_count_source"] = F.when(counted, "manual").otherwise(F.col("word_count_source"))
    for c, at, precision, source, approx in (("published", "published_at", "published_prec", "date_source", "date_is_approx"), ("completed", "completed_at", "completed_prec", "completed_source", "completed_is_approx")):
        if has(c):
            typed = F.col(f"_new_{c}")
            parsed = dates.edit(typed)
            edited = typed.isNotNull()
            read = F.when(parsed["state"] == "invalid", F.raise_error(F.concat(F.lit("no date: "), typed)).cast("string")).otherwise(parsed["value"]["iso"])
            put = {at: read, precision: parsed["value"]["precision"], source: F.lit("manual"), approx: F.when(parsed["state"] == "set", F.coalesce(F.col(f"_new_{c}_approx"), F.lit(False)) if has(f"{c}_approx") else F.lit(False)).otherwise(False)}
            values |= {k: F.when(edited, v).otherwise(F.col(k)) for k, v in put.items() if k in works.columns}
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in works.columns])


def replace_set(links: DataFrame, new: DataFrame, on: str = "work_id") -> DataFrame:
    """The links of every work named in new become exactly its new ones."""
    return links.join(new.select(on).distinct(), on, "left_anti").unionByName(new.dropDuplicates())


def replace_tags(work_tags: DataFrame, edits: DataFrame, tags: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links and vocabulary after edits: work_id, tags array. Names are trimmed, empty ones go, and of spellings that
    differ in case the vocabulary's stays, else the first. tags: name; names that no work has leave it."""
    new = edits.select("work_id", F.explode_outer(text.dedupe_nocase(F.col("tags"))).alias("name")).filter("name is not null")
    known = (tags if tags is not None else work_tags).select("name").distinct()
    spelled = known.groupBy(text.nocase(F.col("name")).alias("_key")).agg(F.min("name").alias("_known"))
    fresh = new.groupBy(text.nocase(F.col("name")).alias("_key")).agg(F.min("name").alias("_fresh"))
    names = fresh.join(spelled, "_key", "left").select("_key", F.coalesce("_known", "_fresh").alias("_name"))
    linked = new.withColumn("_key", text.nocase(F.col("name"))).join(names, "_key").select("work_id", F.col("_name").alias("name"))
    links = work_tags.join(edits.select("work_id").distinct(), "work_id", "left_anti").unionByName(linked.select(*work_tags.columns))
    return links, links.select("name").distinct()


def replace_series(works_series: DataFrame, series: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships and series after edits: work_id, memberships array of (name, position). Names are trimmed, empty ones
    go; of one work's memberships in a series the last stands. series: series_id, name; a name that it has in any case
    keeps its spelling and id, others are added after the largest id, and series without works go."""
    listed = edits.select("work_id", F.posexplode_outer("memberships").alias("_at", "_m")).select("work_id", "_at", F.trim("_m.name").alias("name"), F.col("_m.position").alias("position")).filter("name <> ''")
    listed = listed.withColumn("_key", text.nocase(F.col("name")))
    known = series.withColumn("_key", text.nocase(F.col("name")))
    unknown = listed.groupBy("_key").agg(F.min_by("name", F.struct("work_id", "_at")).alias("name")).join(known.select("_key"), "_key", "left_anti")
    top = series.agg(F.coalesce(F.max("series_id"), F.lit(0))).first()[0]
    added = storage.numbered(unknown, [F.col("_key")], "_n").select((F.col("_n") + F.lit(top)).alias("series_id"), "name", "_key")
    every = known.select("series_id", "name", "_key").unionByName(added)
    mine = listed.join(every.select("series_id", "_key"), "_key").groupBy("work_id", "series_id").agg(F.max_by("position", "_at").alias("position"))
    links = works_series.join(edits.select("work_id").distinct(), "work_id", "left_anti").unionByName(mine.select(*works_series.columns))
    return links, every.drop("_key").join(links.select("series_id").distinct(), "series_id", "left_semi")


def copy_source_tags(works: DataFrame, work_tags: DataFrame, ids: DataFrame) -> DataFrame:
    """Edits for replace_tags: the works' own tags, and those of their source that differ from them in more than case.
    works: id, source_tags. ids: work_id."""
    own = work_tags.groupBy("work_id").agg(F.array_sort(F.collect_set("name")).alias("_own"))
    out = ids.select("work_id").distinct().join(works.select(F.col("id").alias("work_id"), "source_tags"), "work_id").join(own, "work_id", "left")
    mine = F.coalesce("_own", F.array().cast("array<string>"))
    keys = F.transform(mine, text.nocase)
    more = F.filter(F.coalesce("source_tags", F.array().cast("array<string>")), lambda t: ~F.array_contains(keys, text.nocase(t)))
    return out.select("work_id", F.concat(mine, more).alias("tags"))


def delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Without the works in ids and everything that hangs on them. ids: id."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    keys = {"works": ["id"], "files": ["work_id"], "work_tags": ["work_id"], "works_series": ["work_id"], "relations": ["work_a", "work_b"], "pending": ["from_work_id"]}
    out = {}
    for name, df in tables.items():
        for key in keys.get(name, []):
            df = df.join(gone, df[key] == gone["_gone"], "left_anti")
        out[name] = df
    return out


def delete_works(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """delete(), and tags and series that no work has any more go from their vocabularies. Gives the tables and one row of
    counts: works, tags and series that went. tables may have tags (name) and series (series_id, name); ids: id."""
    out = delete(tables, ids)
    one, gone = F.lit(1).alias("_one"), []
    gone.append(tables["works"].join(ids.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("works_removed")))
    for name, links, on in (("tags", "work_tags", "name"), ("series", "works_series", "series_id")):
        if name in tables:
            out[name] = tables[name].join(out[links].select(on).distinct(), on, "left_semi")
            gone.append(tables[name].join(out[links].select(on).distinct(), on, "left_anti").agg(F.count("*").alias(f"{name}_pruned")))
    report = gone[0].select("*", one)
    for part in gone[1:]:
        report = report.join(part.select("*", one), "_one")
    return out, report.drop("_one")


def remove_folders(root: str, ids: DataFrame) -> DataFrame:
    """Remove the folders of works under root, a folder that all executors see. Gives id, removed (false where there was
    none) and error. ids: id."""
    import pyarrow as pa
    from pyarrow import fs

    schema = pa.schema([("id", pa.int64()), ("removed", pa.bool_()), ("error", pa.string())])

    def run(batches):
        system, at = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for i, folder in zip(batch["id"].to_pylist(), batch["folder"].to_pylist(), strict=True):
                there, error = False, None
                try:
                    there = system.get_file_info(inside(at, folder)).type == fs.FileType.Directory
                    if there:
                        system.delete_dir(inside(at, folder))
                except OSError as e:
                    there, error = False, str(e)
                yield pa.RecordBatch.from_pydict({"id": [i], "removed": [there], "error": [error]}, schema)

    folders = ids.select(F.col("id").cast("long").alias("id")).distinct().withColumn("folder", formats.work_folder(F.col("id")))
    return storage.store(folders.mapInArrow(run, "id long, removed boolean, error string"), "removed")


def set_dismissed(pending: DataFrame, ids: DataFrame | None, dismissed: bool) -> DataFrame:
    """Dismiss or restore every row of the external ids, or all rows."""
    if ids is None:
        return pending.withColumn("dismissed", F.lit(dismissed))
    hit = ids.select(F.col("external_id").alias("_hit")).distinct()
    return pending.join(hit, pending["external_id"] == hit["_hit"], "left").withColumn("dismissed", F.when(F.col("_hit").isNotNull(), dismissed).otherwise(F.col("dismissed"))).drop("_hit")


def store_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """files after new ones, in the order of seq. new: work_id, format_detail, file_hash, seq, and further columns of
    files; policy, if it is there, is keep_both or replace, else all are kept.

    Content that is stored already is left out, of new content the first. Kept files get the versions after the largest
    of their work and format; a replacing file takes version 1 and the place of what had its path. The last one stored
    of a work and format is current, all others of it are archived; other works and formats stay as they are.
    """
    fresh = new if "policy" in new.columns else new.withColumn("policy", F.lit("keep_both"))
    fresh = fresh.join(files.select("file_hash").distinct(), "file_hash", "left_anti")
    once = fresh.groupBy("file_hash").agg(F.min_by(F.struct(*fresh.columns), "seq").alias("_r")).select("_r.*")
    slot = Window.partitionBy("work_id", "format_detail")
    last = files.groupBy("work_id", "format_detail").agg(F.max("version").alias("_last"))
    replacing = F.col("policy") == "replace"
    placed = once.join(last, ["work_id", "format_detail"], "left").withColumn("_replaces", F.max(replacing.cast("int")).over(slot))
    # of replacing files only the last is left, since they share a path
    placed = placed.withColumn("_final", F.max(F.when(replacing, F.col("seq"))).over(slot)).filter(~replacing | (F.col("seq") == F.col("_final")))
    order = F.row_number().over(Window.partitionBy("work_id", "format_detail", "policy").orderBy("seq"))
    version = F.when(replacing, 1).otherwise(F.greatest(F.coalesce("_last", F.lit(0)), F.col("_replaces")) + order).cast("int")
    placed = placed.withColumn("version", version).withColumn("role", F.when(F.col("seq") == F.max("seq").over(slot), "current").otherwise("archived"))
    if "rel_path" in files.columns:
        placed = placed.withColumn("rel_path", formats.relative_path(F.col("work_id"), F.col("version"), F.col("format_detail")))
    placed = storage.store(placed.drop("_last", "_replaces", "_final"), "placed")
    touched = placed.select("work_id", "format_detail").distinct().withColumn("_touched", F.lit(True))
    gone = placed.filter(replacing).select("work_id", "format_detail", F.lit(1).alias("version"))
    old = files if "role" in files.columns else files.withColumn("role", F.lit("archived"))
    kept = old.join(gone, ["work_id", "format_detail", "version"], "left_anti").join(touched, ["work_id", "format_detail"], "left")
    kept = kept.withColumn("role", F.when(F.col("_touched"), "archived").otherwise(F.col("role"))).drop("_touched")
    if "id" in files.columns:
        top = files.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        placed = storage.numbered(placed, [F.col("seq")], "_n").withColumn("id", F.col("_n") + F.lit(top)).drop("_n")
    return kept.unionByName(placed.select(*[c for c in placed.columns if c in kept.columns]), allowMissingColumns=True)


def set_current(files: DataFrame, ids: DataFrame) -> DataFrame:
    """The files in ids become current, what was current of their work and format is archived. ids: id."""
    wanted = ids.select(F.col("id").alias("_wanted")).distinct()
    marked = files.join(wanted, files["id"] == wanted["_wanted"], "left")
    slots = marked.filter("_wanted is not null").groupBy("work_id", "format_detail").agg(F.max("_wanted").alias("_chosen"))
    joined = files.join(slots, ["work_id", "format_detail"], "left")
    return joined.withColumn("role", F.when(F.col("_chosen").isNull(), F.col("role")).when(F.col("id") == F.col("_chosen"), "current").otherwise("archived")).select(*files.columns)


def delete_versions(files: DataFrame, ids: DataFrame) -> DataFrame:
    """files without the archived ones in ids; a current one fails the whole edit. ids: id."""
    hit = files.join(ids.select("id").distinct(), "id", "left_semi")
    if not hit.filter("role = 'current'").isEmpty():
        raise ValueError("a current version is not deleted; make another version current first")
    return delete_files(files, ids)


def delete_files(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids.select("id").distinct(), "id", "left_anti")


def inside(root: str, path: str) -> str:
    """path under root, refused if it leads out of it."""
    import posixpath

    whole = posixpath.normpath(posixpath.join(root, path))
    if posixpath.commonpath([posixpath.normpath(root), whole]) != posixpath.normpath(root):
        raise ValueError(f"{path} is outside the library")
    return whole


def copy_files(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Copy source_path to rel_path under root on the executors, each file to a draft that is renamed when it is whole.
    Gives rel_path and an error, null where the copy succeeded. root is a folder that all executors share."""
    import pandas as pd

    def run(batches):
        import os
        import shutil

        for batch in batches:
            errors = []
            for source, rel in zip(batch["source_path"], batch["rel_path"], strict=True):
                try:
                    target = inside(root, rel)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    draft = f"{target}.{uuid.uuid4().hex}.tmp"
                    shutil.copyfile(source.removeprefix("file:"), draft)
                    os.replace(draft, target)
                    errors.append(None)
                except (OSError, ValueError) as e:
                    errors.append(str(e))
            yield pd.DataFrame({"rel_path": batch["rel_path"], "error": errors})

    return storage.store(files.select("source_path", "rel_path").mapInPandas(run, "rel_path string, error string"), "copied")


def store_relations(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Insert pairs, smaller id first, that are not there; self-pairs are left out."""
    canon = pairs.select(F.least("work_a", "work_b").alias("work_a"), F.greatest("work_a", "work_b").alias("work_b")).filter("work_a < work_b").distinct()
    return relations.unionByName(canon.join(relations.select("work_a", "work_b"), ["work_a", "work_b"], "left_anti"), allowMissingColumns=True)


def store_pending(pending: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by external id and origin: what new rows state fills in over the old, dismissal stays."""
    stated = [c for c in ("title", "author", "language", "kind") if c in new.columns and c in pending.columns]
    fresh = new.groupBy("external_id", "from_work_id").agg(*[F.max(c).alias(f"_{c}") for c in stated], F.lit(True).alias("_new"))
    joined = pending.join(fresh, ["external_id", "from_work_id"], "full")
    values = {c: F.coalesce(f"_{c}", c).alias(c) for c in stated} | {"dismissed": F.coalesce("dismissed", F.lit(False)).alias("dismissed")}
    return joined.select(*[values.get(c, F.col(c)) for c in pending.columns])


def resolve_pending(pending: DataFrame, relations: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending rows whose partner exists become relations and go; so do rows that name their own work."""
    known = works.filter("external_id is not null").select("external_id", F.col("id").alias("_id"))
    met = pending.join(known, "external_id")
    pairs = met.select(F.col("from_work_id").alias("work_a"), F.col("_id").alias("work_b"))
    left = pending.join(known.select("external_id"), "external_id", "left_anti")
    return left, store_relations(relations, pairs)

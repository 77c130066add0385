"""The denormalised read model: works with their files, tags, series and relations, displays and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant import storage
from foliant.functions import dates, formats, text


def displays(works: DataFrame) -> DataFrame:
    return works.withColumn("published_display", dates.display(F.col("published_at"), F.col("published_prec"), F.col("date_is_approx"))).withColumn("word_count_display", formats.word_count_display(F.col("word_count"), F.col("word_count_source")))


def edges(relations: DataFrame) -> DataFrame:
    """Both directions of a symmetric relation, so that joins stay equi-joins."""
    return relations.select(F.col("work_a").alias("work_id"), F.col("work_b").alias("other_id")).unionByName(relations.select(F.col("work_b").alias("work_id"), F.col("work_a").alias("other_id")))


def file_rank(kind) -> F.Column:
    return F.when(kind == "html", 0).when(kind == "pdf", 1).otherwise(2)


def current_versions(files: DataFrame) -> DataFrame:
    """role, for tables that have none: the latest version of each work and format is current, the others are archived."""
    if "role" in files.columns:
        return files
    latest = Window.partitionBy("work_id", "format_detail")
    return files.withColumn("role", F.when(F.col("version") == F.max("version").over(latest), "current").otherwise("archived"))


def ordered_files(files: DataFrame, store_order: bool = False) -> DataFrame:
    """Files of each work as an array: current first, html before pdf before others, later versions first, detail.
    store_order leaves out the class. A table without roles gets them from the versions, in the same aggregation."""
    role = F.col("role") if "role" in files.columns else F.lit(None).cast("string")
    listed = files.groupBy("work_id").agg(F.collect_list(F.struct(role.alias("role"), file_rank(F.col("format_class")).alias("b"), F.col("version").alias("v"), F.col("format_detail").alias("d"), F.col("size_bytes").alias("e"))).alias("_f"))
    latest = lambda f: F.array_max(F.transform(F.filter("_f", lambda g: g["d"].eqNullSafe(f["d"])), lambda g: g["v"]))
    archived = lambda f: F.coalesce(f["role"] != "current", f["v"] != latest(f))
    rank = lambda f: F.lit(0) if store_order else f["b"]
    keyed = F.array_sort(F.transform("_f", lambda f: F.struct(archived(f).alias("a"), rank(f).alias("b"), (-f["v"]).alias("c"), f["d"].alias("d"), f["e"].alias("e"))))
    return listed.select("work_id", F.transform(keyed, lambda f: F.struct(f["d"].alias("format_detail"), (-f["c"]).alias("version"), F.when(f["a"], "archived").otherwise("current").alias("role"), f["e"].alias("size_bytes"))).alias("files"))


def with_presence(files: DataFrame, listing: DataFrame) -> DataFrame:
    """files with exists, whether their rel_path is listed. listing: rel_path."""
    there = listing.select("rel_path").distinct().withColumn("exists", F.lit(True))
    return files.join(there, "rel_path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def file_badges(files: DataFrame) -> DataFrame:
    """Per work the number of its file rows, archived ones included, and whether one is missing. files: with exists."""
    return files.groupBy("work_id").agg(F.count("*").alias("n_files"), F.bool_or(~F.col("exists")).alias("missing"))


def tags_of_works(work_tags: DataFrame) -> DataFrame:
    listed = work_tags.groupBy("work_id").agg(F.array_sort(F.collect_set(F.struct(text.nocase(F.col("name")).alias("k"), F.col("name").alias("n")))).alias("_t"))
    return listed.select("work_id", F.transform("_t", lambda t: t["n"]).alias("tags"))


def work_view(works: DataFrame, files: DataFrame, work_tags: DataFrame, works_series: DataFrame, relations: DataFrame) -> DataFrame:
    """One plan for the whole read model; each child table is aggregated once and joined on the work."""
    key = lambda df: df.withColumnRenamed("work_id", "id")
    related = edges(relations).groupBy("work_id").agg(F.array_sort(F.collect_set("other_id")).alias("related"))
    series = works_series.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("series_id", "position"))).alias("series"))
    out = displays(works).join(key(ordered_files(files)), "id", "left").join(key(tags_of_works(work_tags)), "id", "left").join(key(series), "id", "left").join(key(related), "id", "left")
    out = out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "author", "summary", "my_comment", "language_label") if c in out.columns]
    lists = [F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " \u0000 ") for c in ("tags", "source_tags") if c in out.columns]
    return out.withColumn("search_text", text.fold(F.concat_ws(" \u0000 ", *texts, *lists)))


def counts(works: DataFrame, files: DataFrame, relations: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: works, those with files and record-only, file rows of all versions, related works, open pending rows."""
    w = works.agg(F.count("*").alias("works_total"), F.count_if(F.col("status") == "record_only").alias("record_only"), F.count_if(F.col("status") != "record_only").alias("with_file"))
    f = files.join(works.select(F.col("id").alias("work_id")), "work_id", "left_semi").agg(F.count("*").alias("files_total"))
    r = edges(relations).select("work_id").distinct().join(works.select(F.col("id").alias("work_id")), "work_id", "left_semi").agg(F.count("*").alias("works_related"))
    p = pending.filter(~F.col("dismissed")).agg(F.count("*").alias("pending_total"))
    one = F.lit(1).alias("_one")  # single rows, joined by a constant key
    out = w.select("*", one)
    for part in (f, r, p):
        out = out.join(part.select("*", one), "_one")
    return out.drop("_one")


def pending_with_context(pending: DataFrame, works: DataFrame) -> DataFrame:
    """Open pending relations with the title of the work they come from, and their place: by title, those without last."""
    names = works.select(F.col("id").alias("from_work_id"), F.col("title").alias("_from"))
    out = pending.filter(~F.col("dismissed")).join(names, "from_work_id", "left").withColumn("from_title", F.coalesce("_from", F.lit(""))).drop("_from")
    return storage.numbered(out, [F.col("title").asc_nulls_last(), F.col("external_id"), F.col("from_work_id")], "place")


def pending_note(pending: DataFrame, most: int = 3) -> DataFrame:
    """The first titles that wait, and whether there are more; one row."""
    top = pending.filter(~F.col("dismissed") & F.col("title").isNotNull()).orderBy("title", "external_id", "from_work_id").select("title").limit(most + 1)
    listed = top.agg(F.array_sort(F.collect_list("title")).alias("_t"))
    return listed.select(F.slice("_t", 1, most).alias("titles"), (F.size("_t") > most).alias("more"))


def series_sizes(works_series: DataFrame) -> DataFrame:
    sizes = works_series.groupBy("series_id").agg(F.count("*").alias("series_size"))
    return works_series.join(sizes, "series_id")


def related_works(relations: DataFrame, works: DataFrame) -> DataFrame:
    """For each work its related works with title, date and place: by date, undated last, then by id."""
    other = works.select(F.col("id").alias("other_id"), F.col("title").alias("other_title"), F.col("published_at").alias("other_published"))
    listed = edges(relations).join(other, "other_id")
    order = Window.partitionBy("work_id").orderBy(F.col("other_published").asc_nulls_last(), "other_id")
    return listed.withColumn("place", F.row_number().over(order))


def merge_candidates(works: DataFrame, files: DataFrame, limit: int = 300) -> DataFrame:
    """The works changed last with their distinct formats; where works have no updated_at, ids stand for it."""
    latest = [F.col("updated_at").desc_nulls_last()] if "updated_at" in works.columns else []
    top = works.orderBy(*latest, F.col("id").desc()).limit(limit).select("id", "title")
    found = files.join(top.select(F.col("id").alias("work_id")), "work_id", "left_semi").groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("format_detail", F.lit("")))), ",").alias("formats"))
    return top.join(found.withColumnRenamed("work_id", "id"), "id", "left").withColumn("formats", F.coalesce("formats", F.lit("")))


def lookup(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the wanted values; names of the vocabularies match in any case."""
    for column, value in wanted.items():
        df = df.filter(text.nocase(F.col(column)) == text.nocase(F.lit(value)) if column == "name" else F.col(column) == F.lit(value))
    return df


def prune(vocabulary: DataFrame, used: DataFrame, on: str) -> DataFrame:
    return vocabulary.join(used.select(on).distinct(), on, "left_semi")

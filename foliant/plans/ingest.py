"""Import planning: files to format, text, hash, group, action and relations, as lazily evaluated DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import storage
from foliant.functions import codes, dates, formats, html, text
from foliant.sources import catalog, files

#: Unreadable files that an error names.
NAMED = 1000


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path and content of all files under path. Names below it that begin with a dot are left out, and so is what lies
    in such folders; path itself may have one in its own way. Files that cannot be read are left to require_readable()."""
    return files.read(files.listed(spark, [path])).filter("error is null").drop("error")


def read_paths(paths: DataFrame) -> DataFrame:
    """path, content and error of named files. A file that can't be read has an error and no content."""
    return files.read(paths.select("path", F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("error")).distinct())


def require_readable(found: DataFrame) -> DataFrame:
    """path and content of files, or one error that names those that could not be read, NAMED of them at most."""
    wrong = found.filter("error is not null").select("path", "error").orderBy("path").limit(NAMED + 1).collect()
    if wrong:
        more = "; and more" if len(wrong) > NAMED else ""
        raise OSError("cannot read " + "; ".join(f"{r.path}: {r.error}" for r in wrong[:NAMED]) + more)
    return found.drop("error")


def inspect(files: DataFrame) -> DataFrame:
    """Per file: name, format, hash, text and parsed metadata where there are any, and a word count."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    out = files.withColumn("name", name).withColumn("format", formats.detect(name, F.col("content"))).withColumn("file_hash", formats.file_hash(F.col("content"))).withColumn("size_bytes", F.length("content").cast("long"))
    out = out.withColumn("raw", F.when(F.col("format.detail").isin("html", "txt"), formats.decode_text(F.col("content"))))
    out = out.withColumn("parsed", html.parse(F.when(F.col("format.detail") == "html", F.col("raw"))))
    plain = F.when(F.col("format.detail") == "html", html.html_text(F.col("raw"))).otherwise(F.col("raw"))
    return out.withColumn("word_count", F.when(F.col("raw").isNotNull(), text.word_count(plain))).drop("raw", "content")


def group_key(files: DataFrame) -> DataFrame:
    """Files of one work share a key: external id, else author and stem, else stem."""
    folded = text.fold(formats.stem(F.col("name")))
    key = F.coalesce(F.concat(F.lit("ao3:"), F.col("parsed.work_id")), F.concat(F.lit("meta:"), text.fold(F.col("parsed.author")), F.lit("\u0000"), folded), F.concat(F.lit("stem:"), folded))
    return files.withColumn("group_key", key)


def plan_files(files: DataFrame, works: DataFrame, stored: DataFrame, manual: DataFrame | None = None, keep_both: bool = False) -> DataFrame:
    """group_key, existing_work_id, title and action of each file; files stand in the order of their paths.

    files: path, name, format, file_hash, group_key, parsed. works: id, title, external_id. stored: work_id,
    format_detail, file_hash. manual: group_key, work_id.

    A file whose bytes are stored belongs to the work that holds them and is skipped. Bytes that the batch has already
    stay with the group of their first file (batch_repeat). A group's work is one chosen by hand, else the one with the
    external id of the group's first file, else, where that has none, the first with its folded title. Without a work
    the files create one; a file of a format that the work or an earlier file of the group has replaces it or, with
    keep_both, becomes a version; others attach.
    """
    owner = stored.groupBy("file_hash").agg(F.min("work_id").alias("hash_owner"))
    out = files.join(owner, "file_hash", "left").withColumn("external_id", F.col("parsed.work_id")).withColumn("detail", F.col("format.detail"))
    first = out.filter("hash_owner is null").groupBy("file_hash").agg(F.min(F.struct("path", "group_key")).alias("_first"))
    out = out.join(first, "file_hash", "left").withColumn("batch_repeat", F.col("hash_owner").isNull() & (F.col("path") > F.col("_first.path")))
    out = out.withColumn("group_key", F.coalesce(F.concat(F.lit("work:"), F.col("hash_owner")), F.col("_first.group_key"))).drop("_first")
    shown = F.coalesce("parsed.title", formats.stem(F.col("name")))
    groups = out.groupBy("group_key").agg(F.min("hash_owner").alias("_held"), F.min("path").alias("_order"), F.min_by(F.struct(shown.alias("title"), F.col("external_id").alias("group_external"), F.col("parsed.author").alias("group_author")), "path").alias("_g")).select("group_key", "_held", "_order", "_g.*")
    by_id = works.filter("external_id is not null").groupBy(F.col("external_id").alias("group_external")).agg(F.min("id").alias("_by_id"))
    titles = works.withColumn("title_key", text.fold(F.col("title"))).filter("title_key <> ''").groupBy("title_key").agg(F.min("id").alias("_by_title"))
    groups = groups.join(by_id, "group_external", "left").withColumn("title_key", F.when(F.col("group_external").isNull(), text.fold(F.col("title")))).join(titles, "title_key", "left").drop("title_key")
    if manual is not None:
        # the last assignment of a key stands; a table has no order, so that is the largest work
        chosen = manual.groupBy("group_key").agg(F.max("work_id").alias("_manual"))
        groups = groups.join(chosen, "group_key", "left")
    else:
        groups = groups.withColumn("_manual", F.lit(None).cast("long"))
    groups = groups.withColumn("existing_work_id", F.when(F.col("_held").isNotNull(), F.col("_held")).otherwise(F.coalesce("_manual", "_by_id", "_by_title")))
    out = out.join(groups.select("group_key", "existing_work_id", "title", "group_external", "group_author", F.col("_order").alias("group_order")), "group_key")
    taken = stored.select(F.col("work_id").alias("existing_work_id"), F.col("format_detail").alias("detail")).distinct().withColumn("_taken", F.lit(True))
    earliest = out.filter("hash_owner is null").groupBy("group_key", "detail").agg(F.min("path").alias("_earliest"))
    out = out.join(taken, ["existing_work_id", "detail"], "left").join(earliest, ["group_key", "detail"], "left")
    other = F.lit("keep_both" if keep_both else "replace")
    action = F.when(F.col("hash_owner").isNotNull(), "skipped_duplicate").when(F.col("existing_work_id").isNull(), "create_work").when(F.coalesce("_taken", F.lit(False)) | (F.col("path") > F.col("_earliest")), other).otherwise("attach")
    return out.withColumn("action", action).drop("_taken", "_earliest")


def withdraw(manual: DataFrame, keys: DataFrame) -> DataFrame:
    """Assignments by hand without those of keys: group_key. The plan is made anew with what is left."""
    return manual.join(keys.select("group_key"), "group_key", "left_anti")


def summary(plan: DataFrame) -> DataFrame:
    """One row of counts over a plan."""
    stored = F.col("action") != "skipped_duplicate"
    per_group = plan.groupBy("group_key").agg(F.min("existing_work_id").alias("work"), F.count("*").alias("n"), F.count_if(stored).alias("kept"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_group.agg(F.count_if(F.col("work").isNull()).alias("works_new"), F.count_if(F.col("work").isNotNull()).alias("works_existing"), total("n").alias("files_total"), total("kept").alias("files_to_store"), total(F.col("n") - F.col("kept")).alias("duplicates"))


def new_works(plan: DataFrame) -> DataFrame:
    """A row per group with what its work gets: stated values of its first parsed file, else the largest estimate."""
    stated = F.when(F.col("parsed").isNotNull(), F.struct("path", "parsed"))
    estimate = F.max(F.when(F.col("action") != "skipped_duplicate", F.col("word_count"))).alias("_estimate")
    groups = plan.groupBy("group_key").agg(F.min("group_order").alias("group_order"), F.min("existing_work_id").alias("existing_work_id"), F.first("title").alias("title"), F.first("group_author").alias("author"), F.first("group_external").alias("external_id"), F.min(stated)["parsed"].alias("p"), estimate)
    published, completed = dates.parse_loose(F.col("p.published")), dates.parse_loose(F.col("p.completed"))
    best = best_count(F.col("p.words"), F.col("_estimate"))
    return groups.select(
        "group_key", "group_order", "existing_work_id", "title", "author", F.col("p.summary").alias("summary"), published["iso"].alias("published_at"), published["precision"].alias("published_prec"), F.lit(False).alias("date_is_approx"), F.when(published.isNotNull(), "ao3").alias("date_source"),
        completed["iso"].alias("completed_at"), best["words"].cast("long").alias("word_count"), best["source"].alias("word_count_source"), codes.language_code(F.col("p.language_label")).alias("language"), F.col("p.language_label").alias("language_label"), html.translation_role(F.col("p.related")).alias("translation_role"),
        F.col("p.url").alias("source_url"), "external_id", F.col("p.tags").alias("source_tags"), F.lit("has_file").alias("status"),
    )


def execute(tables: dict[str, DataFrame], plan: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after a plan, and the report of one row. tables: works, files, relations, pending.

    Existing works are filled in where they have nothing; new ones come after the largest id in the order of their
    groups. Content that is stored is not stored again; relations are recorded between works that exist, pending ones
    wait, and those that this batch completes go.
    """
    plan = storage.store(plan.drop("content") if "content" in plan.columns else plan, "plan")
    groups = storage.store(new_works(plan), "groups")
    works, files = tables["works"], tables["files"]
    top = works.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = storage.numbered(groups.filter("existing_work_id is null"), [F.col("group_order")], "_n").withColumn("id", F.col("_n") + F.lit(top))
    ids = storage.store(fresh.select("group_key", "id", "external_id").unionByName(groups.filter("existing_work_id is not null").select("group_key", F.col("existing_work_id").alias("id"), "external_id")), "ids")
    columns = [c for c in groups.columns if c in works.columns and c not in ("id", "status")]
    # of several groups of one work the first says most
    found = groups.filter("existing_work_id is not null").groupBy(F.col("existing_work_id").alias("id")).agg(F.min(F.struct("group_order", *columns)).alias("_f")).select("id", *[F.col(f"_f.{c}").alias(c) for c in columns])
    filled = catalog.fill_missing(works, found, columns)
    added = fresh.select("id", *[c for c in groups.columns if c in works.columns and c != "id"])
    stored = plan.filter("action <> 'skipped_duplicate'").join(ids.select("group_key", F.col("id").alias("work_id")), "group_key")
    policy = F.when(F.col("action") == "keep_both", "keep_both").otherwise("replace")
    incoming = stored.select("work_id", F.col("format.class").alias("format_class"), F.col("detail").alias("format_detail"), F.col("name").alias("original_name"), "file_hash", "size_bytes", "word_count", F.struct("group_order", "path").alias("seq"), policy.alias("policy"))
    incoming = storage.store(incoming, "incoming")
    out = dict(tables)
    out["works"] = filled.unionByName(added, allowMissingColumns=True)
    out["files"] = catalog.store_files(files, incoming)
    # every stored file counts, also one that a later file of its format replaces
    n_stored = incoming.join(files.select("file_hash"), "file_hash", "left_anti").agg(F.count_distinct("file_hash")).first()[0]
    known = out["works"].filter("external_id is not null").select("external_id").distinct()
    parsed = plan.filter("parsed is not null").select(F.col("parsed.work_id").alias("work_id"), F.col("parsed.related").alias("related")).dropDuplicates(["work_id"])
    resolved, pending = plan_relations(parsed, known)
    of_batch = ids.filter("external_id is not null").groupBy("external_id").agg(F.min("id").alias("id"))
    at = lambda c, name: of_batch.select(F.col("external_id").alias(c), F.col("id").alias(name))
    pairs = resolved.join(at("work_a", "_a"), "work_a").join(at("work_b", "_b"), "work_b").select(F.col("_a").alias("work_a"), F.col("_b").alias("work_b"))
    relations = storage.store(catalog.store_relations(tables["relations"], pairs), "relations")
    waiting = pending.join(at("from_work_id", "_from"), "from_work_id").join(of_batch.select("external_id"), "external_id", "left_anti").select("external_id", F.col("_from").alias("from_work_id"), "title")
    open_ = catalog.store_pending(tables["pending"], waiting)
    left, completed = catalog.resolve_pending(open_, relations, of_batch.select("external_id", "id"))
    out["pending"], out["relations"] = storage.store(left, "pending"), storage.store(completed, "relations")
    n_before = tables["relations"].count()
    counts = groups.agg(F.count_if(F.col("existing_work_id").isNull()).alias("works_created"), F.count_if(F.col("existing_work_id").isNotNull()).alias("works_matched"))
    report = counts.withColumn("files_stored", F.lit(n_stored).cast("long")).withColumn("files_skipped", F.lit(plan.count() - n_stored).cast("long"))
    report = report.withColumn("relations_stored", F.lit(out["relations"].count() - n_before).cast("long")).withColumn("relations_pending", F.lit(out["pending"].count()).cast("long"))
    return out, report


def best_count(stated: F.Column, plan_words: F.Column) -> F.Column:
    """A stated count wins over the largest estimate; its source says which it was."""
    return F.struct(F.coalesce(stated, plan_words, F.lit(0)).alias("words"), F.when(stated.isNotNull(), "ao3").when(plan_words.isNotNull(), "estimated").alias("source"))


def plan_relations(parsed: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of known ids and pending ones. parsed: work_id, related. known: external_id.

    A translation's original is resolved always, a translation of this work only if known; other kinds never.
    """
    links = parsed.select("work_id", F.explode("related").alias("r")).select("work_id", F.col("r.kind").alias("kind"), F.col("r.work_id").alias("other"), F.col("r.title").alias("title")).filter("work_id <> other")
    marked = links.join(known.select(F.col("external_id").alias("other"), F.lit(True).alias("is_known")).distinct(), "other", "left")
    done = (F.col("kind") == "translation_of") | ((F.col("kind") == "translation_into") & F.coalesce("is_known", F.lit(False)))
    number = lambda c: F.col(c).try_cast("decimal(38,0)")
    smaller = F.coalesce(number("work_id") < number("other"), F.col("work_id") < F.col("other"))
    resolved = marked.filter(done).select(F.when(smaller, F.col("work_id")).otherwise(F.col("other")).alias("work_a"), F.when(smaller, F.col("other")).otherwise(F.col("work_id")).alias("work_b")).distinct()
    pending = marked.filter((F.col("kind") == "translation_into") & ~done).groupBy(F.col("other").alias("external_id"), F.col("work_id").alias("from_work_id")).agg(F.first("title", ignorenulls=True).alias("title"))
    return resolved, pending

"""The engine's named queries over the driver's tables, and the SQL that gives the same rows.

Queries cover whole tables. Orders are shown as row_no or place columns, since results are compared as sets.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import storage
from foliant.functions import codes, dates, formats, html, text
from foliant.operators import group, query, trigrams, view
from foliant.plans import ingest
from foliant.sources import catalog, changes, files
from foliant.sources.adapter import with_views
from foliant.sources.adapter import view as table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query_of(name: str, sql: str | None = None, reads: tuple[str, ...] = ()):
    """Register a query and its SQL; reads names the library tables that the SQL begins with."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = (with_views(*reads) + "\n" if reads else "") + sql
        return f

    return put


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = view.tags_of_works(table(spark, sf_dir, "work_tags")).withColumnRenamed("work_id", "id")
    return table(spark, sf_dir, "works").join(tags, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))




@query_of(
    "search_ranked",
    """, folded AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, trim(regexp_replace(lower(author), '[^a-z0-9]+', ' ', 'g')) AS a FROM works WHERE status <> 'record_only'),
hit AS (SELECT *, 100 * (CASE WHEN t = 'tale' THEN 3 WHEN starts_with(t, 'tale') THEN 2 WHEN contains(t, 'tale') THEN 1 ELSE 0 END) + 40 * (CASE WHEN contains(a, 'tale') THEN 1 ELSE 0 END)
  + 100 * (CASE WHEN t = 'customer 000' THEN 3 WHEN starts_with(t, 'customer 000') THEN 2 WHEN contains(t, 'customer 000') THEN 1 ELSE 0 END) + 40 * (CASE WHEN a = 'customer 000' THEN 3 WHEN starts_with(a, 'customer 000') THEN 2 WHEN contains(a, 'customer 000') THEN 1 ELSE 0 END)
  + 100 * (CASE WHEN t = '9' THEN 3 WHEN starts_with(t, '9') THEN 2 WHEN contains(t, '9') THEN 1 ELSE 0 END) AS relevance
  FROM folded WHERE (contains(t, 'tale') OR contains(a, 'tale')) AND (contains(t, 'customer 000') OR contains(a, 'customer 000')) AND contains(t, '9'))
SELECT row_number() OVER (ORDER BY relevance DESC, published_at DESC NULLS FIRST, CASE WHEN published_at IS NULL THEN -id END, id) AS row_no, id, title, relevance FROM hit""",
    ("works",),
)
def search_ranked(spark, sf_dir):
    options = query.Options(search="tale customer#000 title:9")
    return query.ranked(table(spark, sf_dir, "works"), options).select("row_no", "id", "title", F.col("relevance").cast("int").alias("relevance"))


@query_of("search_indexed", SQL["search_ranked"])
def search_indexed(spark, sf_dir):
    """The same search through a trigram index of the works."""
    index = trigrams.index_works(table(spark, sf_dir, "works"), storage.Folder(spark, "works-index").path)
    return trigrams.search(index, query.Options(search="tale customer#000 title:9")).select("row_no", "id", "title", F.col("relevance").cast("int").alias("relevance"))


@query_of(
    "works_display",
    """SELECT id, CASE WHEN published_at IS NULL THEN NULL ELSE (CASE WHEN date_is_approx THEN '~' ELSE '' END) || substr(published_at, 1, CASE published_prec WHEN 'year' THEN 4 WHEN 'month' THEN 7 ELSE 10 END) END AS published_display,
  CASE WHEN word_count = 0 THEN '—' WHEN word_count_source = 'ao3' THEN format('{:,}', word_count) ELSE '~' || format('{:,}', word_count) END AS word_count_display, coalesce(upper(language), '?') AS badge FROM works""",
    ("works",),
)
def works_display(spark, sf_dir):
    return view.displays(table(spark, sf_dir, "works")).select("id", "published_display", "word_count_display", formats.language_badge(F.col("language")).alias("badge"))


@query_of(
    "library_counts",
    """SELECT (SELECT count(*) FROM works) AS works_total, (SELECT count(*) FROM works WHERE status = 'record_only') AS record_only, (SELECT count(*) FROM works WHERE status <> 'record_only') AS with_file,
 (SELECT count(*) FROM files WHERE work_id IN (SELECT id FROM works)) AS files_total, (SELECT count(*) FROM works WHERE id IN (SELECT work_a FROM relations UNION SELECT work_b FROM relations)) AS works_related, (SELECT count(*) FROM pending WHERE NOT dismissed) AS pending_total""",
    ("works", "files", "relations", "pending"),
)
def library_counts(spark, sf_dir):
    return view.counts(*[table(spark, sf_dir, n) for n in ("works", "files", "relations", "pending")])


@query_of("language_facets", "SELECT language, count(*) AS n_works, min_by(coalesce(language_label, language), id) AS label, row_number() OVER (ORDER BY count(*) DESC, language) AS place FROM works WHERE language IS NOT NULL GROUP BY language", ("works",))
def language_facets(spark, sf_dir):
    return query.language_facets(table(spark, sf_dir, "works"))


@query_of("tag_facets", "SELECT lower(name) AS tag_key, count(DISTINCT work_id) AS n_works, min_by(name, work_id) AS name, row_number() OVER (ORDER BY count(DISTINCT work_id) DESC, lower(name)) AS place FROM work_tags GROUP BY lower(name)", ("work_tags",))
def tag_facets(spark, sf_dir):
    return query.tag_facets(table(spark, sf_dir, "work_tags"))


@query_of(
    "filter_tags_languages",
    """SELECT id FROM works WHERE status <> 'record_only' AND coalesce(language, '') IN ('en', '')
 AND id IN (SELECT work_id FROM work_tags WHERE starts_with(lower(name), 'p')) AND (SELECT count(*) > 0 FROM work_tags t WHERE t.work_id = works.id AND lower(name) = (SELECT min(lower(name)) FROM work_tags WHERE starts_with(lower(name), 'p')))""",
    ("works", "work_tags"),
)
def filter_tags_languages(spark, sf_dir):
    first = table(spark, sf_dir, "work_tags").filter(F.lower("name").startswith("p")).agg(F.min(F.lower("name"))).first()[0]
    return query.select(tagged(spark, sf_dir), query.Options(tags=[first.upper()] if first else [], languages=["en", ""])).select("id")


for _name, _sort, _down, _undated, _order in (
    ("sort_published_desc", "published", True, "observed", "published_at DESC NULLS FIRST, CASE WHEN published_at IS NULL THEN -id END, id"),
    ("sort_published_asc", "published", False, "observed", "published_at ASC NULLS LAST, id"),
    ("sort_published_last", "published", True, "last", "published_at DESC NULLS LAST, id"),
    ("sort_words", "words", True, "observed", "word_count DESC, id"),
    ("sort_title", "title", False, "observed", "title, id"),
):

    @query_of(_name, f"SELECT row_number() OVER (ORDER BY {_order}) AS row_no, id FROM works WHERE status <> 'record_only'", ("works",))
    def sorted_works(spark, sf_dir, _options=query.Options(sort=_sort, descending=_down, undated=_undated)):
        return query.ranked(table(spark, sf_dir, "works"), _options).select("row_no", "id")


@query_of(
    "group_translations",
    """, r AS (SELECT id, translation_role, row_number() OVER (ORDER BY word_count DESC, id) AS rank FROM works WHERE status <> 'record_only'),
e AS (SELECT work_a AS x, work_b AS y FROM relations UNION ALL SELECT work_b, work_a FROM relations),
near AS (SELECT x, list(y) AS ys FROM e GROUP BY x),
-- relations stay inside blocks of twelve works, so that each block is walked by itself
b AS (SELECT id, rank, id // 12 AS block, row_number() OVER (PARTITION BY id // 12 ORDER BY rank) AS k, coalesce(ys, []) AS ys FROM r LEFT JOIN near ON x = id),
walk(block, k, id, anchor, anchors) AS (SELECT DISTINCT block, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM b
 UNION ALL SELECT b.block, b.k, b.id, coalesce(list_filter(w.anchors, lambda a: list_contains(b.ys, a))[1], b.id), CASE WHEN len(list_filter(w.anchors, lambda a: list_contains(b.ys, a))) = 0 THEN list_append(w.anchors, b.id) ELSE w.anchors END FROM walk w JOIN b ON b.block = w.block AND b.k = w.k + 1),
g AS (SELECT r.id, r.rank, r.translation_role, walk.anchor FROM r JOIN walk ON walk.id = r.id)
SELECT id, anchor, min(rank) OVER (PARTITION BY anchor) AS group_rank, count(*) OVER (PARTITION BY anchor) AS group_size,
 CASE WHEN row_number() OVER (PARTITION BY anchor ORDER BY CASE translation_role WHEN 'original' THEN 0 WHEN 'translation' THEN 1 ELSE 2 END, rank) > 1 THEN 1 ELSE 0 END AS depth FROM g""",
    ("works", "relations"),
)
def group_translations(spark, sf_dir):
    ranked = query.ranked(table(spark, sf_dir, "works"), query.Options(sort="words")).select("id", F.col("row_no").alias("rank"), "translation_role")
    return group.by_translation(ranked, table(spark, sf_dir, "relations")).select("id", "anchor", "group_rank", "group_size", "depth")


@query_of(
    "group_series",
    """, r AS (SELECT id, row_number() OVER (ORDER BY word_count DESC, id) AS rank FROM works WHERE status <> 'record_only'),
own AS (SELECT work_id, min(series_id) AS first, list(series_id) AS mine, min(CASE WHEN series_id >= 1000000000 THEN series_id - 1000000000 ELSE series_id // 3 END) AS block FROM works_series GROUP BY work_id),
-- series join the works of three customers at most, so that each three are walked by themselves
b AS (SELECT id, rank, block, first, mine, row_number() OVER (PARTITION BY block ORDER BY rank) AS k FROM r JOIN own ON work_id = id),
walk(block, k, id, anchor, anchors, firsts) AS (SELECT DISTINCT block, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[], []::BIGINT[] FROM b
 UNION ALL SELECT block, k, id, coalesce(at_, id), CASE WHEN at_ IS NULL THEN list_append(anchors, id) ELSE anchors END, CASE WHEN at_ IS NULL THEN list_append(firsts, first) ELSE firsts END
 FROM (SELECT b.block, b.k, b.id, b.first, w.anchors, w.firsts, list_filter(w.anchors, lambda a, i: list_contains(b.mine, w.firsts[i]))[1] AS at_ FROM walk w JOIN b ON b.block = w.block AND b.k = w.k + 1)),
a AS (SELECT r.id, r.rank, coalesce(walk.anchor, r.id) AS anchor FROM r LEFT JOIN walk ON walk.id = r.id),
g AS (SELECT a.*, s.position FROM a LEFT JOIN own ON own.work_id = a.anchor LEFT JOIN works_series s ON s.work_id = a.id AND s.series_id = own.first)
SELECT id, anchor, min(rank) OVER (PARTITION BY anchor) AS group_rank, count(*) OVER (PARTITION BY anchor) AS group_size, row_number() OVER (PARTITION BY anchor ORDER BY position NULLS LAST, rank) AS place FROM g""",
    ("works", "works_series"),
)
def group_series(spark, sf_dir):
    ranked = query.ranked(table(spark, sf_dir, "works"), query.Options(sort="words")).select("id", F.col("row_no").alias("rank"))
    return group.by_series(ranked, table(spark, sf_dir, "works_series")).select("id", "anchor", "group_rank", "group_size", "place")


@query_of("related_works", "SELECT x AS work_id, y AS other_id, title AS other_title, published_at AS other_published, row_number() OVER (PARTITION BY x ORDER BY published_at NULLS LAST, y) AS place FROM (SELECT work_a AS x, work_b AS y FROM relations UNION ALL SELECT work_b, work_a FROM relations) JOIN works ON id = y", ("works", "relations"))
def related_works(spark, sf_dir):
    return view.related_works(table(spark, sf_dir, "relations"), table(spark, sf_dir, "works")).select("work_id", "other_id", "other_title", "other_published", F.col("place").cast("long").alias("place"))


@query_of("pending_context", "SELECT p.external_id, p.from_work_id, p.title, coalesce(w.title, '') AS from_title, row_number() OVER (ORDER BY p.title NULLS LAST, p.external_id, p.from_work_id) AS place FROM pending p LEFT JOIN works w ON p.from_work_id = w.id WHERE NOT p.dismissed", ("works", "pending"))
def pending_context(spark, sf_dir):
    return view.pending_with_context(table(spark, sf_dir, "pending"), table(spark, sf_dir, "works")).select("external_id", "from_work_id", "title", "from_title", "place")


@query_of("series_sizes", "SELECT work_id, series_id, position, count(*) OVER (PARTITION BY series_id) AS series_size FROM works_series", ("works_series",))
def series_sizes(spark, sf_dir):
    return view.series_sizes(table(spark, sf_dir, "works_series")).select("work_id", "series_id", "position", "series_size")


@query_of(
    "files_ordered",
    """, f AS (SELECT *, max(version) OVER (PARTITION BY work_id, format_detail) AS latest FROM files)
SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY version <> latest, CASE format_class WHEN 'html' THEN 0 WHEN 'pdf' THEN 1 ELSE 2 END, version DESC, format_detail) AS place, format_detail, version, CASE WHEN version = latest THEN 'current' ELSE 'archived' END AS role, size_bytes::BIGINT AS size_bytes FROM f""",
    ("files",),
)
def files_ordered(spark, sf_dir):
    listed = view.ordered_files(view.current_versions(table(spark, sf_dir, "files")))
    return listed.select("work_id", F.posexplode("files").alias("at", "f")).select("work_id", (F.col("at") + 1).cast("long").alias("place"), "f.format_detail", "f.version", "f.role", "f.size_bytes")


@query_of("tags_per_work", "SELECT work_id, string_agg(name, '|' ORDER BY lower(name), name) AS tags FROM work_tags GROUP BY work_id", ("work_tags",))
def tags_per_work(spark, sf_dir):
    return view.tags_of_works(table(spark, sf_dir, "work_tags")).select("work_id", F.array_join("tags", "|").alias("tags"))


EDITED = """, second AS (SELECT id, title || ' (2)' AS title, status FROM works WHERE id % 7 = 0 AND id % 5 <> 0 UNION ALL SELECT id, title, status FROM works WHERE id % 7 <> 0 AND id % 5 <> 0 UNION ALL SELECT id + 1000000000, title, status FROM works WHERE id % 11 = 0),
feed AS (SELECT coalesce(s.id, w.id) AS id, CASE WHEN w.id IS NULL THEN 'added' WHEN s.id IS NULL THEN 'removed' ELSE 'changed' END AS kind, 2 AS state FROM works w FULL JOIN second s ON s.id = w.id WHERE w.id IS NULL OR s.id IS NULL OR s.title <> w.title)
"""


def edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Works in two states: some go, some get another title, some are new."""
    works = table(spark, sf_dir, "works").select("id", "title", "status")
    title = F.when(F.col("id") % 7 == 0, F.concat("title", F.lit(" (2)"))).otherwise(F.col("title"))
    return works, works.filter("id % 5 <> 0").withColumn("title", title).unionByName(works.filter("id % 11 = 0").withColumn("id", F.col("id") + 1000000000))


@query_of("works_changed", EDITED + "SELECT id, kind, state FROM feed", ("works",))
def works_changed(spark, sf_dir):
    return changes.feed(*edited(spark, sf_dir), "id", 2)


@query_of(
    "merge_candidates",
    EDITED + "SELECT w.id, w.title, coalesce(string_agg(DISTINCT f.format_detail, ',' ORDER BY f.format_detail), '') AS formats FROM (SELECT s.id, s.title FROM second s LEFT JOIN feed ON feed.id = s.id AND kind <> 'removed' ORDER BY coalesce(state, 1) DESC, s.id DESC LIMIT 300) w LEFT JOIN files f ON f.work_id = w.id GROUP BY ALL",
    ("works", "files"),
)
def merge_candidates(spark, sf_dir):
    """The works that the last state changed come first."""
    before, after = edited(spark, sf_dir)
    return view.merge_candidates(changes.updated(after, changes.feed(before, after, "id", 2), "id", 1), table(spark, sf_dir, "files"))


@query_of(
    "format_labels",
    """, sized AS (SELECT *, size_bytes * CASE seq % 3 WHEN 0 THEN 1 WHEN 1 THEN 977 ELSE 991013 END AS n FROM files)
SELECT work_id, seq, format_detail, CASE WHEN format_class = 'other' THEN 'Other · ' || upper(format_detail) ELSE upper(format_detail) END AS label,
 CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN (floor(n * 10 / 1024.0::DECIMAL(38, 1) + 0.5) / 10)::DECIMAL(18, 1)::VARCHAR || ' KB' ELSE (floor(n * 10 / 1048576.0::DECIMAL(38, 1) + 0.5) / 10)::DECIMAL(18, 1)::VARCHAR || ' MB' END AS size FROM sized""",
    ("files",),
)
def format_labels(spark, sf_dir):
    n = F.col("size_bytes") * F.when(F.col("seq") % 3 == 0, 1).when(F.col("seq") % 3 == 1, 977).otherwise(991013)
    return table(spark, sf_dir, "files").select("work_id", "seq", "format_detail", formats.format_label(F.col("format_class"), F.col("format_detail")).alias("label"), formats.bytes_display(n).alias("size"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query_of("word_counts", r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '\p{Han}|[\p{L}\p{N}]+')), 0)::BIGINT AS n_words FROM documents")
def word_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@query_of("folded_hash", r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ς', 'σ'), '[^\p{L}\p{N}]+', ' ', 'g'))) AS folded_sha256 FROM documents")
def folded_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded_sha256"))


@query_of(
    "files_round_trip",
    """SELECT CASE doc_id % 4 WHEN 1 THEN '_' ELSE '' END || 'doc-' || doc_id || '.txt' AS name, CASE WHEN doc_id % 3 = 0 THEN '_shelf' ELSE 'shelf' END || (doc_id % 7) AS folder, strlen(coalesce(text, '')) AS length, sha256(coalesce(text, '')) AS file_hash, NULL::VARCHAR AS error
 FROM documents WHERE doc_id % 4 <> 2""",
)
def files_round_trip(spark, sf_dir):
    """Texts written as files, some with names that are not listed, and what lists and reads them."""
    hidden = F.when(F.col("doc_id") % 4 == 1, "_").when(F.col("doc_id") % 4 == 2, ".").otherwise("")
    shelf = F.concat(F.when(F.col("doc_id") % 3 == 0, "_shelf").otherwise("shelf"), F.col("doc_id") % 7)
    path = storage.Folder(spark, "library").path
    files.write_tree(docs(spark, sf_dir).select(F.concat(shelf, F.lit("/"), hidden, F.lit("doc-"), "doc_id", F.lit(".txt")).alias("rel_path"), F.coalesce("text", F.lit("")).alias("content")), path)
    found = files.read(files.listed(spark, [path]))
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    return found.select(part(1).alias("name"), part(2).alias("folder"), F.length("content").cast("long").alias("length"), formats.file_hash(F.col("content")).alias("file_hash"), "error")


@query_of("content_duplicates", "SELECT doc_id, sha256(text) AS file_hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS owner, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS batch_repeat FROM documents")
def content_duplicates(spark, sf_dir):
    hashed = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("file_hash"))
    owner = hashed.groupBy("file_hash").agg(F.min("doc_id").alias("owner"))
    return hashed.join(owner, "file_hash").select("doc_id", "file_hash", "owner", (F.col("doc_id") > F.col("owner")).alias("batch_repeat"))


@query_of(
    "language_guess",
    r"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN repeat('漢字仮名', (doc_id % 200)::INT) || text WHEN 2 THEN repeat('かな', (doc_id % 40)::INT) || text WHEN 3 THEN text || repeat('한국어로', (doc_id % 100)::INT) ELSE text END AS t FROM documents),
c AS (SELECT doc_id, coalesce(len(regexp_extract_all(t, '[\p{L}\p{N}]')), 0)::BIGINT AS n_letters, coalesce(len(regexp_extract_all(t, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]')), 0) AS han, coalesce(len(regexp_extract_all(t, '[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}]')), 0) AS kana, coalesce(len(regexp_extract_all(t, '[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]')), 0) AS hangul FROM t)
SELECT doc_id, CASE WHEN n_letters = 0 THEN NULL WHEN kana * 100 > n_letters THEN 'ja' WHEN hangul * 100 > 5 * n_letters THEN 'ko' WHEN han * 100 > 15 * n_letters THEN 'zh' END AS guess, n_letters FROM c""",
)
def language_guess(spark, sf_dir):
    times = lambda word, n: F.repeat(F.lit(word), (F.col("doc_id") % n).cast("int"))
    mixed = F.when(F.col("doc_id") % 5 == 1, F.concat(times("漢字仮名", 200), "text")).when(F.col("doc_id") % 5 == 2, F.concat(times("かな", 40), "text")).when(F.col("doc_id") % 5 == 3, F.concat("text", times("한국어로", 100))).otherwise(F.col("text"))
    rows = docs(spark, sf_dir).select("doc_id", mixed.alias("t"))
    return rows.select("doc_id", text.guess_language(F.col("t")).alias("guess"), text.script_counts(F.col("t"))["total"].alias("n_letters"))


@query_of("matching_documents", r"SELECT doc_id FROM documents WHERE contains(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g') || ' ', 'token') AND contains(lower(text), 'the')")
def matching_documents(spark, sf_dir):
    return docs(spark, sf_dir).filter(text.matches_terms(text.fold(F.col("text")), query.fold_literal("Token, the").split())).select("doc_id")


@query_of(
    "match_strength",
    r"""WITH f AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ς', 'σ'), '[^\p{L}\p{N}]+', ' ', 'g')) AS f FROM documents),
s AS (SELECT doc_id, f, unnest(['the', 'in', 'is and']) AS t FROM f)
SELECT doc_id, sum(CASE WHEN f = t THEN 3 WHEN starts_with(f, t) THEN 2 WHEN contains(f, t) THEN 1 ELSE 0 END)::BIGINT AS strength FROM s WHERE f IS NOT NULL GROUP BY doc_id""",
)
def match_strength(spark, sf_dir):
    """The sum of what three terms weigh in each text."""
    return docs(spark, sf_dir).filter("text is not null").select("doc_id", text.total_strength(text.fold(F.col("text")), ["the", "in", "is and"]).cast("long").alias("strength"))


@query_of("documents_indexed", SQL["matching_documents"])
def documents_indexed(spark, sf_dir):
    """The same through a trigram index of the texts."""
    index = trigrams.index_texts(docs(spark, sf_dir).select("doc_id", "text"), "text", ["doc_id"], storage.Folder(spark, "documents-index").path)
    return trigrams.containing(index, "text", "Token, the").select("doc_id")


@query_of(
    "page_text",
    r"""WITH s AS (SELECT page_id, coalesce(regexp_matches(html, '(?is)<p\s[^>]*class\s*=[\s"'']*(?:[^"''>]*\s)?message[\s"''>].*<a\s[^>]*href\s*=[^>]*/works/[0-9]') AND regexp_matches(html, '(?is)<h1[\s>]'), false) AS is_work, array_to_string(list_transform(string_split_regex(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(?i)</?script[^>]*>'), lambda x, i: CASE WHEN i % 2 = 0 THEN replace(x, '<', chr(1)) ELSE x END), '') AS t FROM pages),
m AS (SELECT page_id, is_work, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '</?br(?:\s[^>]*)?/?>', chr(10) || chr(10), 'gi'), '<p(?:\s[^>]*)?/?>', chr(2), 'gi'), '</p(?:\s[^>]*)?>', chr(3), 'gi'), '</?(?:div|li|blockquote|h1|h2|h3)(?:\s[^>]*)?/?>', chr(4), 'gi'), '</?(?:article|footer|header|nav|ol|section|table|ul)(?:\s[^>]*)?/?>', chr(5), 'gi') AS t FROM s),
b AS (SELECT page_id, is_work, replace(replace(replace(regexp_replace(regexp_replace(t, '</?[a-zA-Z!][^>]*>', '', 'g'), '\x02([^\x02-\x05]*)\x03?', chr(10) || '\1' || chr(10), 'g'), chr(3), chr(10) || chr(10)), chr(4), chr(10)), chr(5), '') AS t FROM m),
u AS (SELECT page_id, is_work, regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, chr(1), '<'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS t FROM b)
SELECT page_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS text, is_work FROM u""",
)
def page_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", html.html_text(F.col("html")).alias("text"), html.parse(F.col("html")).isNotNull().alias("is_work"))


@query_of(
    "work_pages",
    r"""WITH d AS (SELECT doc_id, (SELECT max(doc_id) FROM documents) AS top FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS is_work, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN doc_id::VARCHAR END AS work_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'Tale ' || doc_id END AS title,
 CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN (doc_id * 37)::BIGINT END AS words, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 = 0 THEN '2019-05-01' END AS published,
 CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'translation' ELSE 'original' END END AS role, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'Fluff|Tea ' || (doc_id % 4) END AS tags FROM d
UNION ALL SELECT -1 - page_id, false, NULL, NULL, NULL, NULL, NULL, NULL FROM pages""",
)
def work_pages(spark, sf_dir):
    """Metadata of download pages made of the documents' ids, some without a title or without a link to a work, and of the pages."""
    n = F.col("doc_id").cast("string")
    link = F.when(F.col("doc_id") % 5 == 0, F.lit("<p class=message>No link</p>")).otherwise(F.concat(F.lit("<p class=message>At <a href='http://example.test/works/"), n, F.lit("?x=1'>here</a></p>")))
    head = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("<div class=meta><h1>Tale "), n, F.lit("</h1></div>")))
    stats = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("Published: 2019-05-01 ")).otherwise(""), F.lit("Words: "), F.format_number(F.col("doc_id") * 37, 0), F.lit(" Chapters: 1/1"))
    kind = F.when(F.col("doc_id") % 2 == 0, "A translation of").otherwise("Translation into Deutsch available:")
    made = F.concat(link, F.lit("<dl class=tags><dt>Additional Tags:</dt><dd><a>Fluff</a>, <a>Tea "), (F.col("doc_id") % 4).cast("string"), F.lit("</a></dd><dt>Stats:</dt><dd>"), stats, F.lit("</dd></dl><ul><li>"), kind, F.lit(" <a href='/works/99999999'>Other</a></li></ul>"), head, F.lit("<p>Text</p>"))
    downloads = docs(spark, sf_dir).filter("doc_id is not null").select("doc_id", made.alias("html"))
    every = downloads.unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select((-1 - F.col("page_id")).alias("doc_id"), "html"))
    p = F.col("p")
    rows = every.select("doc_id", html.parse(F.col("html")).alias("p"))
    return rows.select("doc_id", p.isNotNull().alias("is_work"), p["work_id"].alias("work_id"), p["title"].alias("title"), p["words"].alias("words"), p["published"].alias("published"), html.translation_role(p["related"]).alias("role"), F.array_join(p["tags"], "|").alias("tags"))


@query_of(
    "loose_dates",
    """WITH d AS (SELECT o_orderkey AS id, o_orderkey % 8 AS kind, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%d') AS day FROM orders)
SELECT id, CASE WHEN kind IN (4, 5, 6) THEN NULL WHEN kind IN (0, 7) THEN y || '-01-01' WHEN kind = 1 THEN y || '-' || m || '-01' ELSE y || '-' || m || '-' || day END AS iso,
 CASE WHEN kind IN (4, 5, 6) THEN NULL WHEN kind IN (0, 7) THEN 'year' WHEN kind = 1 THEN 'month' ELSE 'day' END AS date_precision FROM d""",
)
def loose_dates(spark, sf_dir):
    kind, at = F.col("o_orderkey") % 8, F.col("o_orderdate")
    written = F.when(kind == 0, F.date_format(at, "yyyy")).when(kind == 1, F.date_format(at, "yyyy/MM")).when(kind == 2, F.date_format(at, "yyyy.M.d")).when(kind == 3, F.concat(F.lit(" "), F.date_format(at, "yyyy-MM-dd"), F.lit(" ")))
    written = written.when(kind == 4, F.date_format(at, "yyyy-'13'")).when(kind == 5, F.date_format(at, "yyyy-MM-'32'")).when(kind == 6, F.date_format(at, "yyyy-MM-dd-'1'")).otherwise(F.date_format(at, "yyyy-'xx'-dd"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), dates.parse_loose(written).alias("d")).select("id", "d.iso", F.col("d.precision").alias("date_precision"))


@query_of("best_estimate", "SELECT w.id, CASE WHEN w.word_count_source = 'ao3' THEN w.word_count ELSE coalesce(max(f.size_bytes), 0) END::BIGINT AS words FROM works w LEFT JOIN files f ON f.work_id = w.id GROUP BY w.id, w.word_count_source, w.word_count", ("works", "files"))
def best_estimate(spark, sf_dir):
    sizes = table(spark, sf_dir, "files").groupBy(F.col("work_id").alias("id")).agg(F.max("size_bytes").alias("estimate"))
    stated = F.when(F.col("word_count_source") == "ao3", F.col("word_count"))
    return table(spark, sf_dir, "works").join(sizes, "id", "left").select("id", ingest.best_count(stated, F.col("estimate"))["words"].cast("long").alias("words"))


@query_of("relations_canonical", "SELECT DISTINCT least(k, o) AS work_a, greatest(k, o) AS work_b FROM (SELECT o_orderkey AS k, (o_orderkey * 31 + 7) % 1000 AS o FROM orders) WHERE k <> o")
def relations_canonical(spark, sf_dir):
    pairs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("work_a"), ((F.col("o_orderkey") * 31 + 7) % 1000).alias("work_b"))
    return catalog.store_relations(pairs.limit(0), pairs)


@query_of("vocabulary_pruned", "SELECT DISTINCT p_type AS name FROM part WHERE p_type IN (SELECT name FROM work_tags)", ("work_tags",))
def vocabulary_pruned(spark, sf_dir):
    vocabulary = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("name")).distinct()
    return view.prune(vocabulary, table(spark, sf_dir, "work_tags"), "name")


@query_of(
    "fill_and_edit",
    "SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE coalesce(language, 'xx') END AS language, CASE WHEN id % 4 = 0 THEN id ELSE CASE WHEN word_count <= 0 THEN 77 ELSE word_count END END::BIGINT AS word_count FROM works",
    ("works",),
)
def fill_and_edit(spark, sf_dir):
    works = table(spark, sf_dir, "works").select("id", "language", "word_count")
    filled = catalog.fill_missing(works, works.select("id", F.lit("xx").alias("language"), F.lit(77).cast("long").alias("word_count")), ["language", "word_count"])
    edits = works.select("id", F.when(F.col("id") % 6 == 0, "").alias("language"), F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(-1).alias("word_count"))
    return catalog.edit(filled, edits, ["language", "word_count"])


def listed(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows of several tables as kind and row, their columns joined by bars, nulls as dashes."""
    one = lambda kind, df, columns: df.select(F.lit(kind).alias("kind"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("row"))
    rows = [one(kind, df, columns) for kind, (df, columns) in parts.items()]
    return functools.reduce(DataFrame.unionByName, rows)


def sql_list(*parts: tuple[str, str, str]) -> str:
    """The same in SQL: kind, columns, and what follows SELECT."""
    text_of = lambda c: f"coalesce({c}::VARCHAR, '-')"
    one = lambda kind, columns, rest: f"SELECT '{kind}' AS kind, concat_ws('|', {', '.join(map(text_of, columns.split(',')))}) AS row {rest}"
    return "\nUNION ALL ".join(one(*p) for p in parts)


LINKED = ("works", "files", "work_tags", "works_series", "relations", "pending")


@query_of(
    "delete_cascade",
    """, left_tags AS (SELECT DISTINCT name FROM work_tags WHERE work_id % 3 <> 0), left_series AS (SELECT DISTINCT series_id FROM works_series WHERE work_id % 3 <> 0)
"""
    + sql_list(
        ("works", "id,title", "FROM works WHERE id % 3 <> 0"), ("files", "work_id,format_detail,version,size_bytes", "FROM files WHERE work_id % 3 <> 0 OR work_id NOT IN (SELECT id FROM works)"), ("tags of works", "work_id,name", "FROM work_tags WHERE work_id % 3 <> 0 OR work_id NOT IN (SELECT id FROM works)"),
        ("series of works", "work_id,series_id,position", "FROM works_series WHERE work_id % 3 <> 0"), ("relations", "work_a,work_b", "FROM relations WHERE work_a % 3 <> 0 AND work_b % 3 <> 0"), ("pending", "external_id,from_work_id,title", "FROM pending WHERE from_work_id % 3 <> 0 OR from_work_id NOT IN (SELECT id FROM works)"),
        ("tags", "name", "FROM left_tags"), ("series", "series_id", "FROM left_series"),
        ("report", "a,b,c", "FROM (SELECT (SELECT count(*) FROM works WHERE id % 3 = 0) AS a, (SELECT count(DISTINCT name) FROM work_tags) - (SELECT count(*) FROM left_tags) AS b, (SELECT count(DISTINCT series_id) FROM works_series) - (SELECT count(*) FROM left_series) AS c)"),
    ),
    LINKED,
)
def delete_cascade(spark, sf_dir):
    """A third of the works goes, with all that hangs on them and the tags and series that nothing else has."""
    tables = {n: table(spark, sf_dir, n) for n in LINKED}
    tables |= {"tags": tables["work_tags"].select("name").distinct(), "series": tables["works_series"].select("series_id").distinct()}
    left, report = catalog.delete_works(tables, tables["works"].filter("id % 3 = 0"))
    return listed({
        "works": (left["works"], ["id", "title"]), "files": (left["files"], ["work_id", "format_detail", "version", "size_bytes"]), "tags of works": (left["work_tags"], ["work_id", "name"]), "series of works": (left["works_series"], ["work_id", "series_id", "position"]),
        "relations": (left["relations"], ["work_a", "work_b"]), "pending": (left["pending"], ["external_id", "from_work_id", "title"]), "tags": (left["tags"], ["name"]), "series": (left["series"], ["series_id"]), "report": (report, ["works_removed", "tags_pruned", "series_pruned"]),
    })


@query_of("pending_resolved", "SELECT external_id, from_work_id FROM pending WHERE external_id NOT IN (SELECT external_id FROM works)", ("works", "pending"))
def pending_resolved(spark, sf_dir):
    works = table(spark, sf_dir, "works")
    left, _ = catalog.resolve_pending(table(spark, sf_dir, "pending"), table(spark, sf_dir, "relations"), works)
    return left.select("external_id", "from_work_id")


@query_of(
    "read_model",
    r""", f AS (SELECT *, max(version) OVER (PARTITION BY work_id, format_detail) AS latest FROM files),
fl AS (SELECT work_id, string_agg(format_detail || ':' || version || ':' || CASE WHEN version = latest THEN 'current' ELSE 'archived' END, ' ' ORDER BY version <> latest, CASE format_class WHEN 'html' THEN 0 WHEN 'pdf' THEN 1 ELSE 2 END, version DESC, format_detail) AS files FROM f GROUP BY work_id),
tg AS (SELECT work_id, string_agg(name, '|' ORDER BY lower(name), name) AS tags FROM work_tags GROUP BY work_id),
sr AS (SELECT work_id, string_agg(series_id || ':' || coalesce(position::VARCHAR, '-'), ' ' ORDER BY series_id) AS series FROM works_series GROUP BY work_id),
rl AS (SELECT x AS work_id, string_agg(y::VARCHAR, ' ' ORDER BY y) AS related FROM (SELECT DISTINCT work_a AS x, work_b AS y FROM relations UNION SELECT work_b, work_a FROM relations) GROUP BY x)
SELECT id, files, coalesce(tags, '') AS tags, series, related, my_comment, completed_at, source_url, array_to_string(source_tags, '|') AS source_tags, sha256(trim(regexp_replace(lower(concat_ws(' ', title, coalesce(author, ''), coalesce(summary, ''), coalesce(my_comment, ''), coalesce(language_label, ''), coalesce(tags, ''), coalesce(array_to_string(source_tags, ' '), ''))), '[^a-z0-9]+', ' ', 'g'))) AS search_sha256
FROM works LEFT JOIN fl ON id = fl.work_id LEFT JOIN tg ON id = tg.work_id LEFT JOIN sr ON id = sr.work_id LEFT JOIN rl ON id = rl.work_id""",
    ("works", "files", "work_tags", "works_series", "relations"),
)
def read_model(spark, sf_dir):
    rows = view.work_view(*[table(spark, sf_dir, n) for n in ("works", "files", "work_tags", "works_series", "relations")])
    listed = F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["format_detail"], f["version"].cast("string"), f["role"])), " ")
    series = F.array_join(F.transform("series", lambda x: F.concat_ws(":", x["series_id"].cast("string"), F.coalesce(x["position"].cast("string"), F.lit("-")))), " ")
    return rows.select("id", listed.alias("files"), F.array_join("tags", "|").alias("tags"), series.alias("series"), F.array_join(F.col("related").cast("array<string>"), " ").alias("related"), "my_comment", "completed_at", "source_url", F.array_join("source_tags", "|").alias("source_tags"), F.sha2("search_text", 256).alias("search_sha256"))


def batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as files to import, works that exist, and files that these have."""
    rows = docs(spark, sf_dir).filter("doc_id is not null")
    digest = F.sha2("text", 256).alias("file_hash")
    detail = F.when(F.col("doc_id") % 2 == 1, "txt").otherwise("html")
    name = F.concat(F.lit("work"), (F.col("doc_id") % 150).cast("string"), F.lit("."), detail)
    files = rows.select(F.concat(F.lit("in/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), name.alias("name"), F.struct(F.when(detail == "html", "html").otherwise("other").alias("class"), detail.alias("detail")).alias("format"), digest, F.length("text").cast("long").alias("size_bytes"), F.lit(None).cast(f"struct<{html.PARSED.replace(' ', ':').replace(',:', ',')}>").alias("parsed"), text.word_count(F.col("text")).alias("word_count"))
    works = spark.range(100).select("id", F.concat(F.lit("Work"), F.col("id").cast("string")).alias("title"), F.lit(None).cast("string").alias("external_id"), F.lit(0).cast("long").alias("word_count"), F.lit("has_file").alias("status"))
    stored = rows.filter("doc_id % 10 = 0").select((F.col("doc_id") % 60).alias("work_id"), F.when(F.col("doc_id") % 4 == 0, "txt").otherwise("html").alias("format_detail"), digest, F.lit(1).alias("version"))
    return ingest.group_key(files), works, stored


PLANNED = """WITH f AS (SELECT doc_id, 'in/' || lpad(doc_id::VARCHAR, 9, '0') AS path, doc_id % 150 AS stem, CASE WHEN doc_id % 2 = 1 THEN 'txt' ELSE 'html' END AS detail, sha256(text) AS h FROM documents WHERE doc_id IS NOT NULL),
st AS (SELECT doc_id % 60 AS work_id, CASE WHEN doc_id % 4 = 0 THEN 'txt' ELSE 'html' END AS detail, sha256(text) AS h FROM documents WHERE doc_id % 10 = 0),
a AS (SELECT f.*, hash_owner FROM f LEFT JOIN (SELECT h, min(work_id) AS hash_owner FROM st GROUP BY h) USING (h)),
o AS (SELECT h, min(path) AS first_path, arg_min(stem, path) AS first_stem FROM a WHERE hash_owner IS NULL GROUP BY h),
k AS (SELECT a.*, CASE WHEN hash_owner IS NOT NULL THEN 'work:' || hash_owner ELSE 'stem:work' || first_stem END AS group_key, hash_owner IS NULL AND path > first_path AS batch_repeat FROM a LEFT JOIN o USING (h)),
g AS (SELECT group_key, coalesce(min(hash_owner), CASE WHEN arg_min(stem, path) < 100 THEN arg_min(stem, path) END) AS existing_work_id FROM k GROUP BY group_key),
p AS (SELECT k.*, existing_work_id, min(CASE WHEN hash_owner IS NULL THEN path END) OVER (PARTITION BY k.group_key, k.detail) AS earliest FROM k JOIN g USING (group_key)),
plan AS (SELECT path, group_key, existing_work_id, batch_repeat, h, CASE WHEN hash_owner IS NOT NULL THEN 'skipped_duplicate' WHEN existing_work_id IS NULL THEN 'create_work'
  WHEN path > earliest OR EXISTS (SELECT 1 FROM st WHERE st.work_id = p.existing_work_id AND st.detail = p.detail) THEN 'keep_both' ELSE 'attach' END AS action FROM p)
"""


@query_of("plan_actions", PLANNED + "SELECT path, group_key, existing_work_id, batch_repeat, action FROM plan")
def plan_actions(spark, sf_dir):
    files, works, stored = batch(spark, sf_dir)
    return ingest.plan_files(files, works, stored, keep_both=True).select("path", "group_key", "existing_work_id", "batch_repeat", "action")


@query_of(
    "plan_summary",
    PLANNED + "SELECT count(DISTINCT CASE WHEN existing_work_id IS NULL THEN group_key END) AS works_new, count(DISTINCT CASE WHEN existing_work_id IS NOT NULL THEN group_key END) AS works_existing, count(*) AS files_total, count(*) FILTER (action <> 'skipped_duplicate') AS files_to_store, count(*) FILTER (action = 'skipped_duplicate') AS duplicates FROM plan",
)
def plan_summary(spark, sf_dir):
    files, works, stored = batch(spark, sf_dir)
    return ingest.summary(ingest.plan_files(files, works, stored, keep_both=True))


@query_of(
    "import_report",
    PLANNED + "SELECT count(DISTINCT CASE WHEN existing_work_id IS NULL THEN group_key END) AS works_created, count(DISTINCT CASE WHEN existing_work_id IS NOT NULL THEN group_key END) AS works_matched, count(DISTINCT CASE WHEN action <> 'skipped_duplicate' THEN h END) AS files_stored, count(*) - count(DISTINCT CASE WHEN action <> 'skipped_duplicate' THEN h END) AS files_skipped, 0::BIGINT AS relations_stored, 0::BIGINT AS relations_pending FROM plan",
)
def import_report(spark, sf_dir):
    files, works, stored = batch(spark, sf_dir)
    none = spark.createDataFrame([], "work_a long, work_b long")
    pending = spark.createDataFrame([], "external_id string, from_work_id long, title string, dismissed boolean")
    plan = ingest.plan_files(files, works, stored, keep_both=True)
    return ingest.execute({"works": works, "files": stored, "relations": none, "pending": pending}, plan)[1]


@query_of(
    "import_tables",
    PLANNED
    + """, heads AS (SELECT group_key, min(path) AS group_order, arg_min(stem, path) AS first FROM k GROUP BY group_key),
ids AS (SELECT group_key, group_order, first, existing_work_id, coalesce(existing_work_id, 99 + row_number() OVER (PARTITION BY existing_work_id IS NULL ORDER BY group_order)) AS work_id FROM g JOIN heads USING (group_key)),
coming AS (SELECT work_id, detail, plan.h, row(group_order, path) AS seq, action <> 'keep_both' AS replaces FROM plan JOIN (SELECT path, detail FROM k) USING (path) JOIN ids ON ids.group_key = plan.group_key WHERE action <> 'skipped_duplicate' AND NOT batch_repeat),
slots AS (SELECT *, max(replaces::INT) OVER s AS any_, max(CASE WHEN replaces THEN seq END) OVER s AS final FROM coming WINDOW s AS (PARTITION BY work_id, detail)),
placed AS (SELECT s.*, CASE WHEN replaces THEN 1 ELSE greatest(CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.work_id = s.work_id AND st.detail = s.detail) THEN 1 ELSE 0 END, any_) + row_number() OVER (PARTITION BY work_id, detail, replaces ORDER BY seq) END AS version,
  CASE WHEN seq = max(seq) OVER (PARTITION BY work_id, detail) THEN 'current' ELSE 'archived' END AS role FROM slots s WHERE NOT replaces OR seq = final)
"""
    + sql_list(("work", "id,title,status", "FROM (SELECT range AS id, 'Work' || range AS title, 'has_file' AS status FROM range(100) UNION ALL SELECT work_id, 'work' || first, 'has_file' FROM ids WHERE existing_work_id IS NULL)"), ("file", "work_id,detail,version,h,role", "FROM (SELECT work_id, detail, version, h, role FROM placed UNION ALL SELECT work_id, detail, 1, h, 'archived' FROM st)")),
)
def import_tables(spark, sf_dir):
    """Works and files as the import leaves them."""
    files, works, stored = batch(spark, sf_dir)
    tables = {"works": works, "files": stored, "relations": spark.createDataFrame([], "work_a long, work_b long"), "pending": spark.createDataFrame([], "external_id string, from_work_id long, title string, dismissed boolean")}
    after = ingest.execute(tables, ingest.plan_files(files, works, stored, keep_both=True))[0]
    return listed({"work": (after["works"], ["id", "title", "status"]), "file": (after["files"], ["work_id", "format_detail", "version", "file_hash", "role"])})


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with an id and a role."""
    number = F.when(F.col("format_detail") == "html", 0).when(F.col("format_detail") == "pdf", 1).otherwise(2)
    return view.current_versions(table(spark, sf_dir, "files")).withColumn("id", F.col("work_id") * 1000 + F.col("seq") * 3 + number)


FILED = ", filed AS (SELECT *, work_id * 1000 + seq * 3 + CASE format_detail WHEN 'html' THEN 0 WHEN 'pdf' THEN 1 ELSE 2 END AS id, CASE WHEN version = max(version) OVER (PARTITION BY work_id, format_detail) THEN 'current' ELSE 'archived' END AS role FROM files)\n"


@query_of("current_version_set", FILED + "SELECT id, CASE WHEN work_id % 2 = 1 THEN role WHEN version = 1 THEN 'current' ELSE 'archived' END AS role FROM filed", ("files",))
def current_version_set(spark, sf_dir):
    files = filed(spark, sf_dir)
    return catalog.set_current(files, files.filter("work_id % 2 = 0 and version = 1").select("id")).select("id", "role")


@query_of("versions_deleted", FILED + "SELECT id, role FROM filed WHERE NOT (work_id % 3 = 0 AND role = 'archived')", ("files",))
def versions_deleted(spark, sf_dir):
    files = filed(spark, sf_dir)
    return catalog.delete_versions(files, files.filter("work_id % 3 = 0 and role = 'archived'").select("id")).select("id", "role")


@query_of(
    "files_stored",
    """, top AS (SELECT work_id, format_detail, max(version) AS last FROM files GROUP BY ALL),
n AS (SELECT id AS work_id, 'html' AS format_detail, unnest([1, 2]) AS k FROM works WHERE id % 3 = 0),
v AS (SELECT n.work_id, n.format_detail, coalesce(last, 0) + k AS version, CASE WHEN k = 2 THEN 'current' ELSE 'archived' END AS role FROM n LEFT JOIN top USING (work_id, format_detail))
SELECT work_id, format_detail, version, role FROM v UNION ALL
SELECT work_id, format_detail, version, CASE WHEN work_id IN (SELECT work_id FROM v) AND format_detail = 'html' THEN 'archived' WHEN version = last THEN 'current' ELSE 'archived' END FROM files JOIN top USING (work_id, format_detail)""",
    ("works", "files"),
)
def files_stored(spark, sf_dir):
    files = view.current_versions(table(spark, sf_dir, "files")).withColumn("file_hash", F.concat_ws("-", "work_id", "format_detail", "seq"))
    new = table(spark, sf_dir, "works").filter("id % 3 = 0").select(F.col("id").alias("work_id"), F.lit("html").alias("format_detail"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("seq"))
    # the third has the bytes of the second
    new = new.withColumn("file_hash", F.concat_ws("-", F.lit("new"), "work_id", F.least(F.col("seq"), F.lit(2)).cast("string")))
    return catalog.store_files(files, new).select("work_id", "format_detail", F.col("version").cast("long").alias("version"), "role")


@query_of(
    "tags_replaced",
    ", links AS (SELECT work_id, name FROM work_tags WHERE work_id % 5 <> 0 UNION ALL SELECT id, 'New' FROM works WHERE id % 5 = 0)\n" + sql_list(("link", "work_id,name", "FROM links"), ("tag", "name", "FROM (SELECT DISTINCT name FROM links)"), ("count", "name,n", "FROM (SELECT name, count(*) AS n FROM links GROUP BY name)")),
    ("works", "work_tags"),
)
def tags_replaced(spark, sf_dir):
    """Links, vocabulary and counts per tag after edits; the counts are those from before, kept up by the edit's changes."""
    before = table(spark, sf_dir, "work_tags")
    edits = table(spark, sf_dir, "works").filter("id % 5 = 0").select(F.col("id").alias("work_id"), F.array(F.lit(" New "), F.lit("new"), F.lit("")).alias("tags"))
    links, names = catalog.replace_tags(before, edits)
    counts = changes.kept_up(changes.counted(before, ["name"]), changes.delta(before, links, edits, "work_id", ["name"]), ["name"])
    return listed({"link": (links, ["work_id", "name"]), "tag": (names, ["name"]), "count": (counts, ["name", "n"])})


@query_of(
    "series_replaced",
    """, top AS (SELECT max(series_id) AS top FROM works_series),
links AS (SELECT work_id, series_id, position FROM works_series WHERE work_id % 6 <> 0 UNION ALL SELECT id, top + 1 + CASE id % 4 WHEN 0 THEN 0 ELSE 1 END, 2 FROM works, top WHERE id % 6 = 0),
named AS (SELECT DISTINCT series_id, CASE WHEN series_id > top THEN 'Saga ' || (2 * (series_id - top - 1)) ELSE 'Series ' || series_id END AS name FROM links, top)
"""
    + sql_list(("link", "work_id,series_id,position", "FROM links"), ("series", "series_id,name", "FROM named")),
    ("works", "works_series"),
)
def series_replaced(spark, sf_dir):
    links = table(spark, sf_dir, "works_series")
    series = links.select("series_id").distinct().select("series_id", F.concat(F.lit("Series "), F.col("series_id").cast("string")).alias("name"))
    part = (F.col("id") % 4).cast("string")
    member = lambda name, position: F.struct(name.alias("name"), F.lit(position).cast(links.schema["position"].dataType).alias("position"))
    edits = table(spark, sf_dir, "works").filter("id % 6 = 0").select(F.col("id").alias("work_id"), F.array(member(F.concat(F.lit(" Saga "), part), 1), member(F.concat(F.lit("Saga "), part), 2), member(F.lit(" "), 3)).alias("memberships"))
    after, vocabulary = catalog.replace_series(links, series, edits)
    return listed({"link": (after, ["work_id", "series_id", "position"]), "series": (vocabulary, ["series_id", "name"])})


@query_of(
    "record_only_added",
    "SELECT (SELECT max(id) FROM works) + row_number() OVER (ORDER BY 'Kept ' || lpad(c_custkey::VARCHAR, 9, '0')) AS id, 'Kept ' || lpad(c_custkey::VARCHAR, 9, '0') AS title, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS author, 'record_only' AS status, 0::BIGINT AS word_count FROM customer",
    ("works",),
)
def record_only_added(spark, sf_dir):
    works = table(spark, sf_dir, "works")
    new = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit(" Kept "), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("  ")).alias("title"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("  ").alias("author"))
    return catalog.insert_record_only(works, new).filter(F.col("title").startswith("Kept ")).select("id", "title", "author", "status", "word_count")


@query_of(
    "works_edited",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'New title' ELSE title END AS title, CASE WHEN id % 4 = 0 THEN NULL ELSE author END AS author,
 CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '2001-02-01' ELSE published_at END AS published_at, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'month' ELSE published_prec END AS published_prec,
 CASE id % 5 WHEN 0 THEN false WHEN 1 THEN true ELSE date_is_approx END AS date_is_approx, CASE WHEN id % 7 = 0 THEN 5 ELSE word_count END::BIGINT AS word_count, CASE WHEN id % 7 = 0 THEN 'manual' ELSE word_count_source END AS word_count_source,
 CASE WHEN id % 8 = 0 THEN 'record_only' ELSE status END AS status FROM works""",
    ("works",),
)
def works_edited(spark, sf_dir):
    works = table(spark, sf_dir, "works")
    i = F.col("id")
    edits = works.select(
        "id", F.when(i % 3 == 0, " New title ").when(i % 3 == 1, " ").alias("title"), F.when(i % 4 == 0, "").alias("author"), F.when(i % 5 == 0, " ").when(i % 5 == 1, "2001/2").alias("published"),
        F.lit(True).alias("published_approx"), F.when(i % 7 == 0, 5).otherwise(-1).cast("long").alias("word_count"), F.when(i % 8 == 0, "record_only").alias("status"),
    )
    return catalog.edit_works(works, edits).select("id", "title", "author", "published_at", "published_prec", "date_is_approx", "word_count", "word_count_source", "status")


@query_of(
    "source_tags_copied",
    """, own AS (SELECT work_id, list_sort(list(DISTINCT name)) AS names FROM work_tags GROUP BY work_id)
SELECT id AS work_id, concat_ws('|', array_to_string(coalesce(names, []), '|'), CASE WHEN NOT list_contains(list_transform(coalesce(names, []), lambda x: lower(x)), lower(summary)) THEN summary END, 'Extra') AS tags FROM works LEFT JOIN own ON id = own.work_id WHERE id % 2 = 0 AND names IS NOT NULL""",
    ("works", "work_tags"),
)
def source_tags_copied(spark, sf_dir):
    works = table(spark, sf_dir, "works").withColumn("source_tags", F.array("summary", F.lit("Extra")))
    tags = table(spark, sf_dir, "work_tags")
    merged = catalog.copy_source_tags(works, tags, tags.filter("work_id % 2 = 0").select("work_id"))
    return merged.select("work_id", F.array_join("tags", "|").alias("tags"))


@query_of(
    "file_badges",
    "SELECT work_id, count(*) AS n_files, bool_or(seq % 4 = 0) AS missing FROM files GROUP BY work_id",
    ("files",),
)
def file_badges(spark, sf_dir):
    files = table(spark, sf_dir, "files").withColumn("rel_path", F.concat_ws("/", "work_id", "format_detail", "seq"))
    return view.file_badges(view.with_presence(files, files.filter("seq % 4 <> 0").select("rel_path")))


@query_of(
    "explanations",
    """SELECT id, coalesce(substr(published_at, 1, CASE published_prec WHEN 'year' THEN 4 WHEN 'month' THEN 7 ELSE 10 END), '') AS draft,
 CASE published_prec WHEN 'year' THEN '只知道年份' WHEN 'month' THEN '只知道年月' WHEN 'day' THEN '完整日期' ELSE '没有日期' END || CASE WHEN date_is_approx THEN '，数值为估算' ELSE '' END AS date_title,
 CASE word_count_source WHEN 'ao3' THEN 'AO3 给出的官方字数，精确' ELSE '字数未知，可以自己填' END AS count_title, CASE language WHEN 'en' THEN 'English' WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'Français' WHEN 'zh' THEN '中文-普通话 國語' WHEN 'ja' THEN '日本語' END AS label,
 CASE language_label WHEN 'English' THEN 'en' WHEN 'Deutsch' THEN 'de' END AS code FROM works""",
    ("works",),
)
def explanations(spark, sf_dir):
    works = table(spark, sf_dir, "works")
    return works.select("id", dates.draft(F.col("published_at"), F.col("published_prec")).alias("draft"), codes.date_title(F.col("published_prec"), F.col("date_is_approx")).alias("date_title"), codes.count_title(F.col("word_count_source")).alias("count_title"), codes.language_label(F.col("language")).alias("label"), codes.language_code(F.col("language_label")).alias("code"))


@query_of("pending_note", "SELECT string_agg(title, '|' ORDER BY title) AS titles, (SELECT count(*) > 3 FROM pending WHERE NOT dismissed AND title IS NOT NULL) AS more FROM (SELECT title FROM pending WHERE NOT dismissed AND title IS NOT NULL ORDER BY title LIMIT 3)", ("pending",))
def pending_note(spark, sf_dir):
    return view.pending_note(table(spark, sf_dir, "pending")).select(F.array_join("titles", "|").alias("titles"), "more")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)



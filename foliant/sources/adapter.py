"""Library-shaped tables over the driver's star schema. The statements run alike in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "works": """SELECT o_orderkey AS id, concat(c_name, ' tale ', cast(o_orderkey % 97 AS string)) AS title, c_name AS author, o_orderpriority AS summary,
       CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(substr(cast(cast(o_orderdate AS date) AS string), 1, 4), '-01-01')
         WHEN 2 THEN concat(substr(cast(cast(o_orderdate AS date) AS string), 1, 7), '-01') ELSE cast(cast(o_orderdate AS date) AS string) END AS published_at,
       CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'year' WHEN 2 THEN 'month' ELSE 'day' END AS published_prec,
       o_orderkey % 7 = 0 AS date_is_approx,
       CASE WHEN o_orderkey % 11 = 0 THEN cast(0 AS bigint) ELSE cast(floor(o_totalprice) AS bigint) END AS word_count,
       CASE o_orderkey % 3 WHEN 0 THEN 'ao3' WHEN 1 THEN 'estimate' ELSE NULL END AS word_count_source,
       CASE c_nationkey % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'zh' WHEN 4 THEN 'ja' ELSE NULL END AS language,
       CASE c_nationkey % 6 WHEN 0 THEN 'English' WHEN 1 THEN 'Deutsch' WHEN 3 THEN 'Chinese' ELSE NULL END AS language_label,
       CASE o_orderkey % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'translation' ELSE NULL END AS translation_role,
       cast(o_orderkey * 13 AS string) AS external_id,
       CASE WHEN o_orderkey % 8 = 3 THEN concat('Read in ', c_mktsegment, '!') ELSE NULL END AS my_comment,
       CASE WHEN o_orderkey % 6 = 1 THEN cast(cast(o_orderdate AS date) AS string) ELSE NULL END AS completed_at,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('http://example.test/works/', cast(o_orderkey * 13 AS string)) ELSE NULL END AS source_url,
       CASE WHEN o_orderkey % 6 = 2 THEN split(concat('Canon ', c_mktsegment, ',', o_orderpriority), ',') ELSE NULL END AS source_tags,
       CASE WHEN o_orderstatus = 'P' THEN 'record_only' ELSE 'has_file' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "files": """SELECT l_orderkey AS work_id, CASE l_returnflag WHEN 'A' THEN 'html' WHEN 'R' THEN 'pdf' ELSE 'other' END AS format_class,
       CASE l_returnflag WHEN 'A' THEN 'html' WHEN 'R' THEN 'pdf' ELSE 'epub' END AS format_detail,
       row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS version, sum(cast(l_quantity AS bigint)) AS size_bytes, l_linenumber AS seq
FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linenumber""",
    "work_tags": """SELECT DISTINCT l_orderkey AS work_id, CASE WHEN l_orderkey % 2 = 0 THEN p_type ELSE lower(p_type) END AS name FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "works_series": """SELECT o_orderkey AS work_id, o_custkey AS series_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS position FROM orders WHERE o_orderkey % 7 <> 5
UNION ALL SELECT o_orderkey, cast(1000000000 + floor(o_custkey / 3) AS bigint), CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 5 END FROM orders WHERE o_orderkey % 10 = 3""",
    "relations": """SELECT a.o_orderkey AS work_a, b.o_orderkey AS work_b FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 12 IN (0, 1, 2, 3, 6, 10)
UNION ALL SELECT a.o_orderkey, b.o_orderkey FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 2 WHERE a.o_orderkey % 12 = 6
UNION ALL SELECT a.o_orderkey, b.o_orderkey FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 3 WHERE a.o_orderkey % 12 = 6""",
    "pending": """SELECT cast(user_id AS string) AS external_id, event_id AS from_work_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS title, value < 50 AS dismissed FROM events WHERE event_type IN ('error', 'signup')""",
}
#: Tasks for each input split of lineitem. Its rows are nearly all groups of their own, so what is grouped before a shuffle
#: only fills the memory of the task that reads a split; dealt by work first, they are grouped and numbered in smaller tasks.
DEALT = 8
TABLES = ("orders", "customer", "lineitem", "part", "events", "documents", "pages", "labels")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One library table; the star-schema tables it reads are put in as inline relations."""
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t} " in f" {sql} ".replace("\n", " ")}
    if "lineitem" in used:
        lines = used["lineitem"]
        used["lineitem"] = lines.repartition(DEALT * max(1, lines.rdd.getNumPartitions()), "l_orderkey")
    for t in used:
        sql = f" {sql} ".replace("\n", " ").replace(f" {t} ", f" {{{t}}} ")
    return spark.sql(sql, **used)


def with_views(*names: str) -> str:
    """WITH clause of the same tables for SQL."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)

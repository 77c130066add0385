"""Operator 6: mixing sources to target weights.

Tokens are summed per source; each source gets a target; target / size is its repetition rate. A document is
emitted floor(rate) times, plus once more if a hash-seeded Bernoulli draw with probability rate - floor(rate) hits.

Defined results: a null text has size 0; a null source is a source of its own and the last one; repeated rows
are mixed each on its own and draw alike; an empty table gives an empty result; other columns are not read.
Sources are aggregated before anything is joined, so a source of any share of the rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mixing-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: (source, source_size), one row per source. Adds target: the words the mix takes of it.

    Targets are min(cap * size, level * weight) with the level at which they use share of all sizes: resharing
    the excess of capped sources by weight ends there. Sources sorted by cap * size / weight are capped in that
    order, so the level is the first one that the next source's ratio is not under. One row per source is
    sorted here, never rows of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    rows = rows.withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("most_before", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.col("budget") - F.col("most_before")) / (F.col("all_weight") - F.col("weight_before")))
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return rows.withColumn("at", level).select(
        "source", "source_size", F.when(F.col("at").isNull() | (F.col("most") <= F.col("at") * F.col("weight")), F.col("most")).otherwise(F.col("at") * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, keep: list[str] = ()) -> DataFrame:
    """Every document with size, source_size, target and copies: how often the mix takes it.

    keep names further columns of docs to carry along.
    """
    # own names, so that no carried column clashes
    sized = docs.select(F.struct("doc_id", "source", *[c for c in keep if c not in ("doc_id", "source")]).alias("_row"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"))
    sizes = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    # A stored table has a known size, so the planner broadcasts it only under the session's threshold.
    targets = common.store(source_targets(sizes, weights, share, cap), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    joined = sized.join(targets, F.col("_source").eqNullSafe(F.col("source"))).withColumn("_rate", rate)
    copies = F.floor("_rate") + F.when(draw < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return joined.select("_row.*", F.col("_size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document's row as often as the mix takes it, with the columns of docs."""
    names = docs.columns
    plain = docs.select(F.struct(*names).alias("_doc"), "doc_id", "source", "text")
    mixed = mix(plain, keep=["_doc"], **options)
    return mixed.filter("copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SOURCES_SQL = r"""
sized AS (SELECT {cols}, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {table}),
srcs AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM srcs),
ratios AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS ratio FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM ratios),
level AS (SELECT min_by(level, ratio) AS lvl FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, CASE WHEN lvl IS NULL OR most <= lvl * weight THEN most ELSE lvl * weight END AS target FROM ratios LEFT JOIN level ON true),
mixed AS (SELECT s.*, t.source_size, t.target, floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies
    FROM (SELECT *, ('0x' || substr(md5('mixing-1:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS draw FROM sized) s
    JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets) t ON s.source IS NOT DISTINCT FROM t.source)
"""
OP6_SQL = "WITH " + SOURCES_SQL.format(cols="doc_id, source", table="documents") + "SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM mixed"
QUERIES = {"op6_mixing": op6_mixing}
SQL = {"op6_mixing": OP6_SQL}

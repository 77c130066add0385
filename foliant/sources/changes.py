"""What changed between two states of a table, and counts that are kept up by changes instead of counted anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feed(before: DataFrame, after: DataFrame, key: str, state: int) -> DataFrame:
    """key, kind (added, changed, removed) and state of the rows that differ. Keys are unique in both; a column that one
    side lacks is null there."""
    columns = sorted((set(before.columns) | set(after.columns)) - {key})
    whole = lambda df: F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in columns])
    old = before.select(F.col(key).alias("_old"), whole(before).alias("_b"))
    new = after.select(F.col(key).alias("_new"), whole(after).alias("_a"))
    # columns of either side have one type, so that their rows can be compared
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.to_json("_a", {"ignoreNullFields": "false"}).eqNullSafe(F.to_json("_b", {"ignoreNullFields": "false"})), "changed")
    return old.join(new, F.col("_old") == F.col("_new"), "full").select(F.coalesce("_new", "_old").alias(key), kind.alias("kind"), F.lit(state).alias("state")).filter("kind is not null")


def updated(rows: DataFrame, feeds: DataFrame, key: str, first: int = 0) -> DataFrame:
    """rows with updated_at, the last state that added or changed them; first where no feed names them."""
    last = feeds.filter("kind <> 'removed'").groupBy(F.col(key).alias("_key")).agg(F.max("state").alias("_last"))
    return rows.join(last, rows[key] == last["_key"], "left").withColumn("updated_at", F.coalesce("_last", F.lit(first))).drop("_key", "_last")


def counted(links: DataFrame, by: list[str]) -> DataFrame:
    """by and n, the number of links of each."""
    return links.groupBy(*by).agg(F.count("*").alias("n"))


def delta(before: DataFrame, after: DataFrame, touched: DataFrame, on: str, by: list[str]) -> DataFrame:
    """Plus and minus rows (by, n) of an edit that changed the links of touched only. touched: on."""
    keys = touched.select(on).distinct()
    signed = lambda df, sign: df.join(keys, on, "left_semi").select(*by, F.lit(sign).cast("long").alias("n"))
    return signed(before, -1).unionByName(signed(after, 1)).groupBy(*by).agg(F.sum("n").alias("n")).filter("n <> 0")


def kept_up(counts: DataFrame, deltas: DataFrame, by: list[str]) -> DataFrame:
    """counts after deltas. What reaches zero is pruned; less than zero means that the counts were of other links."""
    total: Column = F.sum("n")
    summed = counts.select(*by, "n").unionByName(deltas.select(*by, "n")).groupBy(*by).agg(total.alias("n"))
    checked = F.when(F.col("n") < 0, F.raise_error(F.lit("counts do not belong to these links"))).otherwise(F.col("n"))
    return summed.filter("n <> 0").withColumn("n", checked.cast("long"))

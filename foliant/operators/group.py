"""Grouping of ranked works: each unclaimed work in rank order claims its direct unclaimed neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant import storage
from foliant.functions import text
from foliant.operators.components import components

FAR = 2**62
#: Links that one task walks at most; larger components are decided in rounds.
WALK_LINKS = 200_000


def claim(ranks: DataFrame, claimers: DataFrame, members: DataFrame) -> DataFrame:
    """ranks: id, rank. claimers: (claimer, via), members: (via, member); a claimer claims the members of its via.
    Gives id, rank and anchor, as the walk in rank order would.

    Works that no link touches are their own anchors. Links fall into components, which do not see each other: if all
    links together are few, one task walks them; else components are found, those of few links are walked, many to a
    task, and the others are decided in rounds. So the length of a chain costs no rounds unless it is longer than a task walks.
    """
    rank_of = lambda name: ranks.select(F.col("id").alias(name), F.col("rank").alias(f"{name}_rank"))
    claiming = claimers.distinct().join(rank_of("claimer"), "claimer").select(F.col("claimer").alias("id"), "via", F.lit(True).alias("claims"), F.col("claimer_rank").alias("rank"))
    claimed = members.distinct().join(rank_of("member"), "member").select(F.col("member").alias("id"), "via", F.lit(False).alias("claims"), F.col("member_rank").alias("rank"))
    links = storage.store(claiming.unionByName(claimed), "links")
    n = links.count()
    if n <= WALK_LINKS:
        found = walked(links.withColumn("bucket", F.lit(0)))
    else:
        # the works of a via hang together by its first one, so that only works are nodes and each pair is one edge
        hubs = links.groupBy("via").agg(F.min("id").alias("a"))
        edges = links.join(hubs, "via").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
        parts = components(storage.store(edges, "edges"))
        own = links.join(parts.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        own = storage.store(own, "component-links")
        sizes = storage.store(own.groupBy("root").agg(F.count("*").alias("n")), "component-sizes")
        few = F.col("n") <= WALK_LINKS // 4
        small = own.join(sizes.filter(few).select("root"), "root", "left_semi")
        # buckets of whole components, of half of what a task walks on average
        found = walked(small.withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(1 + 2 * n // WALK_LINKS))).drop("root"))
        large = sizes.filter(~few)
        if not large.isEmpty():
            found = found.unionByName(in_rounds(storage.store(own.join(large.select("root"), "root", "left_semi").drop("root"), "large-links")))
    found = storage.store(found, "anchors")
    return ranks.select("id", "rank").join(found, "id", "left").select("id", "rank", F.coalesce("anchor", "id").alias("anchor"))


def walk(links: pd.DataFrame) -> pd.DataFrame:
    """The walk itself over whole components: id and anchor. Members of a via are claimed once, so it is linear."""
    members: dict = {}
    vias: dict = {}
    for i, via, claims in zip(links["id"], links["via"], links["claims"], strict=True):
        if claims:
            vias.setdefault(i, []).append(via)
        else:
            members.setdefault(via, []).append(i)
    order = links[["rank", "id"]].drop_duplicates().sort_values(["rank", "id"])["id"]
    anchors: dict = {}
    for i in order:
        if i not in anchors:
            anchors[i] = i
            for via in vias.get(i, ()):
                for m in members.pop(via, ()):
                    anchors.setdefault(m, i)
    return pd.DataFrame({"id": list(anchors), "anchor": list(anchors.values())})


def walked(links: DataFrame) -> DataFrame:
    """id and anchor. links: id, via, claims, rank and bucket; a component is in one bucket as a whole."""
    kind = links.schema["id"].dataType.simpleString()
    return links.groupBy("bucket").applyInPandas(walk, f"id {kind}, anchor {kind}")


def in_rounds(links: DataFrame) -> DataFrame:
    """id and anchor, in rounds over undecided works: with an anchor among the works that would claim it and no
    undecided one before that, a work joins the first such anchor; without undecided ones it is an anchor. Per via only
    the first anchor and the first undecided claimer count, so a via of n works costs n rows a round and not n * n. Each
    round is a written table."""
    claiming, claimed = (links.filter(F.col("claims") == kind).select("id", "via", "rank") for kind in (True, False))
    state = storage.store(links.select("id", "rank", F.lit(None).cast(links.schema["id"].dataType).alias("anchor")).distinct(), "rounds")
    while True:
        seen = claiming.join(state.select("id", "anchor"), "id")
        per_via = seen.groupBy("via").agg(F.min(F.when(F.col("anchor") == F.col("id"), F.struct("rank", "id"))).alias("v"), F.min(F.when(F.col("anchor").isNull(), F.col("rank"))).alias("u"))
        met = claimed.join(per_via, "via")
        judged = met.groupBy("id").agg(F.min(F.when(F.col("v.rank") < F.col("rank"), F.col("v"))).alias("first"), F.min(F.when(F.col("u") < F.col("rank"), F.col("u"))).alias("open"))
        joined = state.join(judged, "id", "left")
        decided = F.when(F.col("first").isNotNull() & (F.coalesce("open", F.lit(FAR)) > F.col("first.rank")), F.col("first.id")).when(F.col("first").isNull() & F.col("open").isNull(), F.col("id"))
        step = storage.store(joined.select("id", "rank", F.coalesce("anchor", decided).alias("anchor")), "rounds")
        storage.discard(state)
        state = step
        if not state.filter("anchor is null").limit(1).count():
            return state.select("id", "anchor")


def emit(grouped: DataFrame, member_order: list) -> DataFrame:
    """Rows in display order: groups by their anchor's rank, the members of a group by member_order and rank."""
    best = grouped.groupBy("anchor").agg(F.min("rank").alias("group_rank"), F.count("*").alias("group_size"))
    placed = grouped.join(best, "anchor")
    inside = Window.partitionBy("anchor").orderBy(*member_order, "rank")
    return placed.withColumn("place", F.row_number().over(inside)).withColumn("depth", (F.col("place") > 1).cast("int"))


def by_translation(ranked: DataFrame, relations: DataFrame) -> DataFrame:
    """ranked: id, rank, translation_role. Originals first, then translations, then others."""
    from foliant.operators.view import edges

    both = edges(relations)
    claimers = both.select(F.col("work_id").alias("claimer"), F.col("work_id").alias("via"))
    members = both.select(F.col("work_id").alias("via"), F.col("other_id").alias("member"))
    role = F.when(F.col("translation_role") == "original", 0).when(F.col("translation_role") == "translation", 1).otherwise(2)
    grouped = claim(ranked.select("id", "rank"), claimers, members).join(ranked.select("id", "translation_role"), "id")
    return emit(grouped, [role])


def first_series(works_series: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """work_id and the series that comes first: by name without case where series (series_id, name) is given, else by id."""
    if series is None:
        return works_series.groupBy("work_id").agg(F.min("series_id").alias("series_id"))
    named = works_series.join(series.select("series_id", text.nocase(F.col("name")).alias("_name")), "series_id", "left")
    return named.groupBy("work_id").agg(F.min(F.struct("_name", "series_id"))["series_id"].alias("series_id"))


def by_series(ranked: DataFrame, works_series: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """An anchor claims the works that are in its first series; members stand by their position in it."""
    first = first_series(works_series, series).withColumnRenamed("work_id", "claimer")
    grouped = claim(ranked.select("id", "rank"), first.withColumnRenamed("series_id", "via"), works_series.select(F.col("series_id").alias("via"), F.col("work_id").alias("member")))
    own = first.select(F.col("claimer").alias("anchor"), "series_id")
    at = works_series.select(F.col("work_id").alias("id"), "series_id", "position")
    return emit(grouped.join(own, "anchor", "left").join(at, ["id", "series_id"], "left"), [F.col("position").asc_nulls_last()])

"""Classes of nodes that grow by further edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import common
from foliant.operators.components import components


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots as components() gives them, after further edges (a, b). Only edges between different components are
    worked on, as edges between their roots; where there are none, roots is returned as it is. roots is discarded
    otherwise."""
    at = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
    ends = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    across = common.store(ends.filter("a <> b").distinct(), "across-roots")
    if not across.limit(1).count():
        common.discard(across)
        return roots
    top = components(across)
    renamed = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    out = common.store(renamed.unionByName(top.join(roots.select("node"), "node", "left_anti")), "roots")
    for old in (across, top, roots):
        common.discard(old)
    return out

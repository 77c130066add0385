"""Connected components of an undirected edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant import storage


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b). Gives node and root, the smallest node of its component, for every node with an edge.

    Rounds of taking the smallest root among neighbours and then the root's own root; each round is a written
    table. Minima combine before the shuffle, so a node of any degree costs one row per task. edges is read in every
    round and should be a written table.
    """
    pairs = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).filter("x <> y")
    roots = storage.store(pairs.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("root")), "roots")
    while True:
        near = pairs.join(roots.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        # hooking: a node's root also learns the smaller root that the node has seen
        seen = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        hook = seen.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("hooked"))
        step = seen.join(hook, F.col("root") == F.col("r")).select("node", F.col("root").alias("was"), F.least("low", "hooked").alias("root"))
        step = storage.store(step, "roots")
        moved = step.filter("root <> was").limit(1).count()
        storage.discard(roots)
        roots = step.select("node", "root")
        roots._stored_at = step._stored_at
        if not moved:
            return roots

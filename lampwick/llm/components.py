"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise_at


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b); root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour and maps the links to
    what their ends are hooked to. At least half of the nodes of a component go
    in a round, so the rounds grow with the logarithm of the largest component.
    Only counts reach the driver. Null ends are dropped.
    """
    spark = links.sparkSession
    both = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, edges_at = materialise_at(both, "edges")
    roots = roots_at = None
    while edges.limit(1).count():
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks, hooks_at = materialise_at(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up")), "hooks")
        if roots is None:
            new = hooks.select("node", F.col("up").alias("root"))
        else:
            up = hooks.select(F.col("node").alias("root"), "up").hint("merge")
            new = roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        new, new_at = materialise_at(new, "roots")
        a, b = (hooks.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")).hint("merge") for c in "ab")
        moved = edges.join(a, "a").join(b, "b").where("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct()
        moved, moved_at = materialise_at(moved, "edges")
        for old in filter(None, (edges_at, hooks_at, roots_at)):
            discard(spark, old)
        edges, edges_at, roots, roots_at = moved, moved_at, new, new_at
    if roots is None:
        kind = links.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    # A node that is the root of others has no row of its own root only if it was never hooked; hooks cover every end.
    return roots

"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.tables import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least.hint("merge"), "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them.  Needs u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node reachable.

    ``edges`` has the columns u and v of one orderable type.  Alternates two
    star rewrites until each node points straight at its root; the number of
    rounds grows with the logarithm of the component size.  Every round is a
    stored table; minima are combined before the shuffle, and the joins back are
    merge joins whose hot partitions adaptive execution splits.
    """
    state = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = stored(_small_star(_large_star(state)), "edges")
        # Both rewrites keep a set of edges; a set that did not change is final.
        now = tuple(state.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()

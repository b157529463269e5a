"""Connected components of a distributed edge list.

Alternating large-star and small-star steps on (u, v) rows: every step is a
grouped minimum, so no component is ever collected, and the number of steps
grows with the logarithm of the longest path.  Hot nodes are safe because
minima are pre-aggregated; the edges of a node are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """(u, v) with u > v: each neighbour of a node is linked to the least of the node and its neighbours."""
    if larger:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    else:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if larger:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        moved = (joined.select(F.col("b").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select(F.col("a").alias("u"), F.col("m").alias("v"))))
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, u: str, v: str, name: str) -> DataFrame:
    """(node, component): the least reachable node for every node that has an edge to another.

    Null ends and loops are ignored; an empty edge list gives an empty table.
    """
    state = (edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
             .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = materialize(state, f"{name}-links")
    sign = None
    while True:
        state = materialize(_star(_star(state, True), False), f"{name}-links")
        # done when nothing moves: the same rows, by count and by sums of their ends
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == sign:
            break
        sign = (now["n"], now["h"])
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

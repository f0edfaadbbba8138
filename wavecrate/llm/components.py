"""Connected components of an edge table by alternating star contractions.

Each round lets every node point its larger neighbours, then its smaller ones,
at its least neighbour (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). Minima are combined before the shuffle and joined back, so a hub
of a large component is a join key whose rows Spark can split, never one task's
group. Rounds end when no edge changes; their number grows with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrate.llm.scratch import materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"),
        F.coalesce(F.bit_xor(F.xxhash64("b", "a")), F.lit(0)).alias("x"),
    ).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (a, b) with a > b, each once."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # Each edge (a, b), a > b: seen from b, its larger neighbour a is sent to the least of b's star.
        out = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("low").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("low"))
        held = edges.join(least, "a")
        out = held.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of one orderable type); root is its component's least node.

    Nulls and self loops are ignored; repeated edges count once. Nodes without an
    edge have no row; an empty table gives an empty result.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    now = materialize(now.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        now = materialize(_star(_star(now, large=True), large=False), "stars")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)

"""Connected components by alternating large-star and small-star rounds.

Each round joins edges with the smallest neighbour of each node, as DataFrame
operations only; lineage is cut by a reliable checkpoint each round, and the
number of rounds grows with the logarithm of the component size, long chains included.
A node of very many edges is pre-aggregated by the partial minimum and its join
partition is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): each node of an edge and the smallest node that it reaches.

    Null ends and loops are dropped; edges may repeat and come in either direction.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    now = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        # Large star: every larger neighbour of u is tied to the smallest of u and its neighbours.
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        tied = now.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    # At the end every node other than the smallest has one edge, to the smallest.
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

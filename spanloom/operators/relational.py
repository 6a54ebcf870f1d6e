"""Sequence and edge operators as joins of token and edge rows.

The in-row form of ``spanloom.plans`` needs no shuffle and is what queries use. These
joins say the same relationally: they check it, serve sentences of extreme length, and
compose with other tables. The key of every join holds the sentence, so partitioning by
sentence serves a whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["doc_id", "sentence_id", "sentence_idx"]


def adjacent(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of token rows at neighbouring positions: (key, start, end)."""
    a = first.select(*KEY, F.col("position").alias("start"))
    b = second.select(*KEY, (F.col("position") - 1).alias("start"))
    return a.join(b, [*KEY, "start"]).select(*KEY, "start", (F.col("start") + 2).alias("end"))


def gap(first: DataFrame, second: DataFrame, low: int, high: int | None, lazy: bool) -> DataFrame:
    """For each first token the nearest (lazy) or farthest second token with low to high tokens between: (key, start, end)."""
    a, b = first.select(*KEY, F.col("position").alias("start")), second.select(*KEY, F.col("position").alias("stop"))
    between = F.col("stop") >= F.col("start") + 1 + low
    if high is not None:
        between = between & (F.col("stop") <= F.col("start") + 1 + high)
    best = (F.min if lazy else F.max)("stop")
    return a.join(b, KEY).where(between).groupBy(*KEY, "start").agg((best + 1).cast("int").alias("end"))


def runs(rows: DataFrame) -> DataFrame:
    """Maximal runs of neighbouring positions (gaps and islands): (key, start, end)."""
    from pyspark.sql import Window

    order = Window.partitionBy(*KEY).orderBy("position")
    islands = rows.withColumn("_island", F.col("position") - F.row_number().over(order))
    return islands.groupBy(*KEY, "_island").agg(F.min("position").alias("start"), (F.max("position") + 1).cast("int").alias("end")).drop("_island")


def hop(sources: DataFrame, edges: DataFrame, targets: DataFrame, direction: str = "out", label: Column | None = None) -> DataFrame:
    """Sources joined over one edge with targets: (key, source, target), a row for each edge."""
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    e = edges if label is None else edges.where(label)
    e = e.select(*KEY, F.col(near).alias("source"), F.col(far).alias("target"))
    a = sources.select(*KEY, F.col("position").alias("source"))
    b = targets.select(*KEY, F.col("position").alias("target"))
    return a.join(e, [*KEY, "source"]).join(b, [*KEY, "target"]).select(*KEY, "source", "target")


def exists_path(sentences: DataFrame, paths: DataFrame) -> DataFrame:
    """Sentences that have a path."""
    return sentences.join(paths.select(*KEY).distinct(), KEY, "left_semi")


def roots(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """Tokens that no edge leads to."""
    return tokens.select(*KEY, "position").join(edges.select(*KEY, F.col("dst").alias("position")), [*KEY, "position"], "left_anti")

"""Reachability and shortest paths along outgoing edges.

The edges of a sentence are gathered into its row, where a search by levels runs from
each start; nodes seen before drop out, so cycles end. One shuffle by sentence serves
paths of any length: no level is a job of its own, and nothing is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.plans.path import once
from spanloom.plans.symbols import materialise

from .relational import KEY

_SEEN = "array<struct<node:int,before:int,distance:int>>"
_STATE = f"struct<frontier:array<int>,nodes:array<int>,seen:{_SEEN}>"


def _search(source: Column, pairs: Column, most: int | None) -> Column:
    """Each node reached, with its distance and the smallest node before it on a shortest path; the source first."""
    begin = F.struct(F.array(source).alias("frontier"), F.array(source).alias("nodes"), F.array(F.struct(source.alias("node"), F.lit(None).cast("int").alias("before"), F.lit(0).alias("distance"))).alias("seen")).cast(_STATE)
    levels = F.size(pairs) if most is None else F.least(F.size(pairs), F.lit(most))

    def turn(acc: Column, level: Column) -> Column:
        leaving = F.filter(pairs, lambda e: F.array_contains(acc["frontier"], e["src"]) & ~F.array_contains(acc["nodes"], e["dst"]))
        steps = F.sort_array(F.transform(leaving, lambda e: F.struct(e["dst"].alias("node"), e["src"].alias("before"))))
        fresh = once(steps, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["node"] != x["node"])))

        def add(fresh: Column) -> Column:
            nodes = F.transform(fresh, lambda x: x["node"])
            seen = F.transform(fresh, lambda x: F.struct(x["node"].alias("node"), x["before"].alias("before"), level.alias("distance")))
            return F.struct(nodes.alias("frontier"), F.concat(acc["nodes"], nodes).alias("nodes"), F.concat(acc["seen"], seen).alias("seen")).cast(_STATE)

        return F.when(F.size(acc["frontier"]) == 0, acc).otherwise(once(fresh, add))

    rounds = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, begin, turn)["seen"]


def _searched(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(key, source, _seen), a row for each start token."""
    sources = starts.select(*KEY, F.col("position").cast("int").alias("source")).distinct()
    pairs = F.collect_set(F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")))
    gathered = edges.where("src is not null and dst is not null").groupBy(*KEY).agg(pairs.alias("_pairs"))
    both = sources.join(gathered, KEY, "left")
    none = F.array().cast("array<struct<src:int,dst:int>>")
    both = materialise(both, "_given", F.coalesce("_pairs", none)).drop("_pairs")
    return materialise(both, "_seen", _search(F.col("source"), F.col("_given"), most)).drop("_given")


def distances(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(key, source, node, distance): fewest edges from each start token to each node it reaches, itself at 0."""
    return _searched(starts, edges, most).select(*KEY, "source", F.inline("_seen")).select(*KEY, "source", "node", "distance")


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, source, node), the start included."""
    return distances(starts, edges).drop("distance")


def has_path(starts: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, source, node) for targets that a start reaches."""
    wanted = targets.select(*KEY, F.col("position").alias("node"))
    return reachable(starts, edges).join(wanted, [*KEY, "node"], "left_semi")


def shortest_path(starts: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, source, node, path): one shortest path a pair, of equal ones the one with the smallest nodes from the end."""
    wanted = targets.groupBy(*KEY).agg(F.collect_set(F.col("position").cast("int")).alias("_wanted"))
    rows = _searched(starts, edges).join(wanted, KEY)
    rows = materialise(rows, "_nodes", F.transform("_seen", lambda x: x["node"]))

    def back(path: Column, _: Column) -> Column:
        at = F.array_position("_nodes", F.get(path, F.lit(0))).cast("int") - 1
        return F.concat(F.array(F.get(F.col("_seen"), at)["before"]), path)

    def path(x: Column) -> Column:
        begin = F.array(x["node"])
        return F.when(x["distance"] == 0, begin).otherwise(F.aggregate(F.sequence(F.lit(1), x["distance"]), begin, back))

    reached = F.filter("_seen", lambda x: F.array_contains("_wanted", x["node"]))
    paths = F.transform(reached, lambda x: F.struct(x["node"].alias("node"), path(x).alias("path")))
    return materialise(rows, "_paths", paths).select(*KEY, "source", F.inline("_paths"))

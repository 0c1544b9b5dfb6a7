"""Connected components of a graph by alternating stars, as joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import cluster

#: More than any graph needs: rounds grow with the logarithm of the longest path.
_MOST_ROUNDS = 100


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """`edges` (a, b; about n of them) with m, the least of a's neighbours and itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select("a", F.least("m", "a").alias("m"), "degree")
    return cluster.split_join(edges, least, ["a"], "degree", n).drop("degree")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node in it) of every node of `edges` (a, b), both long.

    Large stars link the greater neighbours of a node to its least one, small
    stars its lesser neighbours; edges become stars around the least nodes in a
    number of rounds about logarithmic in the longest path. Hubs are split.
    Without edges between different nodes the result is empty.
    """
    greater, lesser = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = cluster.written(edges.where("a <> b").select(greater, lesser).distinct())
    state = _state(now)
    for _ in range(_MOST_ROUNDS):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cluster.written(large)
        small = _with_least(large, state[0]).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
        now = cluster.written(small.select(F.col("x.a").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct())
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components still change after {_MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

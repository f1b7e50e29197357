"""Connected components of an edge table by alternating stars.

A large star links every node's larger neighbours to its smallest one, a small star links a node and
its smaller neighbours to the smallest of them. Each is one partial aggregate and one join, so a hub
never sits in one task as a group; rounds repeat until the edges stay as they are. Every round's
edges are a written table, so a lost executor repeats at most that round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, larger end first, loops gone."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _ordered(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _ordered(linked.unionByName(low.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component) for every node of `edges` (u, v long): component is the smallest node reached.

    A round's edges are written by at most `most` tasks if that is given.
    """

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = materialize(_ordered(edges), "edges", most=most)
    before = state(now)
    while before[0]:
        now = materialize(_small_star(_large_star(now)), "edges", most=most)
        after = state(now)
        if after == before:
            break
        before = after
    low = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return low.unionByName(roots)

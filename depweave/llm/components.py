"""Connected components by alternating stars, and star edges of linked groups.

Edges are two longs. Each round points all neighbours of a node at the least of them (large star), then all
smaller ones (small star), until the edges stay the same; then every edge leads to its component's least node.
A node's least neighbour is aggregated before the shuffle, so a centre with very many neighbours is no hot key.
Every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. edges: distinct (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; edges: two long columns in any order, loops ignored."""
    a, b = edges.columns
    now = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == tuple(got):
            break
        mark = tuple(got)
        now = materialise(_star(_star(now, True), False), "stars")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

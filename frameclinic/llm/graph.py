"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameclinic.sources.workspace import materialise


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every node's neighbours (larger ones only, or smaller ones) point to the node's least neighbour or itself."""
    if larger_only:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if larger_only:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, root) for every node of ``edges`` (u, v: long): root is the least id it can reach.

    Alternates two star steps: each node's larger neighbours, then its smaller ones, are hung on its least
    neighbour. Every step is a grouped minimum and a join whose large keys Spark may split; the edge table never
    grows, and it is written after each round, so a lost executor costs one round. Stops when a round changes
    nothing. Self-loops and repeated edges are allowed; an empty table gives an empty table.
    """
    now = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label
    )
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state or seen[0] == 0:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("root"))
            ).distinct()
        state = seen
        now = materialise(_to_least(_to_least(now, True), False), label)

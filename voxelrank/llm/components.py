"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelrank.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: the neighbours of each node on one side are tied to its least neighbour or itself."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialise(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # so that hot nodes can be split in the join
    tied = near.join(least, "u")
    if large:
        made = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return made.filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, component``: the least node of the component of every node of ``edges`` (u, v).

    Each round is two shuffles of the edges with map-side minima, cut by a written table; its count
    of rounds grows with the logarithm of the longest path.  Stops when a round changes nothing.
    """
    now = materialise(edges.filter("u != v").distinct())
    seen = None
    for _ in range(rounds):
        now = materialise(_star(_star(now, True), False))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Candidate pools of the re-ranker: construction, split, stratified sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelrank.session import written

#: The multiplier and modulus of the order that stands for random draws.
MULTIPLIER, MODULUS = 2654435761, 1 << 32


def draw(*ids: Column, seed: int = 0) -> Column:
    """A fixed pseudo-random order of ids, the same on every engine."""
    total = F.lit(seed).cast("long")
    for i in ids:
        total = (total * 31 + i.cast("long")) % MODULUS
    high, low = F.shiftright(total, 16), total % 65536  # by halves, as the whole product can exceed a long
    return (high * MULTIPLIER % MODULUS * 65536 + low * MULTIPLIER) % MODULUS


def build_pools(hits: DataFrame, vectors: DataFrame, top: int = 100, least: int = 8) -> DataFrame:
    """``row_idx, source, patch_id, rank, dist``: hits within ``top``, each patch once at its first rank, mapped to a vector; pools under ``least`` go."""
    once = Window.partitionBy("row_idx", "source", "patch_id").orderBy("rank")
    kept = hits.filter(F.col("rank") <= top).withColumn("_r", F.row_number().over(once)).filter("_r = 1").drop("_r")
    mapped = kept.join(vectors.select("patch_id").distinct(), "patch_id", "left_semi")
    return mapped.withColumn("_n", F.count("*").over(Window.partitionBy("row_idx", "source"))).filter(F.col("_n") >= least).select("row_idx", "source", "patch_id", "rank", "dist")


def pool_arrays(pools: DataFrame) -> DataFrame:
    """One row for each query: ``row_idx, source, members`` sorted by rank; bounded by the pool's ``top``."""
    return pools.groupBy("row_idx", "source").agg(F.array_sort(F.collect_list(F.struct("rank", "patch_id", "dist"))).alias("members"))


def split_rows(rows: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """``row_idx, split``: rows (with both sources) in a fixed random order, cut at banker-rounded shares."""
    keys = rows.select("row_idx").distinct().withColumn("_o", draw(F.col("row_idx"), seed=seed))
    # Written, as a range partitioning that ran twice could cut elsewhere. A rank is the rank in its range and the rows in the ranges before.
    dealt = written(keys.repartitionByRange("_o", "row_idx").withColumn("_p", F.spark_partition_id()))
    every = Window.partitionBy(F.lit(1))  # one row for each range
    ranges = dealt.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.sum("_c").over(every).alias("_n"), (F.sum("_c").over(every.orderBy("_p")) - F.col("_c")).alias("_before"))
    placed = dealt.join(F.broadcast(ranges), "_p").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_o", "row_idx")))
    cut1, cut2 = F.bround(F.col("_n") * F.lit(train)), F.bround(F.col("_n") * F.lit(train)) + F.bround(F.col("_n") * F.lit(val))
    return placed.select("row_idx", F.when(F.col("_i") <= cut1, "train").when(F.col("_i") <= cut2, "val").otherwise("test").alias("split"))


def uniform_sample(pools: DataFrame, target: int = 64, seed: int = 0) -> DataFrame:
    """``target`` members of each pool, all ranks alike; smaller pools are taken whole.  Another ``seed`` (an epoch's) draws anew."""
    order = Window.partitionBy("row_idx", "source").orderBy(draw(F.col("row_idx"), F.col("patch_id"), seed=seed), "patch_id")
    return pools.withColumn("_p", F.row_number().over(order)).filter(F.col("_p") <= target).drop("_p")


def stratified_sample(pools: DataFrame, target: int = 64, bands: tuple[int, int] = (10, 40), wants: tuple[int, int, int] = (16, 24, 24), seed: int = 0) -> DataFrame:
    """Pool members drawn by rank band, back-filled from the rest; pools within ``target`` are taken whole.

    Adds ``band`` 0, 1 or 2.
    """
    band = F.when(F.col("rank") <= bands[0], 0).when(F.col("rank") <= bands[1], 1).otherwise(2)
    q = Window.partitionBy("row_idx", "source")
    based = pools.withColumn("band", band).withColumn("_o", draw(F.col("row_idx"), F.col("patch_id"), seed=seed)).withColumn("_n", F.count("*").over(q))
    based = based.withColumn("_r", F.row_number().over(Window.partitionBy("row_idx", "source", "band").orderBy("_o", "patch_id")))
    want = F.element_at(F.array(*map(F.lit, wants)), F.col("band") + 1)
    fill = F.row_number().over(q.orderBy((F.col("_r") > want).cast("int"), F.when(F.col("_r") > want, F.lit(0)).otherwise(F.col("band")), "_o", "patch_id"))
    return based.withColumn("_p", fill).filter((F.col("_n") <= target) | (F.col("_p") <= target)).drop("_o", "_n", "_r", "_p")

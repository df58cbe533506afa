"""Evidence of several views fused for each patch; one hit for each slice; ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_KEY = ("normal_idx", "depth_idx", "rot_idx")


def evidence(candidates: DataFrame, local: str = "top2_mean") -> DataFrame:
    """``query_id, patch_id, g, l, l_best, g_view, l_view`` from rows of (query_id, view_idx, branch, patch_id, score).

    ``g`` is the best global score, ``l`` the local one: the ``max``, or the mean of the best two.
    Ties go to the earliest view.
    """
    best = F.struct("score", (-F.col("view_idx")).alias("v"))
    locals_ = F.sort_array(F.collect_list(F.when(F.col("branch") == "local", F.col("score"))), asc=False)  # at most one for each view
    grouped = candidates.groupBy("query_id", "patch_id").agg(
        F.max(F.when(F.col("branch") == "global", best)).alias("gb"), F.max(F.when(F.col("branch") == "local", best)).alias("lb"), locals_.alias("ls")
    )
    two = F.slice("ls", 1, 2)
    mean = F.aggregate(two, F.lit(0.0), lambda s, x: s + x) / F.size(two)
    l = F.col("lb.score") if local == "max" else F.when(F.size("ls") > 0, mean)  # noqa: E741
    return grouped.select("query_id", "patch_id", F.col("gb.score").alias("g"), l.alias("l"), F.col("lb.score").alias("l_best"), (-F.col("gb.v")).alias("g_view"), (-F.col("lb.v")).alias("l_view"))


def fuse(found: DataFrame, w_global: float = 1.0, w_local: float = 0.35) -> DataFrame:
    """Adds ``score`` (missing branches contribute 0), ``branch`` and ``view_idx`` of provenance."""
    g, l_best = w_global * F.col("g"), w_local * F.col("l_best")
    is_global = F.coalesce(g >= l_best, F.col("g").isNotNull())
    return found.select(
        "query_id", "patch_id", (F.coalesce(g, F.lit(0.0)) + F.coalesce(w_local * F.col("l"), F.lit(0.0))).alias("score"),
        F.when(is_global, "global").otherwise("local").alias("branch"), F.when(is_global, F.col("g_view")).otherwise(F.col("l_view")).alias("view_idx"),
    )


def with_manifest(hits: DataFrame, manifest: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Manifest columns by patch_id; rows without one are dropped unless asked for."""
    return hits.join(manifest, "patch_id", "left" if keep_missing else "inner")


def dedup_slices(hits: DataFrame, key: tuple[str, ...] = SLICE_KEY) -> DataFrame:
    """The best hit of each source slice for each query; ties to the smaller patch."""
    order = Window.partitionBy("query_id", *key).orderBy(F.desc("score"), "patch_id")
    return hits.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """Adds ``rank`` from 1 by score, ties to the smaller patch, and keeps the first k."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "patch_id")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def candidate_counts(hits: DataFrame) -> DataFrame:
    """``query_id, n_candidates, n_slices``."""
    return hits.groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.count_distinct(F.struct(*SLICE_KEY)).alias("n_slices"))


def scale_filter(hits: DataFrame, scales: tuple[int, ...]) -> DataFrame:
    """Allow-list of scales; a null scale is rejected."""
    return hits.filter(F.col("scale").isin(*scales))

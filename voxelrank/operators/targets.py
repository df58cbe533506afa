"""Soft relevance targets from distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelrank.functions.numbers import finite


def soft_targets(hits: DataFrame, key: Sequence[str], divisor: float = 3.0, low: float = 1e-3, high: float = 1e4, quantiles: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """Adds ``tau, logit, prob`` to each hit of a query.

    tau = (q_hi - q_lo) / divisor within [low, high]; logit = -d / tau; prob is the softmax over the
    finite distances.  Without any, tau is 1, logits 0 and probabilities uniform.
    """
    q, d = Window.partitionBy(*key), F.col("_d")
    spread = F.percentile(d, F.lit(quantiles[1])).over(q) - F.percentile(d, F.lit(quantiles[0])).over(q)
    tau = F.least(F.greatest(F.greatest(spread, F.lit(1e-6)) / divisor, F.lit(low)), F.lit(high))
    some = F.count(d).over(q) > 0
    based = hits.withColumn("_d", finite(F.col("dist"))).withColumn("tau", F.when(some, tau).otherwise(1.0)).withColumn("_some", some).withColumn("_n", F.count("*").over(q))
    logit = F.when(~F.col("_some"), F.lit(0.0)).otherwise(-F.col("_d") / F.col("tau"))
    based = based.withColumn("logit", logit)
    e = F.when(F.col("logit").isNotNull(), F.exp(F.col("logit") - F.max("logit").over(q))).otherwise(0.0)
    return based.withColumn("_e", e).withColumn("prob", F.when(F.col("_some"), F.col("_e") / F.sum("_e").over(q)).otherwise(F.lit(1.0) / F.col("_n"))).drop("_d", "_some", "_n", "_e")


def adaptive_tau(hits: DataFrame, key: Sequence[str], ratio: float = 10.0, least: float = 1e-6) -> DataFrame:
    """``tau`` of each query: (median - min) / ln(ratio) over the finite distances, at least ``least``."""
    d = finite(F.col("dist"))
    return hits.groupBy(*key).agg(F.greatest((F.percentile(d, F.lit(0.5)) - F.min(d)) / F.log(F.lit(ratio)), F.lit(least)).alias("tau"))

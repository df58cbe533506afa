"""Volumes side by side: regridding, orientation, spacing checks, foreground statistics of random slices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelrank.operators.volume import opened, resample
from voxelrank.plans.generators import random_planes


def regrid_shape(shape: tuple[int, ...], spacing: tuple[float, ...], wanted: tuple[float, ...]) -> tuple[int, ...]:
    """Grid of the same physical extent at another spacing, rounded half to even."""
    return tuple(round(n * (s / w)) for n, s, w in zip(shape, spacing, wanted))


def regrid(volume: np.ndarray, spacing: tuple[float, float, float], wanted: tuple[float, float, float]) -> np.ndarray:
    """Linear resampling from the same origin, axis by axis; voxels more than half a voxel outside are 0."""
    out = volume.astype(np.float64)
    for axis, (n, s, w) in enumerate(zip(regrid_shape(volume.shape, spacing, wanted), spacing, wanted)):
        at = np.arange(n) * (w / s)
        held = np.minimum(at, out.shape[axis] - 1)
        lo = held.astype(int)
        hi = np.minimum(lo + 1, out.shape[axis] - 1)
        shape = [1] * 3
        shape[axis] = n
        f = (held - lo).reshape(shape)
        inside = (at <= out.shape[axis] - 0.5).reshape(shape)
        out = np.where(inside, out.take(lo, axis) * (1 - f) + out.take(hi, axis) * f, 0.0)
    return out


def orient(volume: np.ndarray, perm: tuple[int, int, int], flips: tuple[bool, bool, bool]) -> np.ndarray:
    """Axes permuted, then reversed where flagged: what a row of ``best_orientation`` stands for."""
    return np.ascontiguousarray(np.transpose(volume, perm)[tuple(slice(None, None, -1 if f else 1) for f in flips)])


def distance_bound(shape: tuple[int, int, int], spacing: tuple[float, float, float] | None = None) -> float:
    """Twice the diagonal of the box of voxel centres: no two-way distance exceeds it."""
    return 2 * math.sqrt(sum(((n - 1) * s) ** 2 for n, s in zip(shape, spacing or (1.0, 1.0, 1.0))))


def spacing_mismatch(a: tuple[float, ...], b: tuple[float, ...]) -> float:
    """Largest ratio of two spacings over the axes, whichever is larger; 1 if equal."""
    return max(max(x / (y + 1e-12), y / (x + 1e-12)) for x, y in zip(a, b))


def slice_foreground(spark: SparkSession, labels: np.ndarray, n: int, size: int = 64, step: float = 1.0, least: float = 0.0, seed: int = 42) -> DataFrame:
    """``plane_id, fg_ratio``: share of labelled pixels on random planes through the volume's ball, at least ``least``.

    ``n`` planes are tried; depths are uniform within half the diagonal, so planes may miss the volume.
    """
    shared = spark.sparkContext.broadcast(labels)
    half = distance_bound(labels.shape) / 4
    drawn = random_planes(spark, n, labels.shape[::-1], seed).withColumn("depth", (F.pmod(F.xxhash64(F.lit(seed), F.lit("ball"), "plane_id"), F.lit(1 << 52)) / float(1 << 51) - 1) * half)

    def run(batches):
        for b in batches:
            share = [float((resample(opened(shared.value), {"nx": p["nx"], "ny": p["ny"], "nz": p["nz"], "depth": p["depth"], "rot": p["rotation"], "size_px": size, "step": step}, 0, 0) > 0).mean()) for p in b.to_dict("records")]
            yield pd.DataFrame({"plane_id": b["plane_id"], "fg_ratio": share})

    return drawn.mapInPandas(run, "plane_id long, fg_ratio double").filter(F.col("fg_ratio") >= least)


def slice_statistics(slices: DataFrame) -> DataFrame:
    """``n`` and mean, median, quantiles and range of the foreground and background shares."""
    out = [F.count("*").alias("n")]
    for name, c in (("fg", F.col("fg_ratio")), ("bg", 1 - F.col("fg_ratio"))):
        q = lambda p, c=c: F.percentile(c, F.lit(p))
        out += [x.alias(f"{name}_{k}") for k, x in (("mean", F.avg(c)), ("median", q(0.5)), ("p05", q(0.05)), ("p25", q(0.25)), ("p75", q(0.75)), ("p95", q(0.95)), ("min", F.min(c)), ("max", F.max(c)))]
    return slices.agg(*out)

"""Volumes as tables of voxels ``z, y, x, value``: orientation search, turning, regridding, and planes of them.

A volume here is dense: each voxel has one row.  Shapes and spacings are in the order z, y, x.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelrank.operators.builder import orientations
from voxelrank.operators.registration import regrid_shape

AXES = ("z", "y", "x")


def _turned(shape: tuple[int, ...], perm: tuple[int, ...], flips: tuple[bool, ...]) -> list[Column]:
    """Where a voxel goes when the axes are permuted, then reversed where flagged."""
    return [(F.lit(shape[p] - 1) - F.col(AXES[p])) if f else F.col(AXES[p]) for p, f in zip(perm, flips)]


def oriented(voxels: DataFrame, shape: tuple[int, int, int], perm: tuple[int, int, int], flips: tuple[bool, bool, bool]) -> DataFrame:
    """The voxels of a volume of ``shape`` in one of the 48 orientations; its new shape is ``shape`` in the order of ``perm``.

    Other columns stay.  The length of an axis matters only where it is reversed.
    """
    others = [c for c in voxels.columns if c not in (*AXES, "value")]
    return voxels.select(*others, *(c.cast("int").alias(a) for a, c in zip(AXES, _turned(shape, perm, flips))), "value")


def orientation_scores(fixed: DataFrame, moving: DataFrame, fixed_shape: tuple[int, int, int], moving_shape: tuple[int, int, int], stride: int = 4) -> DataFrame:
    """``perm, flips, corr, n`` of the 48 orientations of ``moving`` against ``fixed``; best first.

    Both are cropped to their common shape at the leading corner and every ``stride``-th voxel of each axis
    counts.  A volume that is constant there correlates with nothing (0).  Voxels that take no part are
    dropped before the join, so about 48 / stride^3 of the moving ones are shuffled, once.
    """
    if stride < 1:
        raise ValueError("stride must be at least 1")
    options = []
    for perm, flips in orientations():
        at = _turned(moving_shape, perm, flips)
        common = [min(a, moving_shape[p]) for a, p in zip(fixed_shape, perm)]
        used = F.lit(True)
        for c, n in zip(at, common):
            used = used & (c < n) & (c % stride == 0)
        place = F.struct(F.array(*map(F.lit, perm)).alias("perm"), F.array(*map(F.lit, flips)).alias("flips"), *(c.cast("int").alias(a) for a, c in zip(AXES, at)))
        options.append(F.when(used, place))
    laid = moving.select("value", F.explode(F.array_compact(F.array(*options))).alias("o")).select("o.*", F.col("value").cast("double").alias("b"))
    on_grid = (F.col("z") % stride == 0) & (F.col("y") % stride == 0) & (F.col("x") % stride == 0)
    kept = fixed.filter(on_grid).select(*(F.col(a).cast("int").alias(a) for a in AXES), F.col("value").cast("double").alias("a"))
    sums = laid.join(kept, list(AXES)).groupBy("perm", "flips").agg(F.covar_pop("a", "b").alias("ab"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.count("*").alias("n"))
    corr = F.when((F.col("sa") > 1e-12) & (F.col("sb") > 1e-12), F.col("ab") / (F.col("sa") * F.col("sb"))).otherwise(F.lit(0.0))
    scored = sums.select("perm", "flips", corr.alias("corr"), "n")
    return scored.orderBy(F.desc("corr"), "perm", "flips")


def regridded(voxels: DataFrame, shape: tuple[int, int, int], spacing: tuple[float, float, float], wanted: tuple[float, float, float]) -> DataFrame:
    """Linear resampling of ``voxels`` from the same origin to another spacing; more than half a voxel outside is 0.

    Each voxel is laid out to the at most (2 s / w + 2)^3 places of the new grid it has a share in, and shares are summed with
    partial sums before the one shuffle.  Every place of the new grid has a row.
    """
    if min(*spacing, *wanted) <= 0:
        raise ValueError("spacings must be positive")
    laid, weight = voxels.select(*AXES, F.col("value").cast("double").alias("value")), F.lit(1.0)
    for axis, n, m, s, w in zip(AXES, shape, regrid_shape(shape, spacing, wanted), spacing, wanted):
        if not m:
            raise ValueError(f"the new grid has no voxel along {axis}")
        ratio, top, i, t = w / s, n - 1, F.col(axis), F.col(f"to_{axis}")
        first = F.greatest(F.floor((i - 1) / F.lit(ratio)) - 1, F.lit(0)).cast("int")
        last = F.when(i >= top, F.lit(m - 1)).otherwise(F.least(F.ceil((i + 1) / F.lit(ratio)) + 1, F.lit(m - 1))).cast("int")
        laid = laid.withColumn(f"to_{axis}", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
        at = t * F.lit(ratio)
        held = F.least(at, F.lit(float(top)))
        low = F.floor(held)
        share = held - low
        laid = laid.filter((low == i) | ((low + 1 == i) & (share > 0)))
        inside = F.when(at <= F.lit(top + 0.5), F.lit(1.0)).otherwise(F.lit(0.0))
        weight = weight * inside * F.when(low == i, 1 - share).otherwise(share)
    out = laid.groupBy(*(f"to_{a}" for a in AXES)).agg(F.sum(weight * F.col("value")).alias("value"))
    return out.select(*(F.col(f"to_{a}").alias(a) for a in AXES), "value")


def planes(voxels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``plane, values``: the voxels of each z, row by row, for each volume that ``keys`` tell apart; one shuffle, a plane is one row."""
    packed = voxels.groupBy(*keys, F.col("z").cast("int").alias("plane")).agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col("value").cast("double").alias("value")))).alias("v"))
    return packed.select(*keys, "plane", F.col("v.value").alias("values"))

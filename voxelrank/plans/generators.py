"""Lateral plans: normals, depths, slices, patch grids, sliding windows, views and crops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelrank.functions import geometry as G

GOLDEN = (1 + math.sqrt(5)) / 2


def fibonacci_normals(spark: SparkSession, k: int, distinct: bool = True) -> DataFrame:
    """``normal_idx, nx, ny, nz``: k spherical Fibonacci directions; equal ones at 6 decimals once, the first."""
    t = F.col("id") + 0.5
    z = 1 - 2 * t / k if k > 0 else F.lit(0.0)
    r, theta = F.sqrt(F.greatest(1 - z * z, F.lit(0.0))), 2 * math.pi * t / GOLDEN
    raw = spark.range(max(k, 0)).select("id", (r * F.cos(theta)).alias("x"), (r * F.sin(theta)).alias("y"), z.alias("z"))
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    made = raw.select("id", *((F.col(c) / n).alias(f"n{c}") for c in "xyz"))
    if distinct:
        same = Window.partitionBy(*(F.round(c, 6) for c in ("nx", "ny", "nz"))).orderBy("id")
        made = made.withColumn("_r", F.row_number().over(same)).filter("_r = 1").drop("_r")
    return made.withColumnRenamed("id", "normal_idx")


def axis_normals(spark: SparkSession, diagonals: bool = False) -> DataFrame:
    """The three axes and, if asked for, the 12 edge and 8 corner diagonals."""
    axes = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    signs = (-1, 1)
    edges = [v for a in signs for b in signs for v in ((a, b, 0), (a, 0, b), (0, a, b))]
    corners = [(a, b, c) for a in signs for b in signs for c in signs]
    rows = [(i, *map(float, v)) for i, v in enumerate(axes + (edges + corners if diagonals else []))]
    df = spark.createDataFrame(rows, "normal_idx long, nx double, ny double, nz double")
    n = G.unit(G.vec(F.col("nx"), F.col("ny"), F.col("nz")))
    return df.select("normal_idx", *(n[c].alias(f"n{c}") for c in "xyz"))


def depths(low: Column, high: Column, step: float, margin: float = 0.0) -> Column:
    """Array of depths from low + margin by ``step`` up to high - margin; empty if nothing fits."""
    if step <= 0 or margin < 0:
        raise ValueError("step must be positive and margin not negative")
    first, last = low + margin, high - margin
    count = F.floor((last - first) / step).cast("int")
    return F.when(last >= first, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: first + i * F.lit(step))).otherwise(F.array().cast("array<double>"))


def depths_linspace(low: Column, high: Column, num: int) -> Column:
    """Array of ``num`` evenly spaced depths; one depth is the low end."""
    if num <= 1:
        return F.array(low)
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda i: low + i * (high - low) / F.lit(num - 1))


def slice_plan(normals: DataFrame, dims: tuple[float, float, float], step: float, margin: float = 0.0, rotations: tuple[float, ...] = (0.0,)) -> DataFrame:
    """``normal_idx, nx, ny, nz, depth_idx, depth, rot_idx, rotation``: a lateral expansion, no shuffle."""
    half = G.depth_bounds(G.vec(F.col("nx"), F.col("ny"), F.col("nz")), dims)
    laid = normals.select("*", F.posexplode(depths(-half, half, step, margin)).alias("depth_idx", "depth"))
    turned = F.array(*(F.lit(float(r)) for r in (rotations or (0.0,))))
    return laid.select("*", F.posexplode(turned).alias("rot_idx", "rotation"))


def slice_count(normals: DataFrame, dims, step: float, margin: float = 0.0, n_rotations: int = 1) -> DataFrame:
    """``n_slices`` of the plan without laying it out."""
    half = G.depth_bounds(G.vec(F.col("nx"), F.col("ny"), F.col("nz")), dims)
    return normals.agg(F.sum(F.size(depths(-half, half, step, margin)) * max(n_rotations, 1)).cast("long").alias("n_slices"))


def patch_grid(spark: SparkSession, size: int, scales: tuple[int, ...], overlap: float) -> DataFrame:
    """``scale, patch_row, patch_col, x0, y0, x1, y1``; windows and steps round half to even."""
    cell = spark.createDataFrame([(s,) for s in scales], "scale int")
    window = F.bround(F.lit(float(size)) / F.col("scale")).cast("int")
    step = F.greatest(F.lit(1), F.bround(window * F.lit(1 - overlap)).cast("int"))
    n = F.floor((F.lit(size) - window) / step).cast("int")
    ordinals = F.sequence(F.lit(0), n)
    laid = cell.select("scale", window.alias("w"), step.alias("s"), F.explode(ordinals).alias("patch_row"), n.alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("patch_col"))
    x, y = F.col("patch_col") * F.col("s"), F.col("patch_row") * F.col("s")
    return laid.select("scale", "patch_row", "patch_col", x.alias("x0"), y.alias("y0"), (x + F.col("w")).alias("x1"), (y + F.col("w")).alias("y1")).filter(f"x1 <= {size} AND y1 <= {size}")


def patch_count(slices: DataFrame, grid: DataFrame) -> DataFrame:
    """``scale, per_slice, n_patches``: patches that the slices counted by ``slice_count`` hold before any filter."""
    per = grid.groupBy("scale").agg(F.count("*").alias("per_slice"))
    return per.crossJoin(F.broadcast(slices)).select("scale", "per_slice", (F.col("per_slice") * F.col("n_slices")).alias("n_patches"))  # one row of slices


def sliding_starts(total: Column, window: Column, overlap: float) -> Column:
    """Array of window starts; the last window is flush with the end."""
    o = min(max(overlap, 0.0), 0.95)
    step = F.greatest(F.lit(1), F.bround(window * F.lit(1 - o)).cast("int"))
    last = total - window
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct(F.array_append(F.sequence(F.lit(0), last, step), last))))


def reduce_positions(positions: Column, most: int) -> Column:
    """At most ``most`` of the positions, evenly spread; a single one is the middle."""
    n = F.size(positions)
    if most <= 1:
        pick = F.array(F.element_at(positions, (F.floor(n / 2) + 1).cast("int")))
    else:
        at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(most - 1))).cast("int"))
        pick = F.array_distinct(F.transform(at, lambda i: F.element_at(positions, i + 1)))
    return F.when(n <= most, positions).otherwise(pick)


def crop_boxes(w: Column, h: Column, overlap: float = 0.5, most: int = 3, min_side: int = 64, aspect: float = 1.35, mode: str = "auto", scales: tuple[int, ...] = (2,), cap: int = 8) -> Column:
    """Array of local windows (x0, y0, x1, y1) of an image of width ``w`` and height ``h``.

    ``auto`` slides at most ``most`` squares along the long axis of images of at least ``aspect``;
    ``force`` slides up to ``cap`` and lays a grid for each scale over the top-left square; ``off``
    gives none.  Small or repeated boxes take no place.
    """
    kind = "array<struct<x0:int,y0:int,side:int>>"
    side, long = F.least(w, h), F.greatest(w, h)
    most = cap if mode == "force" else most
    starts = reduce_positions(sliding_starts(long, side, overlap), most)
    slid = F.transform(starts, lambda p: F.struct(F.when(w > h, p).otherwise(0).alias("x0"), F.when(w > h, 0).otherwise(p).alias("y0"), side.alias("side")))
    none = F.array().cast(kind)
    boxes = F.when(w != h, slid).otherwise(none)
    wanted = F.lit(mode == "force") | ((F.lit(mode) == "auto") & (long / side >= aspect))
    if mode == "force":
        for s in (x for x in scales if x > 1):
            win = F.greatest(F.lit(1), F.bround(side / F.lit(float(s))).cast("int"))
            grid = sliding_starts(side, win, overlap)
            boxes = F.concat(boxes, F.flatten(F.transform(grid, lambda y: F.transform(grid, lambda x: F.struct(x.alias("x0"), y.alias("y0"), win.alias("side"))))))
    fine = F.slice(F.array_distinct(F.filter(boxes, lambda b: b["side"] >= min_side)), 1, max(most, 1))
    return F.transform(F.when(wanted, fine).otherwise(none), lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), (b["x0"] + b["side"]).alias("x1"), (b["y0"] + b["side"]).alias("y1")))


def local_crops(images: DataFrame, **options) -> DataFrame:
    """``image_id, crop_id, x0, y0, x1, y1`` for rows of ``image_id, width, height``: the windows of ``crop_boxes``."""
    return images.select("image_id", F.posexplode(crop_boxes(F.col("width"), F.col("height"), **options)).alias("crop_id", "b")).select("image_id", "crop_id", "b.*")


def view_grid(spark: SparkSession, angles: tuple[float, ...] = (0, 90, 180, 270), flip_x: bool = True, flip_y: bool = False) -> DataFrame:
    """``view_idx, angle, flip_x, flip_y`` in the order angle, flip_x, flip_y."""
    rows = [(float(a), x, y) for a in angles for x in ((False, True) if flip_x else (False,)) for y in ((False, True) if flip_y else (False,))]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "view_idx int, angle double, flip_x boolean, flip_y boolean")


def random_planes(spark: SparkSession, n: int, dims: tuple[float, float, float], seed: int = 42) -> DataFrame:
    """``plane_id, nx, ny, nz, depth, rotation`` drawn from seeded hashes of the id: the same rows for any partitioning."""

    def u(what):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    gauss = [F.sqrt(-2 * F.log(u(f"a{c}"))) * F.cos(2 * math.pi * u(f"b{c}")) for c in "xyz"]
    n_ = G.unit(G.vec(*gauss))
    drawn = spark.range(n).select("id", n_.alias("n"))
    half = G.depth_bounds(F.col("n"), dims)
    return drawn.select(F.col("id").alias("plane_id"), *(F.col(f"n.{c}").alias(f"n{c}") for c in "xyz"), ((2 * u("depth") - 1) * half).alias("depth"), (360 * u("turn")).alias("rotation"))


def random_crops(planes: DataFrame, id_col: str = "plane_id", low: float = 0.3, high: float = 0.7, aspects: tuple[tuple[float, float], ...] = ((1, 1), (2, 1), (1, 2)), jitter: float = 0.15, seed: int = 42, attempts: int = 1) -> DataFrame:
    """Three size bins (0 is the largest) by each aspect for every plane: ``crop_bin, aspect_w, aspect_h, attempt, crop_cx, crop_cy, crop_rw, crop_rh``.

    All ``attempts`` of a plane follow each other, bin by bin and aspect by aspect, in one partition.
    """
    if not 1 <= attempts <= 1000:
        raise ValueError("attempts must be from 1 to 1000")
    edges = [low + (high - low) * i / 3 for i in range(4)]
    bins = F.array(*(F.struct(F.lit(b).alias("bin"), F.lit(edges[2 - b]).alias("lo"), F.lit(edges[3 - b]).alias("hi")) for b in range(3)))
    shapes = F.array(*(F.struct(F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h")) for w, h in aspects))
    laid = planes.select("*", F.explode(bins).alias("b")).select("*", F.explode(shapes).alias("a")).select("*", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))

    def u(what):
        return (F.pmod(F.xxhash64(F.lit(seed) + F.col("attempt") * 1_000_003, F.lit(what), F.col(id_col), F.col("b.bin"), F.col("a.w"), F.col("a.h")), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    middle = (F.col("b.lo") + F.col("b.hi")) / 2
    lo, hi = F.greatest(F.col("b.lo"), middle * (1 - jitter)), F.least(F.col("b.hi"), middle * (1 + jitter))
    size = lo + (hi - lo) * u("size")
    rw, rh = size * F.sqrt(F.col("a.w") / F.col("a.h")), size / F.sqrt(F.col("a.w") / F.col("a.h"))
    over = F.greatest(F.lit(1.0), rw, rh)
    return laid.select(*planes.columns, F.col("b.bin").alias("crop_bin"), F.col("a.w").alias("aspect_w"), F.col("a.h").alias("aspect_h"), "attempt", u("cx").alias("crop_cx"), u("cy").alias("crop_cy"), (rw / over).alias("crop_rw"), (rh / over).alias("crop_rh"))

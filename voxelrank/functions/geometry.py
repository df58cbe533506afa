"""Geometry of posed planes as column expressions: three-vectors are structs x, y, z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def vec(x, y, z) -> Column:
    return F.struct(*(v.cast("double").alias(n) if isinstance(v, Column) else F.lit(float(v)).alias(n) for v, n in zip((x, y, z), "xyz")))


def _xyz(v: Column):
    return v["x"], v["y"], v["z"]


def inner(a: Column, b: Column) -> Column:
    return sum((p * q for p, q in zip(_xyz(a), _xyz(b))), F.lit(0.0))


def length(a: Column) -> Column:
    return F.sqrt(inner(a, a))


def scale(a: Column, k: Column) -> Column:
    return vec(*(p * k for p in _xyz(a)))


def add(a: Column, b: Column) -> Column:
    return vec(*(p + q for p, q in zip(_xyz(a), _xyz(b))))


def cross(a: Column, b: Column) -> Column:
    (ax, ay, az), (bx, by, bz) = _xyz(a), _xyz(b)
    return vec(ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx)


def let(value: Column, f) -> Column:
    """``f(value)`` with the value evaluated once: a nested expression would repeat it at each use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def unit(a: Column) -> Column:
    return let(a, lambda v: let(F.struct(v.alias("v"), (length(v) + F.lit(TINY)).alias("n")), lambda s: vec(*(s["v"][c] / s["n"] for c in "xyz"))))


def _turned(n: Column, degrees: Column) -> Column:
    upright = F.abs(n["z"]) < 0.9
    ref = vec(F.when(upright, 0.0).otherwise(1.0), F.lit(0.0), F.when(upright, 1.0).otherwise(0.0))

    def turn(s):
        u, v, c, d = s["u"], s["v"], F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
        return F.struct(add(scale(u, c), scale(v, d)).alias("u"), add(scale(u, -d), scale(v, c)).alias("v"))

    flat = let(ref, lambda r: let(inner(r, n), lambda k: vec(*(r[c] - n[c] * k for c in "xyz"))))
    return let(let(unit(flat), lambda u: F.struct(u.alias("u"), cross(n, u).alias("v"))), turn)


def plane_basis(normal: Column, degrees: Column) -> Column:
    """Struct of the in-plane axes u and v: a reference axis made orthogonal to the normal, then turned by ``degrees``.

    The reference is z unless |nz| is at least 0.9, then x.
    """
    return let(unit(normal), lambda n: _turned(n, degrees))


def pixel_to_voxel(centre: Column, normal: Column, depth: Column, u: Column, v: Column, col: Column, row: Column, size: int, step: float) -> Column:
    """Voxel position of a pixel of a posed plane: centre + depth*n + in-plane offsets from the middle."""
    a, b = (col - F.lit((size - 1) / 2)) * F.lit(step), (row - F.lit((size - 1) / 2)) * F.lit(step)
    return let(unit(normal), lambda n: vec(*(centre[c] + n[c] * depth + u[c] * a + v[c] * b for c in "xyz")))


def depth_bounds(normal: Column, dims: tuple[float, float, float]) -> Column:
    """Largest |depth| of a box of voxel centres along a normal: half extents on the absolute normal."""
    return let(unit(normal), lambda n: sum((F.abs(p) * F.lit((d - 1) / 2) for p, d in zip(_xyz(n), dims)), F.lit(0.0)))


def crop_norm(cx: Column, cy: Column, rw: Column, rh: Column, width: int, height: int) -> Column:
    """Pixel box of a normalised crop, its edges clamped to the image; sizes and centres round half to even.

    A box that lies outside altogether becomes the nearest pixel.
    """

    def side(centre, share, n):
        size = F.greatest(F.bround(share * n).cast("int"), F.lit(1))
        start = F.bround(centre * (n - 1)).cast("int") - F.floor(size / 2).cast("int")
        held = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(n)).cast("int")
        return held(start), held(start + size)

    (x0, x1), (y0, y1) = side(cx, rw, width), side(cy, rh, height)
    outside = (x1 <= x0) | (y1 <= y0)
    x, y = F.least(x0, F.lit(width - 1)), F.least(y0, F.lit(height - 1))
    pixel = ((x0, x), (y0, y), (x1, F.least(x + 1, F.lit(width))), (y1, F.least(y + 1, F.lit(height))))
    return F.struct(*(F.when(outside, one).otherwise(box).alias(name) for name, (box, one) in zip(("x0", "y0", "x1", "y1"), pixel)))


def pose_distance(n1: Column, d1: Column, n2: Column, d2: Column, weight: float) -> Column:
    """Distance of the planes' foot points plus ``weight`` times the angle of their normals."""
    def far(s):
        a, b = s["a"], s["b"]
        gap = F.sqrt(sum(((a[c] * d1 - b[c] * d2) ** 2 for c in "xyz"), F.lit(0.0)))
        return gap + F.lit(weight) * F.acos(F.least(F.greatest(inner(a, b), F.lit(-1.0)), F.lit(1.0)))

    return let(F.struct(unit(n1).alias("a"), unit(n2).alias("b")), far)


def crop_area(is_crop: Column, rw: Column, rh: Column) -> Column:
    return F.when(is_crop, F.least(F.lit(1.0), F.greatest(F.lit(0.0), rw * rh))).otherwise(F.lit(1.0))


def mirror_x(x: Column, width: int) -> Column:
    return F.lit(width - 1) - x

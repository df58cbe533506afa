"""Distances of posed planes: chamfer of point lattices in closed form or by points, and of three corners."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lattice points held at once when many poses are compared.
POINTS = 1 << 20
POSE = ("nx", "ny", "nz", "depth", "rot", "step", "size_px", "x0", "y0", "h", "w")


def _axes(p):
    n = np.array([p["nx"], p["ny"], p["nz"]], float)
    n = n / (np.linalg.norm(n) + 1e-12)
    ref = np.array([0.0, 0, 1]) if abs(n[2]) < 0.9 else np.array([1.0, 0, 0])
    u = ref - n * (ref @ n)
    u = u / (np.linalg.norm(u) + 1e-12)
    v = np.cross(n, u)
    c, s = np.cos(np.radians(p["rot"])), np.sin(np.radians(p["rot"]))
    return n, c * u + s * v, -s * u + c * v


def lattice(p, grid: int) -> np.ndarray:
    """grid x grid points of a pose, relative to the volume's centre."""
    n, u, v = _axes(p)
    half = (p["size_px"] - 1) / 2
    a = (p["x0"] - half) * p["step"] + np.linspace(0, (p["w"] - 1) * p["step"], grid)
    b = (p["y0"] - half) * p["step"] + np.linspace(0, (p["h"] - 1) * p["step"], grid)
    return (p["depth"] * n + a[None, :, None] * u + b[:, None, None] * v).reshape(-1, 3)


def _frames(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_axes` of many poses, given as one array for each field."""
    unit = lambda a: a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-12)
    n = unit(np.stack([p["nx"], p["ny"], p["nz"]], 1))
    steep = (np.abs(n[:, 2]) >= 0.9).astype(float)
    ref = np.stack([steep, np.zeros(len(n)), 1 - steep], 1)
    u = unit(ref - n * (ref * n).sum(1, keepdims=True))
    v = np.cross(n, u)
    c, s = np.cos(np.radians(p["rot"]))[:, None], np.sin(np.radians(p["rot"]))[:, None]
    return n, c * u + s * v, -s * u + c * v


def _lattices(p: dict[str, np.ndarray], grid: int) -> np.ndarray:
    """:func:`lattice` of many poses: poses x points x 3."""
    n, u, v = _frames(p)
    half, t = (p["size_px"] - 1) / 2, np.linspace(0, 1, grid)
    along = lambda start, extent: ((start - half) * p["step"])[:, None] + ((extent - 1) * p["step"])[:, None] * t
    a, b = along(p["x0"], p["w"]), along(p["y0"], p["h"])
    points = (p["depth"][:, None] * n)[:, None, None] + a[:, None, :, None] * u[:, None, None] + b[:, :, None, None] * v[:, None, None]
    return points.reshape(len(n), -1, 3)


def _to_lattices(points: np.ndarray, p: dict[str, np.ndarray], grid: int) -> np.ndarray:
    """Distance of each point to its pose's nearest lattice point: project on the axes, round, clamp."""
    n, u, v = _frames(p)
    half, project = (p["size_px"] - 1) / 2, lambda axis: np.einsum("mki,mi->mk", points, axis)
    off2 = (project(n) - p["depth"][:, None]) ** 2
    for axis, start, extent in ((u, p["x0"], p["w"]), (v, p["y0"], p["h"])):
        at = project(axis) - ((start - half) * p["step"])[:, None]
        gap = ((extent - 1) * p["step"] / max(grid - 1, 1))[:, None]
        k = np.where(gap > 0, np.clip(np.floor(at / np.where(gap > 0, gap, 1) + 0.5), 0, grid - 1), 0)
        off2 += (at - k * gap) ** 2
    return np.sqrt(off2)


def chamfers(a: dict[str, np.ndarray], b: dict[str, np.ndarray], grid: int = 64, trim: float = 0.1) -> np.ndarray:
    """:func:`chamfer` in voxels of many pairs of poses at once, about POINTS points at a time."""
    keep = max(1, int(np.floor(grid * grid * (1 - min(max(trim, 0), 0.49)))))
    out, some = [], max(1, POINTS // (grid * grid))
    for lo in range(0, len(a["nx"]), some):
        p, q = ({k: x[lo : lo + some] for k, x in side.items()} for side in (a, b))
        both = (_to_lattices(_lattices(p, grid), q, grid), _to_lattices(_lattices(q, grid), p, grid))
        out.append(sum(np.partition(d, keep - 1, axis=1)[:, :keep].mean(1) for d in both))
    return np.concatenate(out) if out else np.empty(0)


def _trimmed(d: np.ndarray, trim: float) -> float:
    keep = max(1, int(np.floor(len(d) * (1 - min(max(trim, 0), 0.49)))))
    return float(np.partition(d, keep - 1)[:keep].mean())


def _nearest(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distance of each point to its nearest other point, in blocks of bounded size."""
    square = (others**2).sum(1)
    out = [((p**2).sum(1)[:, None] + square - 2 * p @ others.T).min(1) for p in np.array_split(points, -(-len(points) // 512))]
    return np.sqrt(np.maximum(np.concatenate(out), 0))


def chamfer(a, b, grid: int = 64, trim: float = 0.1, spacing: tuple[float, float, float] | None = None, mirror: bool = False) -> float:
    """Sum of the trimmed mean nearest distances in both directions.

    In voxels the lattices have orthogonal axes, so nearest points follow in closed form.  With a
    ``spacing`` (x, y, z) distances are physical; unequal spacings shear the lattices, and points
    are then compared directly.  ``mirror`` reflects ``b`` in x first, a check on laterality.
    """
    if spacing is None and not mirror:
        return float(chamfers(*({k: np.array([p[k]], float) for k in POSE} for p in (a, b)), grid, trim)[0])
    size = np.array(spacing or (1.0, 1.0, 1.0), float)
    x, y = lattice(a, grid) * size, lattice(b, grid) * size * ((-1, 1, 1) if mirror else (1, 1, 1))
    return _trimmed(_nearest(x, y), trim) + _trimmed(_nearest(y, x), trim)


def chamfer_column(a: Column, b: Column, grid: int = 64, trim: float = 0.1, spacing: tuple[float, float, float] | None = None, mirror: bool = False) -> Column:
    """The same for two struct columns with the fields of POSE; null where a pose is null."""

    @F.pandas_udf("double")
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        known = x["nx"].notna() & y["nx"].notna()
        if spacing is None and not mirror:
            out = np.full(len(x), np.nan)
            out[known] = chamfers(*({k: s.loc[known, k].to_numpy(float) for k in POSE} for s in (x, y)), grid, trim)
            return pd.Series(out).where(known.to_numpy(), None)
        out = [chamfer(p, q, grid, trim, spacing, mirror) if ok else None for ok, p, q in zip(known, x.to_dict("records"), y.to_dict("records"))]
        return pd.Series(out, dtype=float)

    return F.when(a.isNotNull() & b.isNotNull(), run(a, b))


def corner_chamfer(a: list[Column], b: list[Column], scale: float = 1.0) -> Column:
    """Mean nearest distance, averaged over both directions, between two triples of corner structs (x, y, z)."""

    def gap(p, q):
        return F.sqrt(sum(((p[c] - q[c]) ** 2 for c in "xyz"), F.lit(0.0)))

    there = [F.least(*(gap(p, q) for q in b)) for p in a]
    back = [F.least(*(gap(p, q) for p in a)) for q in b]
    return (sum(there[1:], there[0]) / len(a) + sum(back[1:], back[0]) / len(b)) * (scale / 2)


def with_chamfer(hits: DataFrame, grid: int = 64, trim: float = 0.1, spacing: tuple[float, float, float] | None = None) -> DataFrame:
    """Adds ``dist`` from struct columns ``query_pose`` and ``patch_pose``; poses travel, points never do."""
    return hits.withColumn("dist", chamfer_column(F.col("query_pose"), F.col("patch_pose"), grid, trim, spacing))

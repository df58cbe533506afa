"""Volumes: resampling of posed slices, validity and patch filters, encoding, the index build."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelrank.operators.distance import _axes
from voxelrank.operators.encoders import encode_all
from voxelrank.operators.quantiles import percentiles
from voxelrank.sources.files import VolumeFile, read_volume, voxels
from voxelrank.sources.png import encode_png

#: A slice counts if more than this share of it lies above this share of the intensity range.
VALID_SHARE, VALID_LEVEL = 0.25, 0.10
#: Patches that wait for the encoder at most.
BUFFER = 256


def synthetic_volume(shape: tuple[int, int, int] = (32, 32, 32)) -> np.ndarray:
    """An analytic ball with a wave inside: a stand-in for template volumes in tests."""
    z, y, x = np.meshgrid(*(np.linspace(-1, 1, n) for n in shape), indexing="ij")
    r2 = x * x + y * y + z * z
    return np.where(r2 < 0.8, 0.6 + 0.4 * np.sin(5 * x) * np.cos(4 * y + z), 0.0).astype(np.float32)


def opened(volume: np.ndarray | VolumeFile) -> np.ndarray:
    """The array of a volume; a file is opened where this is called, once for each worker."""
    return volume.array() if isinstance(volume, VolumeFile) else volume


def normalised_file(spark, path: str, axes: str = "ijk", low: float = 0.005, high: float = 0.995) -> VolumeFile:
    """A volume file whose tasks see it between two of its percentiles, clipped to [0, 1]; executors read its slabs for them."""
    lo, hi = percentiles(voxels(read_volume(spark, path, axes)), "value", (low, high))
    return VolumeFile(path, axes, lo, hi)


def normalise(volume: np.ndarray, low: float = 0.5, high: float = 99.5) -> np.ndarray:
    lo, hi = np.percentile(volume, [low, high])
    return np.clip((volume - lo) / max(hi - lo, 1e-12), 0, 1).astype(np.float32)


def resample(volume: np.ndarray, pose: dict, order: int = 1, outside: float | None = None) -> np.ndarray:
    """size x size image of a posed plane (trilinear, or nearest for labels), edges clamped; or ``outside`` for labels off the volume."""
    n, u, v = _axes(pose)
    size, step = int(pose["size_px"]), pose["step"]
    a = (np.arange(size) - (size - 1) / 2) * step
    at = pose["depth"] * n + a[None, :, None] * u + a[:, None, None] * v
    zyx = at[..., ::-1] + (np.array(volume.shape) - 1) / 2
    top = np.array(volume.shape) - 1
    if order == 0:
        i = np.clip(np.rint(zyx), 0, top).astype(int)
        near = volume[i[..., 0], i[..., 1], i[..., 2]]
        return near if outside is None else np.where(((zyx < -0.5) | (zyx > top + 0.5)).any(-1), outside, near)
    zyx = np.clip(zyx, 0, top)
    lo = np.minimum(zyx.astype(int), np.maximum(top - 1, 0))
    f = zyx - lo
    out = np.zeros(zyx.shape[:2])
    for corner in range(8):
        bit = np.array([corner >> 2 & 1, corner >> 1 & 1, corner & 1])
        i = np.minimum(lo + bit, top)
        out += volume[i[..., 0], i[..., 1], i[..., 2]] * np.where(bit, f, 1 - f).prod(-1)
    return out


def is_valid(image: np.ndarray, lo: float = 0.0, hi: float = 1.0) -> bool:
    return bool((image > lo + VALID_LEVEL * (hi - lo)).mean() > VALID_SHARE)


def fg_ratio_boxes(image: np.ndarray, boxes: np.ndarray, threshold: float = 0.05) -> np.ndarray:
    """Foreground share of boxes (x0, y0, x1, y1) by an integral image."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    total[1:, 1:] = (image > threshold).cumsum(0).cumsum(1)
    x0, y0, x1, y1 = boxes.T
    return (total[y1, x1] - total[y0, x1] - total[y1, x0] + total[y0, x0]) / ((x1 - x0) * (y1 - y0))


def pooled_encoder(dim: int = 64, seed: int = 7) -> Callable[[np.ndarray], np.ndarray]:
    """Default encoder: 16 x 16 pooled pixels through a seeded random projection, scaled to length 1."""
    turn = np.random.default_rng(seed).standard_normal((256, dim))

    def encode(image: np.ndarray) -> np.ndarray:
        r, c = (np.linspace(0, n, 17).astype(int) for n in image.shape)
        cells = np.array([image[r[i] : max(r[i + 1], r[i] + 1), c[j] : max(c[j + 1], c[j] + 1)].mean() for i in range(16) for j in range(16)])
        e = cells @ turn
        return e / max(np.linalg.norm(e), 1e-12)

    return encode


def build_index(poses: DataFrame, grid: DataFrame, volume: np.ndarray, encoder=None, size: int = 64, step: float = 0.5, min_fg: float = 0.05, images: bool = False) -> DataFrame:
    """Patch manifest with embeddings: resample each pose, keep valid slices and patches, encode; with ``images`` each patch also as a PNG in ``content``.

    ``poses`` is a slice plan; the patch grid (a few rows) and the volume are broadcast, a task
    works on its own poses.  ``patch_id`` follows from the indices, so it needs no global numbering.
    """
    cells = [tuple(r) for r in grid.select("scale", "patch_row", "patch_col", "x0", "y0", "x1", "y1").orderBy("scale", "patch_row", "patch_col").collect()]
    shared = poses.sparkSession.sparkContext.broadcast((volume, cells))
    encode = encoder or pooled_encoder()

    def centre(p, x0, y0, x1, y1, shape):
        """Voxel (x, y, z) of the middle pixel of a patch."""
        n, u, v = _axes({**p, "rot": p["rotation"]})
        a, b = (((lo + hi - 1) / 2 - (size - 1) / 2) * step for lo, hi in ((x0, x1), (y0, y1)))
        return (p["depth"] * n + a * u + b * v + (np.array(shape[::-1]) - 1) / 2).tolist()

    def run(batches):
        vol, cells = shared.value
        vol = opened(vol)
        boxes = np.array([c[3:] for c in cells])
        for b in batches:
            rows, cuts = [], []
            for p in b.to_dict("records"):
                image = resample(vol, {**p, "rot": p["rotation"], "size_px": size, "step": step})
                if not is_valid(image):
                    continue
                for k in np.flatnonzero(fg_ratio_boxes(image, boxes) >= min_fg):
                    s, r, c, x0, y0, x1, y1 = cells[k]
                    pid = ((p["normal_idx"] * 4096 + p["depth_idx"]) * 64 + p["rot_idx"]) * 4096 + int(k)
                    rows.append((pid, p["normal_idx"], p["depth_idx"], p["rot_idx"], p["nx"], p["ny"], p["nz"], p["depth"], p["rotation"], s, r, c, x0, y0, x1, y1, y1 - y0, x1 - x0, size, *centre(p, x0, y0, x1, y1, vol.shape)))
                    cuts.append(image[y0:y1, x0:x1])
                if len(cuts) >= BUFFER:
                    yield coded(rows, cuts)
                    rows, cuts = [], []
            yield coded(rows, cuts)

    def coded(rows, cuts):
        found = pd.DataFrame(rows, columns=names).assign(embedding=pd.Series(encode_all(encode, cuts), dtype=object))
        return found.assign(content=pd.Series([encode_png(c) for c in cuts], dtype=object)) if images else found

    names = ["patch_id", "normal_idx", "depth_idx", "rot_idx", "normal_x", "normal_y", "normal_z", "depth_vox", "rotation_deg", "scale", "patch_row", "patch_col", "x0", "y0", "x1", "y1", "patch_h", "patch_w", "slice_size_px", "center_x_vox", "center_y_vox", "center_z_vox"]
    kinds = ["long"] * 1 + ["int"] * 3 + ["double"] * 5 + ["int"] * 10 + ["double"] * 3
    held = ["embedding array<double>"] + ["content binary"] * images
    return poses.mapInPandas(run, ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), *held]))


def label_counts(poses: DataFrame, labels: np.ndarray, size: int = 64, step: float = 0.5) -> DataFrame:
    """``normal_idx, depth_idx, rot_idx, label, n``: pixels of each label on every posed slice, 0 off the volume.

    The annotation volume is broadcast; a task samples its own poses at the nearest voxels.
    """
    shared = poses.sparkSession.sparkContext.broadcast(labels)

    def run(batches):
        for b in batches:
            rows = []
            for p in b.to_dict("records"):
                found, n = np.unique(resample(opened(shared.value), {**p, "rot": p["rotation"], "size_px": size, "step": step}, 0, 0), return_counts=True)
                rows += [(p["normal_idx"], p["depth_idx"], p["rot_idx"], int(k), int(c)) for k, c in zip(found, n)]
            yield pd.DataFrame(rows, columns=["normal_idx", "depth_idx", "rot_idx", "label", "n"])

    return poses.mapInPandas(run, "normal_idx long, depth_idx long, rot_idx long, label long, n long")


def percentile_normalise(df: DataFrame, value: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Adds ``normalised``: the value between two percentiles of the table, clipped to [0, 1]."""
    lo, hi = percentiles(df, value, (low, high))
    if lo is None:
        return df.withColumn("normalised", F.lit(None).cast("double"))
    scaled = (F.col(value) - F.lit(lo)) / F.lit(max(hi - lo, 1e-12))
    return df.withColumn("normalised", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def fg_bg_ratio(voxels: DataFrame, value: Column, threshold: float) -> DataFrame:
    """``n, fg_ratio, bg_ratio`` of a voxel table."""
    fg = F.count_if(value > threshold)
    return voxels.agg(F.count("*").alias("n"), (fg / F.count("*")).alias("fg_ratio"), (1 - fg / F.count("*")).alias("bg_ratio"))

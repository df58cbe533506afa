"""Query images: preparation, foreground crops, views and their embeddings, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelrank.operators.encoders import BATCH, encode_all
from voxelrank.operators.pools import draw


def to_gray(image: np.ndarray) -> np.ndarray:
    """Channel mean, scaled to [0, 1] if any value is over 1, clipped."""
    image = np.asarray(image, float)
    image = image.mean(-1) if image.ndim == 3 else image
    return np.clip(image / 255 if image.size and image.max() > 1 else image, 0, 1)


def crop_foreground(image: np.ndarray, threshold: float = 0.05, least: float = 0.05) -> np.ndarray:
    """Bounding box of the foreground, if its share is at least ``least``; else the whole image."""
    fg = image > threshold
    if not fg.size or fg.mean() < least or not fg.any():
        return image
    rows, cols = np.flatnonzero(fg.any(1)), np.flatnonzero(fg.any(0))
    return image[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]


def pad_square(image: np.ndarray) -> np.ndarray:
    """Zero padding to a square, the image in the middle."""
    h, w = image.shape
    side = max(h, w)
    out = np.zeros((side, side), image.dtype)
    y, x = (side - h) // 2, (side - w) // 2
    out[y : y + h, x : x + w] = image
    return out


def turn(image: np.ndarray, angle: float, flip_x: bool = False, flip_y: bool = False) -> np.ndarray:
    """Counter-clockwise rotation (exact for right angles, else bilinear on the same canvas), then flips."""
    if angle % 90 == 0:
        out = np.rot90(image, int(angle // 90) % 4)
    else:
        h, w = image.shape
        c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
        y, x = np.mgrid[:h, :w]
        y, x = y - (h - 1) / 2, x - (w - 1) / 2
        sx, sy = c * x - s * y + (w - 1) / 2, s * x + c * y + (h - 1) / 2
        inside = (sx >= 0) & (sx <= w - 1) & (sy >= 0) & (sy <= h - 1)
        x0, y0 = np.clip(sx.astype(int), 0, max(w - 2, 0)), np.clip(sy.astype(int), 0, max(h - 2, 0))
        fx, fy = np.clip(sx - x0, 0, 1), np.clip(sy - y0, 0, 1)
        x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
        mixed = image[y0, x0] * (1 - fx) * (1 - fy) + image[y0, x1] * fx * (1 - fy) + image[y1, x0] * (1 - fx) * fy + image[y1, x1] * fx * fy
        out = np.where(inside, mixed, 0)
    out = out[:, ::-1] if flip_x else out
    return out[::-1] if flip_y else out


def to_uint8(image: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.asarray(image) * 255), 0, 255).astype(np.uint8)


def prepared(images: DataFrame, auto_crop: bool = True) -> DataFrame:
    """Rows of ``path, height, width, pixels`` in gray, cropped to their foreground if asked for."""

    def run(batches):
        for b in batches:
            gray = [to_gray(np.asarray(p).reshape(h, w)) for p, h, w in zip(b["pixels"], b["height"], b["width"])]
            cut = [crop_foreground(g) for g in gray] if auto_crop else gray
            yield pd.DataFrame({"path": b["path"], "height": [i.shape[0] for i in cut], "width": [i.shape[1] for i in cut], "pixels": [i.ravel() for i in cut]})

    return images.mapInPandas(run, "path string, height int, width int, pixels array<double>")


def embed_views(images: DataFrame, views: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], auto_crop: bool = True, pad: bool = True) -> DataFrame:
    """``query_id, view_idx, branch, crop_id, emb`` for rows of ``query_id, height, width, pixels``.

    ``views`` (the few rows of a view grid) are applied to the whole image; rows of an optional
    column ``crops`` (array of x0, y0, x1, y1) to each local window as well.  The index of a view
    counts the global ones first, then those of each crop.
    """
    grid = [tuple(r) for r in views.orderBy("view_idx").select("angle", "flip_x", "flip_y").collect()]
    local = "crops" in images.columns

    def run(batches):
        for b in batches:
            rows, seen = [], []
            for r in b.to_dict("records"):
                whole = to_gray(np.asarray(r["pixels"]).reshape(r["height"], r["width"]))
                parts = [("global", -1, crop_foreground(whole) if auto_crop else whole)]
                if local and r["crops"] is not None:
                    parts += [("local", k, whole[c["y0"] : c["y1"], c["x0"] : c["x1"]]) for k, c in enumerate(r["crops"])]
                at = 0
                for branch, crop, image in parts:
                    for angle, fx, fy in grid:
                        view = turn(pad_square(image) if pad else image, angle, fx, fy)
                        rows.append((r["query_id"], at, branch, crop))
                        seen.append(view)
                        at += 1
                if len(seen) >= 4 * BATCH:
                    yield coded(rows, seen)
                    rows, seen = [], []
            yield coded(rows, seen)

    def coded(rows, seen):
        return pd.DataFrame(rows, columns=["query_id", "view_idx", "branch", "crop_id"]).assign(emb=pd.Series(encode_all(encoder, seen), dtype=object))

    need = ["query_id", "height", "width", "pixels", *(["crops"] if local else [])]
    return images.select(*need).mapInPandas(run, "query_id long, view_idx int, branch string, crop_id int, emb array<double>")


def integral(pixels: DataFrame, threshold: float = 0.05) -> DataFrame:
    """``image_id, x, y, total``: foreground pixels at or before (x, y), for rows of ``image_id, x, y, value``."""
    along = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    rows = pixels.withColumn("_row", F.sum((F.col("value") > threshold).cast("long")).over(along))
    return rows.select("image_id", "x", "y", F.sum("_row").over(down).alias("total"))


def box_ratio(totals: DataFrame, boxes: DataFrame) -> DataFrame:
    """``image_id, box_id, fg_ratio`` of boxes ``image_id, box_id, x0, y0, x1, y1`` by their four corners in an integral table."""
    signs = ((1, "x1", "y1"), (-1, "x0", "y1"), (-1, "x1", "y0"), (1, "x0", "y0"))
    corner = F.explode(F.array(*(F.struct(F.lit(s).alias("sign"), (F.col(x) - 1).alias("x"), (F.col(y) - 1).alias("y")) for s, x, y in signs))).alias("c")
    area = ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")
    met = boxes.select("image_id", "box_id", area, corner).select("image_id", "box_id", "area", "c.*").join(totals, ["image_id", "x", "y"], "left")
    return met.groupBy("image_id", "box_id").agg((F.sum(F.col("sign") * F.coalesce("total", F.lit(0))) / F.first("area")).alias("fg_ratio"))


def sample_rows(rows: DataFrame, n: int, key: str = "row_idx", seed: int = 42) -> DataFrame:
    """``n`` rows in a fixed pseudo-random order of the whole-number key: the same ones for any partitioning."""
    return rows.orderBy(draw(F.col(key), seed=seed), key).limit(n)


def patch_path(patch_id: Column, folder: str = "patches") -> Column:
    """Ids have eight digits or more; padding never cuts a longer one."""
    return F.when(patch_id.isNotNull(), F.concat(F.lit(f"{folder}/"), F.format_string("%08d", patch_id), F.lit(".png")))


def first_path(*columns: Column) -> Column:
    """First of several path columns that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))

"""Dataset builder and volume comparison."""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelrank.functions import geometry as G
from voxelrank.operators.volume import is_valid, opened, resample
from voxelrank.plans.generators import random_crops, random_planes
from voxelrank.sources.png import encode_png


def valid_planes(spark: SparkSession, n: int, volume: np.ndarray, size: int = 64, step: float = 0.5, attempts: int = 50, seed: int = 42) -> DataFrame:
    """``slot, nx, ny, nz, depth, rotation``: for each slot the first of ``attempts`` drawn planes whose slice is valid.

    Rejection without a loop: all attempts are candidates, the first valid one of a slot stays.
    Fails if a slot has none.
    """
    shared = spark.sparkContext.broadcast(volume)
    drawn = random_planes(spark, n * attempts, volume.shape[::-1], seed)

    def test(batches):
        for b in batches:
            ok = [is_valid(resample(opened(shared.value), {"nx": p["nx"], "ny": p["ny"], "nz": p["nz"], "depth": p["depth"], "rot": p["rotation"], "size_px": size, "step": step})) for p in b.to_dict("records")]
            yield b[np.array(ok, bool)]

    fine = drawn.mapInPandas(test, drawn.schema).withColumn("slot", F.call_function("div", F.col("plane_id"), F.lit(attempts)))
    first = fine.withColumn("_r", F.row_number().over(Window.partitionBy("slot").orderBy("plane_id"))).filter("_r = 1").drop("_r")
    slots = spark.range(n).select(F.col("id").alias("slot")).join(first, "slot", "left")
    sure = F.when(F.col("plane_id").isNull(), F.raise_error(F.concat(F.lit("no valid plane for slot "), F.col("slot").cast("string"))).cast("long")).otherwise(F.col("plane_id"))
    return slots.withColumn("plane_id", sure)


#: The kinds of crops and their aspects.
ASPECTS = {"square": (1.0, 1.0), "wide": (2.0, 1.0), "tall": (1.0, 2.0)}


#: The sizes of crops, and the mark of each volume in file names.
BINS, MARKS = ("large", "medium", "small"), {"allen": "a", "real": "r"}


def _pose(p: dict, size: int, step: float) -> dict:
    return {"nx": p["nx"], "ny": p["ny"], "nz": p["nz"], "depth": p["depth"], "rot": p["rotation"], "size_px": size, "step": step}


def _boxed(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with the pixel box of their crop in ``_x0, _y0, _x1, _y1``."""
    box = G.crop_norm(F.col("crop_cx"), F.col("crop_cy"), F.col("crop_rw"), F.col("crop_rh"), size, size)
    return rows.withColumn("_box", box).select(*rows.columns, *(F.col(f"_box.{c}").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))


def first_valid(crops: DataFrame, volume: np.ndarray, size: int, step: float) -> DataFrame:
    """The first attempt of each plane, bin and aspect that cuts a valid image; fails if none does.

    Attempts of one crop must follow each other, as :func:`random_crops` lays them out; a task resamples a plane once.
    """
    shared, columns = crops.sparkSession.sparkContext.broadcast(volume), crops.columns

    def run(batches):
        image, plane, crop, found = None, None, None, True
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, p in enumerate(b.to_dict("records")):
                this = p["slot"], p["crop_bin"], p["aspect_w"], p["aspect_h"]
                if this != crop:
                    if not found:
                        raise ValueError(f"no valid crop for plane, bin and aspect {crop}")
                    crop, found = this, False
                if found:
                    continue
                if p["slot"] != plane:
                    plane, image = p["slot"], resample(opened(shared.value), _pose(p, size, step))
                keep[i] = found = is_valid(image[p["_y0"] : p["_y1"], p["_x0"] : p["_x1"]])
            yield b.loc[keep, columns]
        if not found:
            raise ValueError(f"no valid crop for plane, bin and aspect {crop}")

    return _boxed(crops, size).mapInPandas(run, crops.schema)


def image_names(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` with ``allen_path, real_path``: plane and volume, and for crops bin and kind."""
    size = F.array_position(F.array(*map(F.lit, BINS)), F.col("crop_bin")) - 1
    suffix = F.when(F.col("is_crop") == 1, F.concat(F.lit("_crop"), size.cast("string"), F.lit("_"), F.col("crop_kind"))).otherwise(F.lit(""))
    return rows.withColumns({f"{source}_path": F.concat(F.lit(f"{folder}/"), F.format_string("%05d", F.col("slot")), F.lit(f"_{mark}"), suffix, F.lit(".png")) for source, mark in MARKS.items()})


def stretched(image: np.ndarray) -> np.ndarray:
    """An image in 256 equal steps of its own range; a constant one is black."""
    low, high = float(image.min()), float(image.max())
    return np.minimum(np.floor((image - low) / (high - low) * 256), 255) / 255 if high > low else np.zeros_like(image)


def dataset_images(rows: DataFrame, volumes: dict[str, np.ndarray], size: int = 64, step: float = 0.5) -> DataFrame:
    """``name, content``: a PNG of each row of :func:`image_names` from each volume, by the last part of its path.

    Rows of a plane meet in one task, which resamples the plane once for each volume; only poses are shuffled.
    """
    shared = rows.sparkSession.sparkContext.broadcast(volumes)
    paths = [f"{source}_path" for source in volumes]
    wanted = _boxed(rows, size).select("slot", "nx", "ny", "nz", "depth", "rotation", "is_crop", *paths, "_x0", "_y0", "_x1", "_y1")

    def run(batches):
        plane, images = None, {}
        for b in batches:
            for p in b.to_dict("records"):
                if p["slot"] != plane:
                    plane, images = p["slot"], {s: resample(opened(v), _pose(p, size, step)) for s, v in shared.value.items()}
                names, files = [], []
                for source, image in images.items():
                    cut = image[p["_y0"] : p["_y1"], p["_x0"] : p["_x1"]] if p["is_crop"] else image
                    names.append(p[f"{source}_path"].rsplit("/", 1)[1])
                    files.append(encode_png(stretched(cut)))
                yield pd.DataFrame({"name": names, "content": files})

    return wanted.repartition("slot").sortWithinPartitions("slot").mapInPandas(run, "name string, content binary")


def build_dataset(planes: DataFrame, seed: int = 42, aspects: dict[str, tuple[float, float]] = ASPECTS, volume: np.ndarray | None = None, size: int = 64, step: float = 0.5, attempts: int = 50) -> DataFrame:
    """n * (1 + 3 * aspects) rows: each plane whole, and its crops; ``row_idx`` follows plane, bin, aspect.

    With a ``volume`` each crop is the first of ``attempts`` drawn ones whose image is valid; without one, the first drawn.
    """
    if not aspects or any(w <= 0 or h <= 0 for w, h in aspects.values()):
        raise ValueError("aspects must be pairs of positive numbers")
    crops = random_crops(planes, "slot", seed=seed, aspects=tuple(aspects.values()), attempts=1 if volume is None else attempts)
    crops = crops if volume is None else first_valid(crops, volume, size, step)
    bins = F.array(*map(F.lit, BINS))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i + 1).alias("place"), F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h")) for i, (k, (w, h)) in enumerate(aspects.items())))
    own = F.filter(kinds, lambda k: (k["w"] == F.col("aspect_w")) & (k["h"] == F.col("aspect_h")))[0]
    numbers = ("crop_cx", "crop_cy", "crop_rw", "crop_rh", "crop_aspect_w", "crop_aspect_h")
    named = crops.withColumns({"crop_aspect_w": F.col("aspect_w"), "crop_aspect_h": F.col("aspect_h"), "_k": F.col("crop_bin") * len(aspects) + own["place"]})
    named = named.select(*planes.columns, F.lit(1).alias("is_crop"), F.element_at(bins, F.col("crop_bin") + 1).alias("crop_bin"), own["kind"].alias("crop_kind"), *numbers, F.col("_k").cast("long").alias("_k"))
    whole = planes.select("*", F.lit(0).alias("is_crop"), F.lit("full").alias("crop_bin"), F.lit("full").alias("crop_kind"), *(F.lit(v).alias(c) for c, v in zip(numbers, (0.5, 0.5, 1.0, 1.0, 1.0, 1.0))), F.lit(0).cast("long").alias("_k"))
    return whole.unionByName(named).withColumn("row_idx", F.col("slot") * (1 + 3 * len(aspects)) + F.col("_k")).drop("_k")


def orientations() -> list[tuple[tuple[int, int, int], tuple[bool, bool, bool]]]:
    """All 48 axis permutations with flips."""
    return [(p, f) for p in permutations(range(3)) for f in product((False, True), repeat=3)]


def best_orientation(spark: SparkSession, fixed: np.ndarray, moving: np.ndarray, stride: int = 4) -> DataFrame:
    """``perm, flips, corr`` of the 48 orientations of ``moving``; best first.

    Both volumes are cropped to their common shape at the leading corner, and every ``stride``-th
    voxel counts; a constant volume correlates with nothing (0).
    """
    shared = spark.sparkContext.broadcast((fixed, moving))
    rows = spark.createDataFrame([(i,) for i in range(48)], "k int").repartition(48)

    def run(batches):
        a0, b0 = shared.value
        for batch in batches:
            out = []
            for k in batch["k"]:
                perm, flips = orientations()[k]
                b = np.transpose(b0, perm)[tuple(slice(None, None, -1 if f else 1) for f in flips)]
                n = np.minimum(a0.shape, b.shape)
                cut = lambda v: v[tuple(slice(0, m, stride) for m in n)].ravel()
                x, y = cut(a0), cut(b)
                ok = x.std() > 1e-12 and y.std() > 1e-12
                out.append((list(perm), [bool(f) for f in flips], float(np.corrcoef(x, y)[0, 1]) if ok else 0.0))
            yield pd.DataFrame(out, columns=["perm", "flips", "corr"])

    return rows.mapInPandas(run, "perm array<int>, flips array<boolean>, corr double").orderBy(F.desc("corr"), F.col("perm"), F.col("flips"))

"""Readers and writers: manifests, vectors, datasets, hits, images, volumes."""

from __future__ import annotations

import gzip
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelrank.streaming.incremental import read_markers, visible

DATASET_COLUMNS = {
    "allen_path": "string", "real_path": "string", "vector": "string", "depth": "double", "rotation": "double", "is_crop": "int", "crop_bin": "string", "crop_kind": "string",
    "crop_cx": "double", "crop_cy": "double", "crop_rw": "double", "crop_rh": "double", "crop_aspect_w": "double", "crop_aspect_h": "double",
}
HIT_REQUIRED = ("row_idx", "source", "rank", "geom_dist_vox")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Patch manifest keyed by ``patch_id`` (or ``id``)."""
    df = spark.read.parquet(path)
    return df.withColumnRenamed("id", "patch_id") if "id" in df.columns else df


def parse_dataset(raw: DataFrame) -> DataFrame:
    """Typed dataset rows from all-string ones: trimmed, empty as null, a vector of three numbers, other columns in ``extra``.

    Missing columns and rows that do not parse are errors.
    """
    missing = [c for c in DATASET_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    clean = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in raw.columns}
    out = []
    for c, kind in DATASET_COLUMNS.items():
        if c == "vector":
            v = F.from_json(clean[c], "array<double>")
            out.append(F.when(F.size(v) == 3, v).otherwise(F.raise_error(F.lit("vector must hold three numbers")).cast("array<double>")).alias(c))
        elif kind == "string":
            out.append(clean[c].alias(c))
        else:
            number = clean[c].try_cast("double")
            need = F.when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit(f"{c} must be a number: "), F.coalesce(F.col(c), F.lit("null")))).cast("double"))
            out.append(need.cast(kind).alias(c))
    extra = [x for c in raw.columns if c not in DATASET_COLUMNS and c != "row_idx" for x in (F.lit(c), F.col(c))]
    made = F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")
    return raw.select(*([F.col("row_idx").cast("long")] if "row_idx" in raw.columns else []), *out, made.alias("extra"))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Parsed dataset rows; without a column ``row_idx`` rows are numbered by their place in the files."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return parse_dataset(raw if "row_idx" in raw.columns else with_position(raw))


def with_position(raw: DataFrame) -> DataFrame:
    """Adds ``row_idx``: the place of each row of a file scan, from 0, in the order of files and blocks.

    Blocks are counted first (one row for each), rows then count from their block's first; no row is shuffled.
    """
    block = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    placed = raw.select("*", *block, F.monotonically_increasing_id().alias("_at"))
    blocks = placed.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("_file", "_start", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(offsets, ["_file", "_start"]).withColumn("row_idx", F.col("_before") + F.col("_at") - F.col("_first")).select("row_idx", *raw.columns)


def write_dataset(rows: DataFrame, path: str) -> None:
    """Dataset CSV from typed rows; columns that are not there stay empty, ``row_idx`` is kept."""
    have = set(rows.columns)
    made = [(F.to_json(F.col(c)) if c == "vector" else F.col(c)).alias(c) if c in have else F.lit("").alias(c) for c in DATASET_COLUMNS]
    rows.select("row_idx", *made).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_hits(hits: DataFrame, path: str) -> None:
    """Hits added to those at ``path``; new columns are merged on reading."""
    hits.write.mode("append").parquet(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a run from Parquet, or CSV with a header (file or directory); where markers lie beside, those of committed runs."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.option("mergeSchema", True).parquet(path)
    missing = [c for c in HIT_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    markers = read_markers(spark, path) if "run" in df.columns else None
    return df if markers is None else visible(df, markers)


def write_index(patches: DataFrame, path: str) -> None:
    """Manifest and vectors in one table, split by scale so that scale filters prune."""
    patches.write.mode("overwrite").partitionBy("scale").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``patch_id, embedding`` from .npy files (row number is the id), read as binary files."""

    def run(batches):
        import io

        import pandas as pd

        for b in batches:
            for raw in b["content"]:
                x = np.load(io.BytesIO(raw))
                for lo in range(0, len(x), 10_000):
                    yield pd.DataFrame({"patch_id": np.arange(lo, min(lo + 10_000, len(x))), "embedding": list(x[lo : lo + 10_000].astype(float))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "patch_id long, embedding array<double>")


def read_gray_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, height, width, pixels`` in [0, 1] from portable graymaps (P5)."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for name, raw in zip(b["path"], b["content"]):
                kind, w, h, top, body = raw.split(None, 4) if raw.count(b"\n", 0, 40) else (b"", 0, 0, 0, b"")
                if kind != b"P5":
                    raise ValueError(f"{name} is no portable graymap")
                n = int(w) * int(h)
                rows.append((name, int(h), int(w), (np.frombuffer(raw[len(raw) - n :], np.uint8) / int(top)).tolist()))
            yield pd.DataFrame(rows, columns=schema.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def parse_nifti(raw: bytes) -> tuple[np.ndarray, tuple[float, float, float]]:
    """(array, spacing) of a NIfTI-1 file as stored: axes not turned, spacing in reversed order."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", raw[40:56])
    kinds = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 512: "u2"}  # fixed values of the format
    kind = struct.unpack(order + "h", raw[70:72])[0]
    pix = struct.unpack(order + "8f", raw[76:108])
    at, slope, inter = int(struct.unpack(order + "f", raw[108:112])[0]), *struct.unpack(order + "2f", raw[112:120])
    shape = dim[1 : 1 + dim[0]]
    data = np.frombuffer(raw, order + kinds[kind], int(np.prod(shape)), at).reshape(shape, order="F").astype(np.float32)
    return (data * slope + inter if slope else data), tuple(float(p) for p in pix[3:0:-1])

"""Registered queries of sources, sinks and the encoder side, and their SQL; all over ``embeddings``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelrank.catalog import _r, _t
from voxelrank.operators import encoders, grids
from voxelrank.session import scratch
from voxelrank.sources import files, png

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _rows(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", "embedding", "label")


# ---------------------------------------------------------------- encoder
def _weights(size: int, to: int) -> str:
    """SQL of (o, i, w): the bicubic weights of pixel i in pixel o."""
    centre, wide = f"(o + 0.5::DOUBLE) * {size} / {to}", f"greatest({size}::DOUBLE / {to}, 1)"
    return f"""SELECT o, i, k / sum(k) OVER (PARTITION BY o) AS w FROM (
  SELECT o, i, CASE WHEN t < 1 THEN (1.5::DOUBLE * t - 2.5::DOUBLE) * t * t + 1 WHEN t < 2 THEN ((-0.5::DOUBLE * t + 2.5::DOUBLE) * t - 4) * t + 2 ELSE 0 END AS k FROM (
    SELECT o, i, abs((i + 0.5::DOUBLE - {centre}) / {wide}) AS t FROM range({to}) a(o), range({size}) b(i) WHERE i >= greatest(trunc({centre} - 2 * {wide} + 0.5::DOUBLE), 0) AND i < least(trunc({centre} + 2 * {wide} + 0.5::DOUBLE), {size})))"""


@_query(f"""WITH px AS (SELECT vec_id, (i - 1) // 16 AS y, (i - 1) % 16 AS x, floor(least(greatest((CAST(embedding[i] AS DOUBLE) + 1) / 2, 0), 1) * 255) AS v FROM embeddings, range(1, 65) r(i)),
wx AS ({_weights(16, 12)}), wy AS ({_weights(4, 3)}),
a AS (SELECT vec_id, y, o AS x, least(greatest(floor(sum(v * w) + 0.5::DOUBLE), 0), 255) AS v FROM px JOIN wx ON i = x GROUP BY ALL),
b AS (SELECT vec_id, o AS y, x, least(greatest(floor(sum(v * w) + 0.5::DOUBLE), 0), 255) AS v FROM a JOIN wy ON i = y GROUP BY ALL),
c(channel, mean, dev) AS (VALUES (0, 0.485::DOUBLE, 0.229::DOUBLE), (1, 0.456::DOUBLE, 0.224::DOUBLE), (2, 0.406::DOUBLE, 0.225::DOUBLE))
SELECT vec_id, CAST(channel AS BIGINT) AS channel, y, x - 4 AS x, round((v / 255 - mean) / dev, 6) AS value FROM b, c WHERE x >= 4 AND x < 7""")
def encoder_preprocess(spark, sf):
    """Vectors as images of 4 x 16 pixels, resized to 3 x 12, their middle cut out and their channels normalised."""
    images = _rows(spark, sf).select("vec_id", F.lit(4).alias("height"), F.lit(16).alias("width"), F.transform("embedding", lambda c: (c.cast("double") + 1) / 2).alias("pixels"))
    return encoders.resized_images(images, 3, "vec_id").withColumn("value", _r("value"))


@_query("""WITH t AS (SELECT vec_id, (i - 1) // 4 AS token, (i - 1) % 4 AS d, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)),
p AS (SELECT vec_id, token // 4 // 2 * 2 + token % 4 // 2 AS cell, d, avg(v) AS v FROM t GROUP BY ALL)
SELECT vec_id, cell, d, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id, cell)), 6) + 0.0 AS value FROM p""")
def token_pooling(spark, sf):
    """Vectors as 16 tokens of a 4 x 4 grid, averaged over windows of 2 x 2."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform(F.slice("embedding", i * 4 + 1, 4), lambda c: c.cast("double")))
    found = encoders.pooled_tokens(_rows(spark, sf).select("vec_id", tokens.alias("tokens")), 4, "grid", 2, "vec_id")
    return found.select("vec_id", F.col("cell").cast("long").alias("cell"), F.posexplode("emb").alias("d", "value")).select("vec_id", "cell", F.col("d").cast("long").alias("d"), (_r("value") + F.lit(0.0)).alias("value"))


@_query("""WITH t AS (SELECT vec_id, (i - 1) % 16 AS at, floor(least(greatest((CAST(embedding[i] AS DOUBLE) + 1) / 2, 0), 1) * 255) / 255 AS v, i FROM embeddings, range(1, 65) r(i)),
n AS (SELECT vec_id, c, avg((v - mean) / dev) AS v FROM t, (VALUES (0, 0.485::DOUBLE, 0.229::DOUBLE), (1, 0.456::DOUBLE, 0.224::DOUBLE), (2, 0.406::DOUBLE, 0.225::DOUBLE)) s(c, mean, dev) GROUP BY ALL)
SELECT vec_id, CAST(c AS BIGINT) AS d, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS value FROM n""")
def image_embeddings(spark, sf):
    """Embeddings of vectors as images of 8 x 8 pixels, in batches, by a model that is loaded once: the mean of each channel, in each of four patches, averaged."""
    images = _rows(spark, sf).select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda c: (c.cast("double") + 1) / 2).alias("pixels"))
    found = encoders.embed_images(images, encoders.Encoder(_channel_means, 8, 4, "mean"), "vec_id")
    return found.select("vec_id", F.posexplode("emb").alias("d", "value")).select("vec_id", F.col("d").cast("long").alias("d"), _r("value").alias("value"))


def _channel_means():
    return lambda x: x.reshape(len(x), 3, 2, 4, 2, 4).mean((3, 5)).transpose(0, 2, 3, 1).reshape(len(x), 4, 3)


# ---------------------------------------------------------------- files
def _packed(spark, sf, many: int, name: str, make):
    """``name, content``: a file of each ``many`` ids, made of their vectors and labels in the order of ids."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        return pd.DataFrame({"name": [name.format(int(part["vec_id"].iloc[0]) // many)], "content": [make(part)]})

    return _rows(spark, sf).groupBy(F.call_function("div", F.col("vec_id"), F.lit(many))).applyInPandas(pack, "name string, content binary")


@_query("SELECT vec_id, CAST((i - 1) // 8 AS BIGINT) AS y, CAST((i - 1) % 8 AS BIGINT) AS x, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM embeddings, range(1, 65) r(i)")
def volume_slabs(spark, sf):
    """Vectors as planes of 8 x 8 voxels in volumes of up to 50 planes, written as files and read back in slabs, with turned axes."""
    path = scratch(spark)
    files.write_files(_packed(spark, sf, 50, "v/{:05d}.nii", lambda p: files.nifti_bytes(np.stack(p["embedding"]).astype("f4").reshape(-1, 8, 8).T)), path)
    found = files.voxels(files.read_volume(spark, path, "kji", part_bytes=8 * 8 * 4 * 20))
    return found.select((F.regexp_extract("path", r"(\d+)\.nii", 1).cast("long") * 50 + F.col("z")).alias("vec_id"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), _r(F.col("value").cast("double")).alias("value"))


@_query("SELECT CAST(label AS BIGINT) AS label, CAST(64 * count(*) AS BIGINT) AS n, CAST(64 * sum(vec_id % 50) AS BIGINT) AS planes FROM embeddings GROUP BY label")
def label_volume(spark, sf):
    """Labels as annotation volumes of whole numbers, compressed, as stored; voxels of each label and where they are."""
    path = scratch(spark)
    make = lambda p: files.gzip.compress(files.nifti_bytes(np.repeat(p["label"].to_numpy("i4"), 64).reshape(-1, 8, 8)))
    files.write_files(_packed(spark, sf, 50, "{:05d}.nii.gz", make), path)
    found = files.voxels(files.read_volume(spark, path, "ijk", labels=True))
    return found.groupBy(F.col("value").alias("label")).agg(F.count("*").alias("n"), F.sum("z").alias("planes"))


@_query("WITH n AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS patch_id FROM embeddings) SELECT patch_id, CAST(i AS BIGINT) AS d, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM n, range(1, 65) r(i)")
def vector_files(spark, sf):
    """Vectors in matrix files of up to 300 rows, read back in parts of 64; ids run on over the files."""
    path = scratch(spark)
    files.write_files(_packed(spark, sf, 300, "m/{:05d}.npy", lambda p: files.npy_bytes(np.stack(p["embedding"]).astype("f4"))), path)
    found = files.read_npy(spark, path, part_bytes=64 * 64 * 4)
    return found.select("patch_id", F.posexplode("embedding").alias("d", "value")).select("patch_id", (F.col("d") + 1).cast("long").alias("d"), _r("value").alias("value"))


@_query("SELECT vec_id, CAST(8 AS BIGINT) AS height, CAST(8 AS BIGINT) AS width, CAST(sum(round_even(least(greatest((CAST(embedding[i] AS DOUBLE) + 1) / 2, 0), 1) * 255, 0)) AS BIGINT) AS total FROM embeddings, range(1, 65) r(i) GROUP BY vec_id")
def image_export(spark, sf):
    """Vectors as image files of their own, listed and read back."""
    path = scratch(spark)
    images = _rows(spark, sf).select(F.format_string("l%d/%06d.png", "label", "vec_id").alias("name"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda c: (c.cast("double") + 1) / 2).alias("pixels"))
    files.write_files(png.encode_images(images), path)
    found = png.read_png_images(spark, f"{path}/*/*.png")
    total = F.aggregate(F.transform("pixels", lambda p: F.round(p * 255).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select(F.regexp_extract("path", r"(\d+)\.png", 1).cast("long").alias("vec_id"), F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), total.alias("total"))


def _block(spark, sf):
    """Vectors as planes of a volume of 8 x 8 voxels across, with single-precision values, and its depth."""
    cells = _rows(spark, sf).select(F.col("vec_id").alias("z"), F.posexplode("embedding").alias("i", "value"))
    depth = _rows(spark, sf).agg(F.max("vec_id") + 1).first()[0]
    return cells.select(F.col("z").cast("int").alias("z"), F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), "value"), depth


@_query("""WITH v AS (SELECT vec_id AS z, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i)),
n AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
gz AS (SELECT t, least(t * 2.5::DOUBLE, n - 1) AS pos, t * 2.5::DOUBLE <= n - 0.5::DOUBLE AS ok FROM n, LATERAL (SELECT unnest(range(CAST(round_even(n * 0.4::DOUBLE, 0) AS BIGINT))) AS t)),
gy AS (SELECT t, least(t * 0.75::DOUBLE, 7) AS pos, t * 0.75::DOUBLE <= 7.5 AS ok FROM range(11) r(t)),
a AS (SELECT t AS z, y, x, sum(CASE WHEN NOT ok THEN 0 WHEN z = floor(pos) THEN value * (1 - (pos - floor(pos))) ELSE value * (pos - floor(pos)) END) AS value FROM gz JOIN v ON z = floor(pos) OR (z = floor(pos) + 1 AND pos > floor(pos)) GROUP BY ALL),
b AS (SELECT z, t AS y, x, sum(CASE WHEN NOT ok THEN 0 WHEN y = floor(pos) THEN value * (1 - (pos - floor(pos))) ELSE value * (pos - floor(pos)) END) AS value FROM gy JOIN a ON y = floor(pos) OR (y = floor(pos) + 1 AND pos > floor(pos)) GROUP BY ALL)
SELECT CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(value, 5) + 0.0 AS value FROM b""")
def regridded_volume(spark, sf):
    """Vectors as planes of a volume, on a grid that is 2.5 times as coarse across the planes and finer along one axis of them."""
    cells, depth = _block(spark, sf)
    found = grids.regridded(cells, (depth, 8, 8), (10.0, 10.0, 10.0), (25.0, 7.5, 10.0))
    return found.select(*(F.col(c).cast("long").alias(c) for c in "zyx"), (_r("value", 5) + F.lit(0.0)).alias("value"))


@_query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY vec_id // 200 ORDER BY vec_id) - 1 AS place FROM embeddings)
SELECT CAST(vec_id // 200 AS BIGINT) AS volume, CAST((i - 1) % 8 AS BIGINT) AS z, place AS y, CAST(7 - (i - 1) // 8 AS BIGINT) AS x, round(CAST(embedding[i] AS DOUBLE), 6) AS value, 3.0::DOUBLE AS dz, 1.0::DOUBLE AS dy, 2.0::DOUBLE AS dx FROM n, range(1, 65) r(i)""")
def turned_volume_files(spark, sf):
    """Vectors as planes of volumes of up to 200 ids, turned, written as volume files with the spacing of their axes, and read back in slabs."""
    run, folder = F.call_function("div", F.col("vec_id"), F.lit(200)), scratch(spark)
    placed = _rows(spark, sf).withColumn("run", run).withColumn("at", F.row_number().over(Window.partitionBy("run").orderBy("vec_id")) - 1).withColumn("depth", F.count("*").over(Window.partitionBy("run")))
    about = (F.format_string("%08d.nii", "run").alias("name"), F.array(F.lit(8), F.col("depth").cast("int"), F.lit(8)).alias("shape"))
    cells = placed.select(*about, F.col("at").alias("z"), F.posexplode("embedding").alias("i", "value")).select("name", "shape", "z", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), "value")
    turned = grids.oriented(cells, (0, 8, 8), (2, 0, 1), (False, False, True))
    files.write_volumes(grids.planes(turned, ("name", "shape")), folder, (3.0, 1.0, 2.0))
    found = files.voxels(files.read_volume(spark, folder, "kji", part_bytes=8 * 200 * 4 * 3), ("spacing",))
    sides = (F.round(F.col("spacing")[i], 6).alias(c) for i, c in enumerate(("dz", "dy", "dx")))
    return found.select(F.regexp_extract("path", r"(\d+)\.nii", 1).cast("long").alias("volume"), *(F.col(c).cast("long").alias(c) for c in "zyx"), _r(F.col("value").cast("double")).alias("value"), *sides)

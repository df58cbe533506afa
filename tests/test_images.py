import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelrank.operators import builder, images, volume
from voxelrank.plans.generators import view_grid


def test_image_steps():
    img = np.zeros((6, 8))
    img[2:4, 3:6] = 1
    assert images.crop_foreground(img, least=0.01).shape == (2, 3) and images.crop_foreground(img, least=0.9).shape == img.shape
    assert images.pad_square(img).shape == (8, 8) and images.pad_square(img)[1:7].sum() == img.sum()
    assert np.array_equal(images.turn(img, 90), np.rot90(img)) and np.array_equal(images.turn(img, 0, True, True), img[::-1, ::-1])
    ball = volume.synthetic_volume()[16].astype(float)
    assert abs(images.turn(ball, 30).mean() - ball.mean()) < 0.05
    assert images.to_gray(np.full((2, 2, 3), 255)).tolist() == [[1, 1], [1, 1]] and images.to_uint8(np.array([0.5])).tolist() == [128]


def test_views_of_images(spark):
    df = spark.createDataFrame([(1, 4, 4, [float(i) / 16 for i in range(16)], [(0, 0, 2, 2)])], "query_id long, height int, width int, pixels array<double>, crops array<struct<x0:int,y0:int,x1:int,y1:int>>")
    got = images.embed_views(df, view_grid(spark), volume.pooled_encoder(8)).orderBy("view_idx").collect()
    assert [(r.view_idx, r.branch) for r in got] == [(i, "global" if i < 8 else "local") for i in range(16)]
    assert all(abs(sum(x * x for x in r.emb) - 1) < 1e-9 for r in got)
    paths = spark.range(1).select(images.patch_path(F.lit(12)).alias("p"), images.patch_path(F.lit(2148007937)).alias("long"), images.first_path(F.lit(None).cast("string"), F.lit(" "), F.lit("x")).alias("q")).first()
    assert paths.p == "patches/00000012.png" and paths.long == "patches/2148007937.png" and paths.q == "x"


def test_dataset_builder(spark):
    v = volume.normalise(volume.synthetic_volume())
    planes = builder.valid_planes(spark, 4, v, attempts=20)
    rows = builder.build_dataset(planes).collect()
    assert sorted(r.row_idx for r in rows) == list(range(40)) and all(0 < r.crop_rw <= 1 and 0 < r.crop_rh <= 1 for r in rows)
    with pytest.raises(Exception):
        builder.valid_planes(spark, 2, np.zeros((8, 8, 8), np.float32), attempts=2).collect()


def test_orientation(spark):
    a = np.random.default_rng(0).random((6, 7, 8))
    moved = np.transpose(a, (2, 0, 1))[::-1]
    best = builder.best_orientation(spark, a, moved, 1).first()
    assert best.corr > 0.999

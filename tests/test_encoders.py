import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelrank.operators import encoders, images, volume
from voxelrank.plans import generators as P


def kernel(t):
    t = abs(t)
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0


def resized(line, to):
    """One line of pixels, pixel by pixel."""
    size, out = len(line), []
    scale = size / to
    wide = max(scale, 1.0)
    for o in range(to):
        c = (o + 0.5) * scale
        at = range(max(int(c - 2 * wide + 0.5), 0), min(int(c + 2 * wide + 0.5), size))
        w = [kernel((i + 0.5 - c) / wide) for i in at]
        out.append(min(max(int(np.floor(sum(a * line[i] for a, i in zip(w, at)) / sum(w) + 0.5)), 0), 255))
    return out


@pytest.mark.parametrize("shape,to", [((9, 13), (5, 7)), ((5, 7), (11, 14)), ((8, 8), (8, 3)), ((1, 6), (4, 4))])
def test_resize(shape, to):
    x = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    across = np.array([resized(line, to[1]) for line in x.astype(float)])
    down = np.array([resized(line, to[0]) for line in across.T.astype(float)]).T
    assert np.array_equal(encoders.resize(x[None], *to)[0], down)


def test_sums_on_a_half_are_added_in_order():
    x = np.random.default_rng(3).integers(0, 256, (20_000, 4, 16)).astype(np.uint8)
    x[:, 3] = np.clip(x[:, 1].astype(int) + x[:, 2] - x[:, 0], 0, 255)  # the middle row of three: sums on a half, if odd
    across = np.stack([functools.reduce(np.add, (x[..., i] * w for i, w in enumerate(line))) for line in encoders.bicubic(16, 12)], 2)
    across = np.clip(np.floor(across + 0.5), 0, 255)
    down = np.stack([functools.reduce(np.add, (across[:, i] * w for i, w in enumerate(line))) for line in encoders.bicubic(4, 3)], 1)
    want = np.clip(np.floor(down + 0.5), 0, 255)
    assert np.array_equal(encoders.resize(x, 3, 12), want) and np.array_equal(encoders.resize(x[7:8], 3, 12), want[7:8])


def test_preprocess_cuts_the_middle_and_normalises():
    wide, tall, colour = np.full((4, 10), 0.5), np.full((10, 4), 128, np.uint8), np.zeros((6, 6, 3))
    colour[..., 1] = 1.0
    got = encoders.preprocess([wide, tall, colour, wide], 4)
    assert got.shape == (4, 3, 4, 4)
    for c in range(3):
        assert np.allclose(got[0, c], (127 / 255 - encoders.MEAN[c]) / encoders.DEVIATION[c]) and np.allclose(got[1, c], (128 / 255 - encoders.MEAN[c]) / encoders.DEVIATION[c])
        assert np.allclose(got[2, c], ((c == 1) - encoders.MEAN[c]) / encoders.DEVIATION[c])
    step = np.tile(np.arange(8) / 10, (4, 1))  # the middle of a row that rises
    assert np.allclose(encoders.preprocess([step], 4)[0, 0] * encoders.DEVIATION[0] + encoders.MEAN[0], np.floor(step[:, 2:6] * 255) / 255)
    for bad in (np.zeros(4), np.zeros((2, 2, 4)), np.zeros((0, 3))):
        with pytest.raises(ValueError):
            encoders.preprocess([bad], 4)


def test_pooling():
    t = np.random.default_rng(1).standard_normal((2, 10, 3))
    unit = lambda v: v / np.linalg.norm(v)
    assert np.allclose(encoders.pool(t, 3)[0], unit(t[0, 0])) and np.allclose(encoders.pool(t[:, 1:], 3)[1], unit(t[1, 1:].mean(0)))
    assert np.allclose(encoders.pool(t, 3, "mean")[0], unit(t[0, 1:].mean(0)))
    grid = encoders.pool(t, 3, "grid", 2)  # the last row and column of three are left over
    assert grid.shape == (2, 1, 3) and np.allclose(grid[0, 0], unit(t[0, [1, 2, 4, 5]].mean(0)))
    assert np.allclose(encoders.pool(t, 3, "grid", 1)[1, 4], unit(t[1, 5]))
    for bad in (dict(how="most"), dict(how="grid", window=0)):
        with pytest.raises(ValueError):
            encoders.pool(t, 3, **bad)
    with pytest.raises(ValueError):
        encoders.pool(t, 4)


def counted(folder):
    """A loader that leaves a mark each time it is called, and a model that notes the sizes of its batches; sent by value."""

    def load():
        import os

        open(f"{folder}/load-{os.getpid()}-{os.urandom(4).hex()}", "w").close()
        model = encoders.Projection(4, 6)

        def run(x):
            with open(f"{folder}/batch-{os.getpid()}", "a") as f:
                f.write(f"{len(x)}\n")
            return model(x)

        return run

    return load


def test_a_task_loads_once_and_encodes_batches(spark, tmp_path):
    x = np.random.default_rng(2).random((300, 9, 9))
    df = spark.createDataFrame([(f"{i}", 9, 9, v.ravel().tolist()) for i, v in enumerate(x)] + [("none", 0, 0, [])], "name string, height int, width int, pixels array<double>").repartition(3)
    encoder = encoders.Encoder(counted(str(tmp_path)), 8, 4, "mean")
    got = {r.name: r.emb for r in encoders.embed_images(df, encoder).collect()}
    loads, sizes = list(tmp_path.glob("load-*")), [int(n) for f in tmp_path.glob("batch-*") for n in f.read_text().split()]
    workers = {f.name.split("-")[1] for f in loads}
    assert len(loads) == len(workers) <= 4 and sum(sizes) == 300 and max(sizes) <= encoders.BATCH and len(sizes) < 20
    here = encoders.Encoder(lambda: encoders.Projection(4, 6), 8, 4, "mean")
    want = here.batch(list(x))
    assert len(got) == 300 and all(np.allclose(got[str(i)], want[i]) for i in range(300))
    cells = encoders.embed_images(df, encoders.Encoder(counted(str(tmp_path)), 16, 4, "grid")).groupBy("name").agg(F.count("*").alias("n"), F.max("cell").alias("m")).collect()
    assert len(cells) == 300 and all((r.n, r.m) == (4, 3) for r in cells)


def test_index_and_views_are_encoded_in_batches(spark, tmp_path):
    ball = volume.normalise(volume.synthetic_volume((16, 16, 16)))
    plan, grid = P.slice_plan(P.fibonacci_normals(spark, 3), ball.shape, 5.0, 2.0).coalesce(1), P.patch_grid(spark, 16, (1, 2), 0.25)
    encoder = encoders.Encoder(counted(str(tmp_path)), 8, 4)
    rows = volume.build_index(plan, grid, ball, encoder, size=16, step=1.0).collect()
    sizes = [int(n) for f in tmp_path.glob("batch-*") for n in f.read_text().split()]
    assert sum(sizes) == len(rows) > 30 and len(sizes) <= -(-len(rows) // 16) and len(list(tmp_path.glob("load-*"))) == 1
    by = {(r.normal_idx, r.depth_idx, r.scale, r.patch_row, r.patch_col): r for r in rows}
    assert len(by) == len(rows)
    r = rows[len(rows) // 2]
    image = volume.resample(ball, {"nx": r.normal_x, "ny": r.normal_y, "nz": r.normal_z, "depth": r.depth_vox, "rot": r.rotation_deg, "size_px": 16, "step": 1.0})[r.y0 : r.y1, r.x0 : r.x1]
    assert np.allclose(r.embedding, encoders.Encoder(lambda: encoders.Projection(4, 6), 8, 4)(image))
    df = spark.createDataFrame([(7, 9, 12, np.random.default_rng(3).random(108).tolist())], "query_id long, height int, width int, pixels array<double>")
    views = images.embed_views(df, P.view_grid(spark, (0.0, 90.0), True, False), encoder).collect()
    assert len(views) == 4 and all(abs(np.linalg.norm(v.emb) - 1) < 1e-9 for v in views)

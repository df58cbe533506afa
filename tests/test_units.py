import io
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelrank.functions import geometry, numbers
from voxelrank.operators import distance, metrics, pools, rerank, targets, topk, volume
from voxelrank.plans import generators as P
from voxelrank.sources import tables
from voxelrank.streaming import incremental

pose = st.builds(
    lambda n, d, r, s, x, y, w, h: {"nx": n[0], "ny": n[1], "nz": n[2], "depth": d, "rot": r, "step": s, "size_px": 32, "x0": x, "y0": y, "w": w, "h": h},
    st.tuples(*[st.floats(-1, 1)] * 3).filter(lambda v: sum(x * x for x in v) > 0.1), st.floats(-10, 10), st.floats(0, 360), st.floats(0.2, 2), st.integers(0, 8), st.integers(0, 8), st.integers(1, 24), st.integers(1, 24),
)


@settings(max_examples=60, deadline=None)
@given(pose, pose, st.integers(2, 9))
def test_chamfer_is_brute_force(a, b, grid):
    p, q = distance.lattice(a, grid), distance.lattice(b, grid)
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1))
    want = distance._trimmed(d.min(1), 0.1) + distance._trimmed(d.min(0), 0.1)
    assert abs(distance.chamfer(a, b, grid, 0.1) - want) < 1e-7
    assert distance.chamfer(a, a, grid, 0.1) < 1e-9


def test_grid_join_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8))
    patches = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "patch_id long, emb array<double>")
    views = patches.filter("patch_id % 10 = 0").select(F.col("patch_id").alias("query_id"), F.lit(0).alias("view_idx"), "emb")
    near = lambda: {(r.query_id, r.patch_id, r.view_rank) for r in topk.vector_topk(views, patches, 5).collect()}
    one = near()
    monkeypatch.setattr(topk, "BROADCAST_DOUBLES", 0)
    monkeypatch.setattr(topk, "BLOCK", 64)
    assert near() == one and len(one) == 150


def test_metrics_with_missing_distances(spark):
    rows = [(1, "a", 1, None), (1, "a", 2, float("nan")), (1, "a", 3, 2.0), (2, "a", 1, None), (2, "a", 2, float("inf"))]
    hits = spark.createDataFrame(rows, "row_idx long, source string, rank int, dist double")
    g = {r.row_idx: r for r in metrics.geom_at_k(hits).collect()}
    assert g[1].geom_at_1 is None and g[1].geom_at_5 == 2.0 and g[2].geom_at_100 is None
    n = {r.row_idx: r for r in metrics.ndcg(hits).collect()}
    assert 0 < n[1].ndcg_10 < 1 and n[2].ndcg_10 is None
    t = targets.soft_targets(hits, ["row_idx", "source"]).collect()
    assert abs(sum(r.prob for r in t if r.row_idx == 1) - 1) < 1e-12 and {r.prob for r in t if r.row_idx == 2} == {0.5}
    assert metrics.thresholds_of(hits).first().asDict() == {"t25": 50.0, "t50": 100.0, "t75": 200.0}
    assert list(metrics.named_runs(["/x/a.csv", "/y/a.csv", "/z/b/"])) == ["a", "a_2", "b"]


def test_training_lowers_the_loss_and_gradients_are_right():
    cfg = rerank.RerankerConfig(dim=4, hidden=(8, 6), lr=1e-2, epochs=12)
    rng = np.random.default_rng(1)
    ex = []
    for _ in range(12):
        q, c = rng.standard_normal(4), rng.standard_normal((6, 4))
        s = c @ q
        p = np.exp(s - s.max())
        ex.append((q, c, p / p.sum(), -s))
    w, history = rerank.train(ex, cfg)
    assert history[-1]["train_loss"] < history[0]["train_loss"]
    assert all((rerank.load_weights(rerank.save_weights(w))[k] == v).all() for k, v in w.items())
    x, dr, dd = rng.standard_normal((5, 19)), rng.standard_normal(5), rng.standard_normal(5)
    f = lambda w: (lambda r: r[0] @ dr + r[1] @ dd)(rerank.forward(w, x))
    g = rerank.backward(w, rerank.forward(w, x)[2], dr, dd)
    for k in w:
        up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
        up[k].flat[0] += 1e-5
        down[k].flat[0] -= 1e-5
        assert abs((f(up) - f(down)) / 2e-5 - g[k].flat[0]) < 1e-4
    with pytest.raises(ValueError):
        rerank.RerankerConfig(dim=0)


def test_sources(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "v.npy", x)
    assert tables.read_npy_vectors(spark, str(tmp_path / "v.npy")).orderBy("patch_id").first().embedding == [0.0, 1.0, 2.0]
    (tmp_path / "i.pgm").write_bytes(b"P5\n2 1\n255\n\x00\xff")
    assert tables.read_gray_images(spark, str(tmp_path / "i.pgm")).first().pixels == [0.0, 1.0]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 16)
    struct.pack_into("<8f", head, 76, 1, 0.5, 1.5, 2.5, 0, 0, 0, 0)
    struct.pack_into("<f", head, 108, 352)
    data, spacing = tables.parse_nifti(bytes(head) + np.arange(24, dtype="<f4").tobytes())
    assert data.shape == (2, 3, 4) and data[1, 0, 0] == 1 and spacing == (2.5, 1.5, 0.5)
    good = dict.fromkeys(tables.DATASET_COLUMNS, "1") | {"vector": "[0, 0, 1]"}
    frame = lambda d: spark.createDataFrame([tuple(d.values())], list(d))
    row = tables.parse_dataset(frame(good | {"note": "x"})).first()
    assert row.vector == [0, 0, 1] and row.extra == {"note": "x"}
    for bad in ({"vector": "[0, 1]"}, {"depth": ""}):
        with pytest.raises(Exception):
            tables.parse_dataset(frame(good | bad)).collect()
    with pytest.raises(ValueError):
        tables.parse_dataset(frame({"vector": "[]"}))
    hits = spark.createDataFrame([(1, "a", 1, 0.5)], "row_idx long, source string, rank int, geom_dist_vox double")
    tables.write_csv(hits, str(tmp_path / "h.csv"))
    assert tables.read_hits(spark, str(tmp_path / "h.csv")).count() == 1


def test_resume_and_stream(spark, tmp_path):
    rows = [("s", 1, "a", k, k) for k in range(3)] + [("s", 2, "a", 0, 9)]
    hits = spark.createDataFrame(rows, "eval_sig string, row_idx long, source string, rank long, patch_id long")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "row_idx long")
    assert sorted(r[0] for r in incremental.pending(ids, hits, "s", 3, ["a"]).collect()) == [2, 3]
    assert incremental.purge_partial(hits, "s", 3).count() == 3
    assert incremental.signature({"a": 1, "b": 2}) == incremental.signature({"b": 2, "a": 1})
    hits.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in"))
        incremental.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_plans(spark):
    assert P.fibonacci_normals(spark, 0).count() == 0 and P.axis_normals(spark, True).count() == 23
    with pytest.raises(ValueError):
        P.depths(F.lit(0.0), F.lit(1.0), 0.0)
    images = spark.createDataFrame([(1, 100, 100), (2, 300, 100), (3, 50, 400)], "image_id long, width int, height int")
    assert {r.image_id for r in P.local_crops(images).collect()} == {2}
    assert P.local_crops(images, mode="force", min_side=32).filter("image_id = 1").count() == 8 or P.local_crops(images, mode="force", min_side=32).filter("image_id = 1").count() == 9
    v = volume.normalise(volume.synthetic_volume())
    img = volume.resample(v, {"nx": 0, "ny": 0, "nz": 1, "depth": 0.0, "rot": 0.0, "size_px": 32, "step": 1.0})
    assert volume.is_valid(img) and not volume.is_valid(np.zeros((4, 4)))
    boxes = np.array([[0, 0, 16, 16], [4, 4, 30, 20]])
    assert np.allclose(volume.fg_ratio_boxes(img, boxes), [(img[y0:y1, x0:x1] > 0.05).mean() for x0, y0, x1, y1 in boxes])
    assert io is not None


def test_physical_and_mirrored_chamfer():
    base = {"nx": 0.2, "ny": 0.5, "nz": 0.8, "depth": 1.0, "rot": 30.0, "step": 0.7, "size_px": 32, "x0": 2, "y0": 3, "w": 20, "h": 12}
    other = {**base, "nx": -0.4, "depth": -2.0}
    plain = distance.chamfer(base, other, 8)
    assert abs(distance.chamfer(base, other, 8, spacing=(1, 1, 1)) - plain) < 1e-9
    assert abs(distance.chamfer(base, other, 8, spacing=(25, 25, 25)) - 25 * plain) < 1e-6
    upright = {**base, "nx": 0.0, "ny": 0.0, "nz": 1.0, "rot": 0.0, "x0": 0, "y0": 0, "w": 32, "h": 32}
    assert distance.chamfer(upright, upright, 8, mirror=True) < 1e-6  # the full plane is its own mirror image


def test_crop_outside_becomes_a_pixel(spark):
    rows = spark.createDataFrame([(0.5, 0.5, 1.0, 1.0), (1.0, 1.0, 0.5, 0.5), (2.0, 2.0, 0.1, 0.1), (0.5, 0.5, 2.0, 2.0)], "cx double, cy double, rw double, rh double")
    got = [tuple(r[0]) for r in rows.select(geometry.crop_norm(F.col("cx"), F.col("cy"), F.col("rw"), F.col("rh"), 11, 21)).collect()]
    assert got[0] == (0, 0, 11, 21) and got[1] == (7, 15, 11, 21) and got[2] == (10, 20, 11, 21) and got[3] == (0, 0, 11, 21)


def test_targets_of_missing_distances(spark):
    row = spark.createDataFrame([(float("nan"), [])], "d double, v array<double>").select(numbers.distance_target(F.col("d"), "raw"), numbers.trimmed_mean(F.col("v"), 0.1)).first()
    assert tuple(row) == (256.0, 0.0)


def test_rows_are_numbered_by_place(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("a\n" + "".join(f"r{i}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = tables.with_position(spark.read.option("header", True).csv(str(path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.row_idx, r.a) for r in got) == [(i, f"r{i}") for i in range(3000)]


def test_split_ranks_rows_by_ranges(spark):
    n, ids = 6007, [7 * i - 900 for i in range(6007)]
    got = pools.split_rows(spark.createDataFrame([(i,) for i in ids] + [(ids[0],)], "row_idx long").repartition(5))
    mixed = lambda i: int(np.fmod(int(np.fmod(42 * 31 + i, 1 << 32)) * 2654435761, 1 << 32))
    order = sorted(ids, key=lambda i: (mixed(i), i))
    want = {i: "train" if at < round(n * 0.8) else "val" if at < round(n * 0.8) + round(n * 0.1) else "test" for at, i in enumerate(order)}
    rows = got.collect()
    assert len(rows) == n and {r.row_idx: r.split for r in rows} == want
    # No rank over all rows: its window would be one task.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_p#" in plan and "row_number() windowspecdefinition(_o#" not in plan

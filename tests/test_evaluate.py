import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelrank.operators import builder, distance, evaluate, rerank, volume
from voxelrank.plans import generators as P

CFG = evaluate.EvalConfig(size_px=32, step=1.0, flip_y=False, final_k=6, k_per_view=10, grid=6, local="force")


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    v = volume.normalise(volume.synthetic_volume())
    index = str(tmp_path_factory.mktemp("eval") / "index")
    volume.build_index(P.slice_plan(P.fibonacci_normals(spark, 8), (20, 20, 20), 6.0, 2.0), P.patch_grid(spark, 32, (1, 2), 0.25), v, size=32, step=1.0).write.parquet(index)
    rows = builder.build_dataset(builder.valid_planes(spark, 2, v, 32, 1.0))
    rows = rows.select("row_idx", F.array("nx", "ny", "nz").alias("vector"), "depth", "rotation", "is_crop", "crop_bin", "crop_kind", "crop_cx", "crop_cy", "crop_rw", "crop_rh").filter("row_idx % 10 < 3")
    data = str(tmp_path_factory.mktemp("eval") / "rows")
    rows.write.parquet(data)
    return {"moved": np.ascontiguousarray(v[::-1]), "plain": v}, spark.read.parquet(index), spark.read.parquet(data)


def test_hits_are_ranked_measured_and_resumable(spark, world, tmp_path):
    volumes, index, rows = world
    out = str(tmp_path / "hits")
    evaluate.evaluate(rows, volumes, index, volume.pooled_encoder(), CFG).write.parquet(out)
    hits = spark.read.parquet(out)
    got = hits.collect()
    groups = {}
    for r in got:
        groups.setdefault((r.row_idx, r.source), []).append(r)
    assert len(groups) == rows.count() * 2
    for rs in groups.values():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1)) and len({(r.normal_idx, r.depth_idx, r.rot_idx) for r in rs}) == len(rs)
        assert all(a.score >= b.score for a, b in zip(rs, rs[1:])) and abs(sum(r.gt_prob for r in rs) - 1) < 1e-9
    r = next(r for r in got if r.q_is_crop == 0)
    pose = lambda n, d, rot, x0, y0, x1, y1: {"nx": n[0], "ny": n[1], "nz": n[2], "depth": d, "rot": rot, "step": 1.0, "size_px": 32, "x0": x0, "y0": y0, "w": x1 - x0, "h": y1 - y0}
    a = pose((r.q_normal_x, r.q_normal_y, r.q_normal_z), r.q_depth_vox, r.q_rot_deg, 0, 0, 32, 32)
    b = pose((r.normal_x, r.normal_y, r.normal_z), r.depth_vox, r.rotation_deg, r.x0, r.y0, r.x1, r.y1)
    assert abs(r.geom_dist_vox - distance.chamfer(a, b, 6, 0.1)) < 1e-9
    ends = [distance.lattice(p, 2)[[0, 1, 2]] for p in (a, b)]
    d = np.sqrt(((ends[0][:, None] - ends[1][None]) ** 2).sum(-1))
    assert abs(r.corner_chamfer_3pt_um - 25 * (d.min(1).mean() + d.min(0).mean()) / 2) < 1e-6
    rest = evaluate.evaluate(rows, volumes, index, volume.pooled_encoder(), CFG, done=hits.filter("NOT (row_idx = 0 AND source = 'plain')"))
    assert {(x.row_idx) for x in rest.select("row_idx").distinct().collect()} == {0} | {k[0] for k, v in groups.items() if len(v) < CFG.final_k}


@pytest.mark.parametrize("mode", ["best_angle", "per_hit_angle", "max_over_angles"])
def test_rerank_modes(spark, world, mode):
    volumes, index, rows = world
    weights = rerank.init_weights(rerank.RerankerConfig(dim=64, hidden=(8, 4)))
    got = evaluate.evaluate(rows.filter("row_idx = 0"), volumes, index, volume.pooled_encoder(), CFG, weights=weights, rerank_topk=4, mode=mode).filter("source = 'plain'").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    first = [r.rerank_score for r in got[:4]]
    assert first == sorted(first, reverse=True) and all(r.rerank_score is None and r.order_by == "score" for r in got[4:])

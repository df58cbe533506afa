"""Volumes as tables against arrays: orientation, regridding, files of planes; images of datasets and indexes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelrank import cli
from voxelrank.operators import builder, grids, registration, volume
from voxelrank.sources import files, png


def table(spark, v):
    at = np.indices(v.shape).reshape(3, -1).T.tolist()
    return spark.createDataFrame([(*map(int, p), float(x)) for p, x in zip(at, v.ravel())], "z int, y int, x int, value double").repartition(3)


def array(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows.collect():
        assert np.isnan(out[r.z, r.y, r.x])
        out[r.z, r.y, r.x] = r.value
    return out


@pytest.mark.parametrize("stride", [1, 2, 4])
def test_scores_equal_those_of_arrays(spark, stride):
    rng = np.random.default_rng(stride)
    fixed, moving = rng.random((7, 9, 8)), rng.random((10, 6, 8))
    got = grids.orientation_scores(table(spark, fixed), table(spark, moving), fixed.shape, moving.shape, stride).collect()
    want = {(tuple(r.perm), tuple(r.flips)): r.corr for r in builder.best_orientation(spark, fixed, moving, stride).collect()}
    assert len(got) == len(want) == 48 and all(abs(r.corr - want[tuple(r.perm), tuple(r.flips)]) < 1e-9 for r in got)
    assert [r.corr for r in got] == sorted((r.corr for r in got), reverse=True)


def test_constant_and_empty_volumes(spark):
    v = np.arange(27.0).reshape(3, 3, 3)
    flat = grids.orientation_scores(table(spark, v), table(spark, np.ones((3, 3, 3))), (3, 3, 3), (3, 3, 3), 1).collect()
    assert len(flat) == 48 and all(r.corr == 0 and r.n == 27 for r in flat)
    none = table(spark, v).filter("z < 0")
    assert grids.orientation_scores(table(spark, v), none, (3, 3, 3), (3, 3, 3)).count() == 0
    assert grids.regridded(none, (3, 3, 3), (1, 1, 1), (2, 2, 2)).count() == 0 and grids.planes(none).count() == 0
    with pytest.raises(ValueError):
        grids.orientation_scores(none, none, (3, 3, 3), (3, 3, 3), 0)


@pytest.mark.parametrize("perm,flips", [((0, 1, 2), (False,) * 3), ((2, 0, 1), (True, False, True)), ((1, 0, 2), (False, True, False))])
def test_turning(spark, perm, flips):
    v = np.random.default_rng(1).random((3, 4, 5))
    want = registration.orient(v, perm, flips)
    assert (array(grids.oriented(table(spark, v), v.shape, perm, flips), want.shape) == want).all()


@pytest.mark.parametrize("wanted", [(25.0, 25.0, 5.0), (10.0, 10.0, 10.0), (3.0, 7.0, 30.0), (12.0, 9.0, 10.5)])
def test_regridding_equals_that_of_arrays(spark, wanted):
    v = np.random.default_rng(2).random((10, 7, 8))
    want = registration.regrid(v, (10.0, 10.0, 10.0), wanted)
    got = array(grids.regridded(table(spark, v), v.shape, (10.0, 10.0, 10.0), wanted), want.shape)
    assert not np.isnan(got).any() and np.abs(got - want).max() < 1e-12


@pytest.mark.parametrize("name,kind", [("v.nii", "f4"), ("v.nii.gz", "i2")])
def test_volume_files(spark, tmp_path, name, kind):
    v = np.random.default_rng(3).integers(-50, 50, (6, 4, 5)).astype(float)
    path = str(tmp_path / "deep" / name)
    files.write_volume(grids.planes(table(spark, v)), path, v.shape, (3.0, 2.0, 1.0), kind)
    back = files.VolumeFile(path, "kji")
    assert back.shape == v.shape and back.spacing == (3.0, 2.0, 1.0) and back.kind == kind and (back.array() == v).all()
    assert (array(files.voxels(files.read_volume(spark, path, "kji", part_bytes=50)), v.shape) == v).all()


def test_broken_volumes_leave_no_file(spark, tmp_path):
    v = np.zeros((4, 2, 2))
    for rows in (table(spark, v).filter("z != 2"), table(spark, v).filter("z < 3"), table(spark, v).filter("z < 0"), table(spark, v).filter("x = 0 OR z = 1")):
        with pytest.raises(Exception):
            files.write_volume(grids.planes(rows), str(tmp_path / "out" / "v.nii"), v.shape)
    assert not [p for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")]


def test_many_volumes_and_the_longest_side(spark, tmp_path):
    v = {f"{k}/v.nii": np.random.default_rng(k).random((k + 1, 3, 2)) for k in range(5)}
    rows = [(n, z, list(x.shape), x[z].ravel().tolist()) for n, x in v.items() for z in range(len(x))]
    schema = "name string, plane int, shape array<int>, values array<double>"
    files.write_volumes(spark.createDataFrame(rows, schema).repartition(4), str(tmp_path / "all"), kind="f8")
    assert all((files.VolumeFile(str(tmp_path / "all" / n), "kji").array() == x.astype("f4")).all() for n, x in v.items())
    for bad in (("a.nii", 0, [1, 1, 32768], [0.0] * 32768), ("../a.nii", 0, [1, 1, 1], [0.0])):
        with pytest.raises(Exception):
            files.write_volumes(spark.createDataFrame([bad], schema), str(tmp_path / "bad"))
    assert not list(tmp_path.rglob("a.nii"))
    files.write_volumes(spark.createDataFrame([], schema), str(tmp_path / "none"))


def test_register_resample_foreground(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    rng = np.random.default_rng(4)
    fixed = (rng.random((12, 10, 14)) * 100).astype("i2")
    moving = np.ascontiguousarray(np.transpose(fixed, (1, 2, 0))[:, ::-1])
    (tmp_path / "fixed.nii").write_bytes(files.nifti_bytes(fixed.T, (1.0, 2.0, 3.0)))
    (tmp_path / "moving.nii").write_bytes(files.nifti_bytes(moving.T, (3.0, 1.0, 2.0)))
    cli.main(["register", "--fixed", at("fixed.nii"), "--moving", at("moving.nii"), "--stride", "2", "--scores", at("scores"), "--out", at("turned.nii.gz")])
    turned = files.VolumeFile(at("turned.nii.gz"), "kji")
    assert (turned.array() == fixed).all() and turned.kind == "i2" and turned.spacing == (3.0, 2.0, 1.0)
    scores = spark.read.option("header", True).csv(at("scores")).collect()
    assert len(scores) == 48 and max(float(r["corr"]) for r in scores) > 0.999999
    cli.main(["resample", "--volume", at("fixed.nii"), "--spacing", "6", "2", "0.5", "--out", at("coarse.nii")])
    coarse = files.VolumeFile(at("coarse.nii"), "kji")
    assert coarse.spacing == (6.0, 2.0, 0.5) and (coarse.array() == np.rint(registration.regrid(fixed, (3.0, 2.0, 1.0), (6.0, 2.0, 0.5)))).all()
    labels = np.zeros((20, 20, 20), "i2")
    labels[4:16, 4:16, 4:16] = 7
    (tmp_path / "labels.nii").write_bytes(files.nifti_bytes(labels.T))
    cli.main(["foreground", "--labels", at("labels.nii"), "--slices", "20", "--size", "20", "--out", at("shares")])
    whole, slices = (spark.read.option("header", True).csv(at(f"shares/{n}")).first() for n in ("voxels", "slices"))
    assert float(whole.fg_ratio) == pytest.approx(0.216) and int(slices.n) == 20 and 0 < float(slices.fg_mean) < 1


def test_first_valid_crops(spark):
    v = volume.normalise(volume.synthetic_volume())
    planes = builder.valid_planes(spark, 6, v, 32, 1.0, 20)
    rows = builder.build_dataset(planes, volume=v, size=32, step=1.0).collect()
    assert sorted(r.row_idx for r in rows) == list(range(60))
    drawn = {}
    for r in builder._boxed(builder.random_crops(planes, "slot", attempts=50), 32).collect():
        image = volume.resample(v, builder._pose(r.asDict(), 32, 1.0))[r._y0 : r._y1, r._x0 : r._x1]
        if volume.is_valid(image):
            key = r.slot, builder.BINS[r.crop_bin], r.aspect_w, r.aspect_h
            drawn[key] = min(drawn.get(key, (99,)), (r.attempt, r.crop_cx, r.crop_rw))
    assert len(drawn) == 54
    for r in rows:
        if r.is_crop:
            assert (r.crop_cx, r.crop_rw) == drawn[r.slot, r.crop_bin, r.crop_aspect_w, r.crop_aspect_h][1:]
    with pytest.raises(Exception, match="no valid crop"):
        builder.build_dataset(planes, volume=np.zeros((32, 32, 32), np.float32), size=32, step=1.0, attempts=2).collect()


def test_images_of_index_and_dataset(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    data = volume.normalise(volume.synthetic_volume())
    cli.main(["index", "--normals", "4", "--depth-step", "8", "--size", "32", "--scales", "1", "2", "--rotations", "0", "90", "--images", at("shown"), "--out", at("index")])
    patches = spark.read.parquet(at("index")).collect()
    assert {r.rotation_deg for r in patches} == {0.0, 90.0} and len({r.image_name for r in patches}) == len(patches)
    assert sorted(p.name for p in (tmp_path / "shown" / "patches").iterdir() if p.suffix == ".png") == sorted(r.image_name for r in patches)
    for r in patches[::7]:
        pose = {"nx": r.normal_x, "ny": r.normal_y, "nz": r.normal_z, "depth": r.depth_vox, "rot": r.rotation_deg, "size_px": 32, "step": 1.0}
        shown = png.decode_png((tmp_path / "shown" / r.image_relpath).read_bytes())
        assert np.abs(shown - volume.resample(data, pose)[r.y0 : r.y1, r.x0 : r.x1]).max() <= 0.5 / 255 + 1e-9
    cli.main(["dataset", "--planes", "2", "--size", "32", "--images", at("rows"), "--out", at("data")])
    rows = spark.read.option("header", True).option("escape", '"').csv(at("data")).select("allen_path", "real_path", F.from_json("vector", "array<double>").alias("n"), "depth", "rotation", "is_crop", *(F.col(f"crop_{c}").cast("double") for c in ("cx", "cy", "rw", "rh"))).collect()
    assert len(rows) == 20 and len({p for r in rows for p in (r.allen_path, r.real_path)}) == 40
    assert {f"{at('rows')}/{n}" for n in ("00000_a.png", "00001_r_crop2_tall.png")} <= {p for r in rows for p in (r.allen_path, r.real_path)}
    for r in rows:
        pose = {"nx": r.n[0], "ny": r.n[1], "nz": r.n[2], "depth": float(r.depth), "rot": float(r.rotation), "size_px": 32, "step": 1.0}
        image = volume.resample(data, pose)
        if r.is_crop == "1":
            w, h = max(1, round(r.crop_rw * 32)), max(1, round(r.crop_rh * 32))
            x, y = round(r.crop_cx * 31) - w // 2, round(r.crop_cy * 31) - h // 2
            image = image[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)]
        for path in (r.allen_path, r.real_path):
            shown = png.decode_png(open(path, "rb").read())
            assert shown.shape == image.shape and np.abs(shown - builder.stretched(image)).max() <= 1 / 255 + 1e-9

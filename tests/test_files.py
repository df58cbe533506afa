import gzip

import numpy as np
import pytest

from voxelrank.operators import quantiles, volume
from voxelrank.plans import generators as P
from voxelrank.sources import files


def put(path, raw):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(raw)


@pytest.mark.parametrize("kind", ["f4", "f8", "i2"])
def test_matrices_in_parts_with_ids_that_run_on(spark, tmp_path, kind):
    x = (np.arange(33 * 5).reshape(33, 5) % 100).astype(kind)
    put(tmp_path / "b.npy", files.npy_bytes(x[20:]))
    put(tmp_path / "a.npy", files.npy_bytes(x[:20]))
    put(tmp_path / "c" / "empty.npy", files.npy_bytes(x[:0]))
    put(tmp_path / "_hidden.npy", b"no matrix")
    df = files.read_npy(spark, str(tmp_path), part_bytes=5 * x.itemsize * 3)
    assert df.rdd.getNumPartitions() == 7 + 5
    rows = df.orderBy("patch_id").collect()
    assert [r.patch_id for r in rows] == list(range(33)) and np.array_equal([r.embedding for r in rows], x)
    assert files.read_npy(spark, f"file://{tmp_path}/b.npy").count() == 13


def test_files_that_are_no_matrices(spark, tmp_path):
    put(tmp_path / "x.npy", b"something else")
    with pytest.raises(Exception, match="no .npy file"):
        files.read_npy(spark, str(tmp_path)).count()
    put(tmp_path / "x.npy", files.npy_bytes(np.zeros(4)))
    with pytest.raises(Exception, match="no matrix"):
        files.read_npy(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="none"):
        files.read_npy(spark, str(tmp_path / "none")).count()


@pytest.mark.parametrize("axes", ["ijk", "kji"])
@pytest.mark.parametrize("ending", [".nii", ".nii.gz"])
def test_volumes_in_slabs(spark, tmp_path, axes, ending):
    data = np.random.default_rng(0).standard_normal((5, 6, 7)).astype("f4")
    raw = files.nifti_bytes(data, (0.1, 0.2, 0.3))
    put(tmp_path / f"v{ending}", gzip.compress(raw) if ending.endswith("gz") else raw)
    df = files.read_volume(spark, str(tmp_path), axes, part_bytes=5 * 6 * 4 * 2)
    assert df.rdd.getNumPartitions() == (1 if ending.endswith("gz") else 4)
    got = np.full((5, 6, 7) if axes == "ijk" else (7, 6, 5), np.nan)
    for r in files.voxels(df).collect():
        got[r.z, r.y, r.x] = r.value
    assert np.array_equal(got, data if axes == "ijk" else data.T)
    one = df.first()
    assert np.allclose(one.spacing, (0.3, 0.2, 0.1)) and one.shape == list(got.shape)
    held = files.VolumeFile(str(tmp_path / f"v{ending}"), axes)
    assert held.shape == got.shape and np.array_equal(held.array(), got)


def test_scaled_volumes_and_labels(spark, tmp_path):
    raw = bytearray(files.nifti_bytes(np.arange(24, dtype="i2").reshape(2, 3, 4)))
    raw[112:120] = np.array([2.0, 5.0], "<f4").tobytes()
    put(tmp_path / "v.nii", bytes(raw))
    assert sorted(r.value for r in files.voxels(files.read_volume(spark, str(tmp_path))).collect()) == [2.0 * k + 5 for k in range(24)]
    labels = files.read_volume(spark, str(tmp_path), labels=True)
    assert labels.schema["values"].dataType.elementType.simpleString() == "bigint" and sorted(r.value for r in files.voxels(labels).collect()) == list(range(24))
    put(tmp_path / "w.nii", files.nifti_bytes(np.full((2, 2, 2), 0.5, "f4")))
    with pytest.raises(Exception, match="no whole numbers"):
        files.read_volume(spark, str(tmp_path / "w.nii"), labels=True).count()
    with pytest.raises(Exception, match="axes must be"):
        files.read_volume(spark, str(tmp_path), "xyz").count()
    put(tmp_path / "w.nii", b"\0" * 400)
    with pytest.raises(Exception, match="no NIfTI-1 file"):
        files.read_volume(spark, str(tmp_path / "w.nii")).count()


def test_an_index_of_a_volume_file_is_that_of_its_array(spark, tmp_path):
    data = (volume.synthetic_volume((20, 22, 24)) * 100).astype("f4")
    put(tmp_path / "v.nii", files.nifti_bytes(data))
    held = volume.normalised_file(spark, str(tmp_path / "v.nii"))
    lo, hi = np.percentile(data, [0.5, 99.5])
    assert held.low == pytest.approx(lo) and held.high == pytest.approx(hi)
    plan, grid = P.slice_plan(P.fibonacci_normals(spark, 4), held.shape[::-1], 5.0, 2.0), P.patch_grid(spark, 24, (1, 2), 0.25)
    a, b = (volume.build_index(plan, grid, v, size=24, step=1.0).orderBy("patch_id").collect() for v in (held, volume.normalise(data)))
    assert [r.patch_id for r in a] == [r.patch_id for r in b] and np.allclose([r.embedding for r in a], [r.embedding for r in b], atol=1e-5)


def test_single_files_are_written_whole_and_again(spark, tmp_path):
    rows = [(f"d{i % 3}/{i:03d}.bin", bytes([i]) * (i + 1)) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    for path in (str(tmp_path / "out"), f"file://{tmp_path}/out"):
        files.write_files(df, path)
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{tmp_path}/out").collect()
        got = {r.path.split("/out/")[1]: bytes(r.content) for r in found}
        assert got == dict(rows)
        assert not [p for p in (tmp_path / "out").rglob(".*")] and (tmp_path / "out" / "_SUCCESS").exists()
    for bad in ("../x", "/etc/x"):
        with pytest.raises(Exception, match="leads out"):
            files.write_files(spark.createDataFrame([(bad, b"")], "name string, content binary"), str(tmp_path / "out"))


@pytest.mark.parametrize("few", [10, 20_000])
def test_percentiles_are_exact(spark, few):
    rng = np.random.default_rng(1)
    for x in (rng.standard_normal(997), np.round(rng.standard_normal(800), 1), 10.0 ** rng.uniform(-300, 300, 500), np.r_[np.zeros(900), np.arange(50)], np.full(30, 2.5), np.array([1.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
        shares = (0.0, 0.25, 0.5, 1.0) if few == 20_000 else (0.005, 0.9)
        assert quantiles.percentiles(df, "v", shares, few=few, accuracy=50) == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12)
    assert quantiles.percentiles(df.filter("v IS NULL"), "v", (0.5,)) == [None]

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelrank import cli
from voxelrank.operators import images, volume
from voxelrank.sources import png


def test_index_search_report(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    cli.main(["index", "--normals", "6", "--depth-step", "6", "--size", "48", "--scales", "1", "2", "--out", at("index")])
    patches = spark.read.parquet(at("index"))
    assert patches.count() > 20
    views = patches.limit(3).select((F.col("patch_id") + 10**12).alias("query_id"), F.lit(0).alias("view_idx"), F.lit("global").alias("branch"), F.col("embedding").alias("emb"))
    views.write.parquet(at("views"))
    cli.main(["search", "--index", at("index"), "--queries", at("views"), "--k", "5", "--out", at("hits")])
    hits = spark.read.option("header", True).option("inferSchema", True).csv(at("hits"))
    top = hits.filter("rank = 1").collect()
    assert len(top) == 3 and all(abs(r.score - 1) < 1e-9 for r in top)
    run = hits.select(F.col("query_id").alias("row_idx"), F.lit("allen").alias("source"), "rank", (F.col("rank") * 10.0).alias("geom_dist_vox"))
    run.write.parquet(at("run"))
    cli.main(["report", "--runs", at("run"), at("run"), "--out", at("report")])
    report = spark.read.option("header", True).csv(at("report"))
    assert "delta_run_2" in report.columns and report.filter("metric = 'Geom@1 mean' AND `group` = 'ALL'").count() == 2


def test_search_with_images(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    cli.main(["index", "--normals", "6", "--depth-step", "6", "--size", "48", "--scales", "1", "--out", at("index")])
    data = volume.normalise(volume.synthetic_volume())
    whole = spark.read.parquet(at("index")).orderBy("patch_id").collect()
    (tmp_path / "png").mkdir()
    for i, r in enumerate(whole):  # the very slices that were indexed, as files
        pose = {"nx": r.normal_x, "ny": r.normal_y, "nz": r.normal_z, "depth": r.depth_vox, "rot": r.rotation_deg, "size_px": 48, "step": 32 / 48}
        (tmp_path / "png" / f"{i:03d}.png").write_bytes(png.encode_png(volume.resample(data, pose)))
    read = lambda n: spark.read.option("header", True).option("inferSchema", True).csv(at(n)).collect()
    search = ["search", "--index", at("index"), "--images", at("png"), "--k", "3"]
    cli.main([*search, "--out", at("cropped")])
    cli.main([*search, "--no-auto-crop", "--out", at("whole")])
    stored, ids, encode = np.array([r.embedding for r in whole]), np.array([r.patch_id for r in whole]), volume.pooled_encoder()
    for name, crop in (("cropped", images.crop_foreground), ("whole", lambda image: image)):
        hits = read(name)
        assert {h.query_id for h in hits} == set(range(-len(whole), 0))
        found = {(h.path.rsplit("/", 1)[1], h["rank"]): h for h in hits}
        assert len(found) == len(hits) == 3 * len(whole)
        for i in range(len(whole)):  # brute force over all views and patches
            image = images.pad_square(crop(png.decode_png((tmp_path / "png" / f"{i:03d}.png").read_bytes())))
            views = np.array([encode(images.turn(image, angle, x, y)) for angle in (0, 90, 180, 270) for x in (False, True) for y in (False, True)])
            best = np.sort((views @ stored.T).max(0))[::-1][:3]
            for rank in (1, 2, 3):
                hit = found[f"{i:03d}.png", rank]
                assert abs(hit.score - best[rank - 1]) < 1e-9
                assert abs((views @ stored[ids == hit.patch_id][0]).max() - hit.score) < 1e-9
            if name == "whole":  # a slice as it was indexed, but for 8 bits, finds itself or its equal
                assert found[f"{i:03d}.png", 1].score > 0.9999
    with pytest.raises(SystemExit):
        cli.main(["search", "--index", at("index"), "--out", at("none")])


def test_bad_arguments(tmp_path):
    with pytest.raises(SystemExit):
        cli.main(["index", "--overlap", "1.5", "--out", str(tmp_path)])


def test_dataset_eval_train(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    cli.main(["index", "--normals", "6", "--depth-step", "6", "--size", "32", "--scales", "1", "2", "--out", at("index")])
    cli.main(["dataset", "--planes", "2", "--size", "32", "--out", at("data")])
    shared = ["--index", at("index"), "--dataset", at("data"), "--size", "32"]
    cli.main(["eval", *shared, "--final-k", "8", "--k-per-view", "12", "--out", at("hits"), "--limit", "6"])
    hits = spark.read.parquet(at("hits/fast")).cache()
    assert hits.select("row_idx").distinct().count() == 6 and hits.filter("rank = 1").count() == 6
    cli.main(["eval", *shared, "--final-k", "8", "--k-per-view", "12", "--out", at("hits")])
    more = spark.read.parquet(at("hits/fast"))
    assert more.select("row_idx").distinct().count() == 20 and more.groupBy("row_idx", "source", "rank").count().filter("count > 1").count() == 0
    assert hits.select("row_idx", "rank", "patch_id").exceptAll(more.select("row_idx", "rank", "patch_id")).count() == 0
    cli.main(["train", *shared, "--hits", at("hits/fast"), "--epochs", "2", "--hidden", "8", "4", "--min-candidates", "3", "--out", at("model")])
    losses = spark.read.option("header", True).csv(at("model/losses"))
    assert {r.split for r in losses.collect()} == {"train", "val", "test"} and spark.read.option("header", True).csv(at("model/history")).count() == 3
    cli.main(["eval", *shared, "--final-k", "8", "--k-per-view", "12", "--limit", "1", "--model", at("model/model"), "--out", at("again")])
    assert spark.read.parquet(at("again/fast")).filter("rerank_score IS NULL").count() == 0


@pytest.mark.parametrize("kind", ["auto", "graph", "ivf"])
def test_search_and_eval_with_a_kept_index(spark, tmp_path, kind):
    at = lambda n: str(tmp_path / n)
    make = ["index", "--normals", "6", "--depth-step", "6", "--size", "32", "--scales", "1", "2", "--vectors", at("vectors"), "--strategy", kind, "--out"]
    cli.main([*make, at("index")])
    with pytest.raises(FileExistsError):
        cli.main([*make, at("other")])
    spark.read.parquet(at("index")).filter("patch_id % 5 = 0").select((F.col("patch_id") + 10**12).alias("query_id"), F.lit(0).alias("view_idx"), F.lit("global").alias("branch"), F.col("embedding").alias("emb")).write.parquet(at("views"))
    found = {}
    for name, more in (("all", []), ("kept", ["--vectors", at("vectors")])):
        cli.main(["search", "--index", at("index"), "--queries", at("views"), "--k", "5", *more, "--out", at(name)])
        found[name] = {(r.query_id, r.patch_id) for r in spark.read.option("header", True).csv(at(name)).collect()}
    assert len(found["all"] & found["kept"]) >= (1 if kind == "auto" else 0.8) * len(found["all"])
    if kind == "auto":
        shared = ["--index", at("index"), "--dataset", at("data"), "--size", "32", "--final-k", "8", "--k-per-view", "12", "--limit", "2", "--out", at("hits")]
        cli.main(["dataset", "--planes", "1", "--size", "32", "--out", at("data")])
        cli.main(["eval", *shared])
        cli.main(["eval", *shared, "--vectors", at("vectors")])  # results of another index are kept apart
        hits = spark.read.parquet(at("hits/fast"))
        same = hits.groupBy("row_idx", "rank", "patch_id").agg(F.count_distinct("eval_sig").alias("n"))
        assert hits.select("eval_sig").distinct().count() == 2 and same.filter("n <> 2").count() == 0

"""Command line: build a patch index and a dataset, search, evaluate, report and compare runs, train the re-ranker, turn and resample volumes.

    python -m voxelrank.cli index --volume brain.nii.gz --out index/
    python -m voxelrank.cli dataset --volume brain.nii.gz --planes 100 --out dataset/
    python -m voxelrank.cli eval --index index/ --dataset dataset/ --volumes plain=brain.nii.gz --mode all --out hits/
    python -m voxelrank.cli train --index index/ --dataset dataset/ --volumes plain=brain.nii.gz --hits hits/smart --out model/
    python -m voxelrank.cli search --index index/ --queries views.parquet --out hits/
    python -m voxelrank.cli search --index index/ --images slices/ --mode smart --model model/model --out hits/
    python -m voxelrank.cli report --runs a.parquet b.parquet --out report/
    python -m voxelrank.cli register --fixed atlas.nii.gz --moving scan.nii.gz --out scan_turned.nii.gz
    python -m voxelrank.cli resample --volume scan_10um.nii.gz --spacing 25 25 25 --out scan_25um.nii.gz
    python -m voxelrank.cli foreground --labels atlas_labels.nii.gz --slices 1000 --out shares/
"""

from __future__ import annotations

import argparse

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelrank.operators import builder, evaluate, grids, images, metrics, registration, rerank, training, vector_index, volume
from voxelrank.plans import generators as P
from voxelrank.session import session, written
from voxelrank.sources import files, png, tables
from voxelrank.streaming import incremental

#: How each evaluation mode uses local windows.
MODES = {"fast": "off", "smart": "auto", "enhanced": "force"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxelrank")
    what = top.add_subparsers(dest="what", required=True)
    index = what.add_parser("index", help="resample, filter and encode patches of a volume")
    index.add_argument("--volume", help="NIfTI file; an analytic volume if left out")
    index.add_argument("--normals", type=int, default=64)
    index.add_argument("--depth-step", type=float, default=2.0)
    index.add_argument("--margin", type=float, default=0.0)
    index.add_argument("--size", type=int, default=512)
    index.add_argument("--scales", type=int, nargs="+", default=[1, 2, 4])
    index.add_argument("--overlap", type=float, default=0.25)
    index.add_argument("--vectors", metavar="FOLDER", help="also keep a vector index here, which search and eval can open")
    index.add_argument("--strategy", choices=["auto", "flat", "graph", "ivf", "ivfpq"], default="auto", help="kind of the vector index; auto goes by its size")
    index.add_argument("--rotations", type=float, nargs="+", default=[0.0], help="turns of each slice in its plane, in degrees")
    index.add_argument("--images", metavar="FOLDER", help="also write each patch as an image file into this folder")
    search = what.add_parser("search", help="fused top-k of query images, or of ready views of them")
    search.add_argument("--index", required=True)
    asked = search.add_mutually_exclusive_group(required=True)
    asked.add_argument("--images", help="PNG file, folder or pattern")
    asked.add_argument("--queries", help="Parquet of query_id, view_idx, branch, emb")
    search.add_argument("--mode", choices=[*MODES], default="fast", help="local windows of --images")
    search.add_argument("--no-auto-crop", action="store_true", help="keep the background around --images")
    search.add_argument("--model", help="re-rank with this model")
    search.add_argument("--rerank-mode", choices=["max_over_angles", "best_angle", "per_hit_angle"], default="max_over_angles")
    search.add_argument("--k", type=int, default=10)
    search.add_argument("--k-per-view", type=int, default=64)
    search.add_argument("--scales", type=int, nargs="*", default=[])
    search.add_argument("--w-local", type=float, default=0.35)
    report = what.add_parser("report", help="metrics of one run, or a comparison; the first run is the baseline")
    report.add_argument("--runs", nargs="+", required=True)
    report.add_argument("--labels", nargs="*")
    report.add_argument("--ks", type=int, nargs="+", default=list(metrics.KS))
    dataset = what.add_parser("dataset", help="random valid planes of a volume with crops of each")
    dataset.add_argument("--volume")
    dataset.add_argument("--real", help="a second volume on the same grid, for the images of the rows")
    dataset.add_argument("--images", metavar="FOLDER", help="also write an image file of each row and volume into this folder")
    dataset.add_argument("--crop-attempts", type=int, default=50, help="draws for each crop until one is valid")
    dataset.add_argument("--planes", type=int, default=100)
    dataset.add_argument("--seed", type=int, default=42)
    dataset.add_argument("--aspects", nargs="+", default=[f"{k}={w:g}:{h:g}" for k, (w, h) in builder.ASPECTS.items()], metavar="KIND=W:H")
    ev = what.add_parser("eval", help="search with every dataset row that has no complete hits yet, and measure what is found")
    ev.add_argument("--mode", choices=[*MODES, "all"], default="fast")
    ev.add_argument("--final-k", type=int, default=100)
    ev.add_argument("--k-per-view", type=int, default=64)
    ev.add_argument("--limit", type=int, help="only rows below this row number")
    ev.add_argument("--model", help="re-rank with this model")
    ev.add_argument("--rerank-mode", choices=["max_over_angles", "best_angle", "per_hit_angle"], default="max_over_angles")
    train = what.add_parser("train", help="fit the re-ranker on evaluation hits")
    train.add_argument("--hits", required=True)
    train.add_argument("--epochs", type=int, default=50)
    train.add_argument("--hidden", type=int, nargs=2, default=[512, 256])
    train.add_argument("--min-candidates", type=int, default=8)
    register = what.add_parser("register", help="turn a volume into the orientation that correlates best with another one")
    register.add_argument("--fixed", required=True)
    register.add_argument("--moving", required=True)
    register.add_argument("--stride", type=int, default=4, help="compare every so many voxels of each axis")
    register.add_argument("--scores", metavar="FOLDER", help="also write the correlation of all 48 orientations")
    regrid = what.add_parser("resample", help="a volume on a grid of another spacing")
    regrid.add_argument("--volume", required=True)
    regrid.add_argument("--spacing", type=float, nargs=3, required=True, metavar=("Z", "Y", "X"), help="in the unit of the file")
    ground = what.add_parser("foreground", help="shares of labelled voxels, of a volume and of random slices")
    ground.add_argument("--labels", required=True)
    ground.add_argument("--slices", type=int, default=1000)
    ground.add_argument("--size", type=int, default=512)
    ground.add_argument("--least", type=float, default=0.0, help="leave out slices with a smaller share")
    ground.add_argument("--seed", type=int, default=42)
    for p in (ev, train):
        p.add_argument("--index", required=True)
        p.add_argument("--dataset", required=True)
        p.add_argument("--volumes", nargs="+", default=["plain="], help="name=file; an analytic volume without a file")
    for p in (search, ev):
        p.add_argument("--vectors", metavar="FOLDER", help="find neighbours in this vector index, made with --index; all patches are compared without one")
    for p in (index, dataset, ev, train):
        p.add_argument("--axes", choices=["ijk", "kji"], default="ijk", help="order of a volume file's axes: as stored, or turned")
    for p in (dataset, ev, train):
        p.add_argument("--size", type=int, default=512)
    for p in (index, search, report, dataset, ev, train, register, regrid, ground):
        p.add_argument("--out", required=True)
    return top


def _volume(spark, path: str | None, axes: str = "ijk"):
    """A normalised volume: a NIfTI file that tasks open, or the analytic one."""
    if not path:
        return volume.normalise(volume.synthetic_volume())
    return volume.normalised_file(spark, path, axes)


def _volumes(spark, named: list[str], axes: str = "ijk"):
    return {name: _volume(spark, path, axes) for name, _, path in (n.partition("=") for n in named)}


def _index(spark, a) -> None:
    if a.vectors and vector_index.exists(spark, a.vectors):  # before anything is written
        raise FileExistsError(f"an index is at {a.vectors} already")
    data = _volume(spark, a.volume, a.axes)
    plan = P.slice_plan(P.fibonacci_normals(spark, a.normals), data.shape[::-1], a.depth_step, a.margin, tuple(a.rotations))
    grid = P.patch_grid(spark, a.size, tuple(a.scales), a.overlap)
    made = volume.build_index(plan, grid, data, size=a.size, step=max(data.shape) / a.size, images=bool(a.images))
    if a.images:  # once for the manifest and once for the files, so patches are not encoded twice
        made = written(made.withColumn("image_relpath", images.patch_path(F.col("patch_id"))))
        files.write_files(made.select(F.col("image_relpath").alias("name"), "content"), a.images)
        made = made.drop("content").withColumn("image_name", F.element_at(F.split("image_relpath", "/"), -1))
    tables.write_index(made, a.out)
    if a.vectors:
        vector_index.build_index(tables.read_manifest(spark, a.out).select("patch_id", F.col("embedding").alias("emb")), a.vectors, a.strategy)


def _kept(spark, a) -> vector_index.Index | None:
    return vector_index.open_index(spark, a.vectors) if a.vectors else None


def _dataset(spark, a) -> None:
    data = _volume(spark, a.volume, a.axes)
    step = max(data.shape) / a.size
    other = _volume(spark, a.real, a.axes) if a.real else data
    if other.shape != data.shape:
        raise SystemExit("both volumes must have the same grid")
    planes = written(builder.valid_planes(spark, a.planes, data, a.size, step, seed=a.seed))
    aspects = {kind: tuple(map(float, pair.split(":"))) for kind, pair in (x.split("=") for x in a.aspects)}
    rows = builder.build_dataset(planes, a.seed, aspects, data, a.size, step, a.crop_attempts).withColumn("vector", F.array("nx", "ny", "nz"))
    if a.images:
        rows = written(builder.image_names(rows, a.images))
        files.write_files(builder.dataset_images(rows, {"allen": data, "real": other}, a.size, step), a.images)
    tables.write_dataset(rows, a.out)


def _register(spark, a) -> None:
    fixed, moving = (files.VolumeFile(path, "kji") for path in (a.fixed, a.moving))
    read = lambda v: files.voxels(files.read_volume(spark, v.path, "kji"))
    scores = written(grids.orientation_scores(read(fixed), read(moving), fixed.shape, moving.shape, a.stride))
    if a.scores:
        columns = (F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("perm", "flips"))
        tables.write_csv(scores.select(*columns, "corr", "n").orderBy(F.desc("corr"), "perm", "flips"), a.scores)
    best = scores.orderBy(F.desc("corr"), "perm", "flips").first()
    if best is None:
        raise SystemExit("the volumes share no voxel")
    shape, spacing = (tuple(of[p] for p in best["perm"]) for of in (moving.shape, moving.spacing))
    turned = grids.oriented(read(moving), moving.shape, tuple(best["perm"]), tuple(best["flips"]))
    files.write_volume(grids.planes(turned), a.out, shape, spacing, moving.kind)


def _resample(spark, a) -> None:
    data = files.VolumeFile(a.volume, "kji")
    laid = grids.regridded(files.voxels(files.read_volume(spark, a.volume, "kji")), data.shape, data.spacing, tuple(a.spacing))
    files.write_volume(grids.planes(laid), a.out, registration.regrid_shape(data.shape, data.spacing, tuple(a.spacing)), tuple(a.spacing), data.kind)


def _foreground(spark, a) -> None:
    labels = files.VolumeFile(a.labels, "kji", labels=True)
    step = max(labels.shape) / a.size
    shares = volume.fg_bg_ratio(files.voxels(files.read_volume(spark, a.labels, "kji", labels=True)), F.col("value"), 0)
    tables.write_csv(shares.coalesce(1), f"{a.out}/voxels")
    slices = registration.slice_foreground(spark, labels, a.slices, a.size, step, a.least, a.seed)
    tables.write_csv(registration.slice_statistics(slices).coalesce(1), f"{a.out}/slices")


def _eval(spark, a) -> None:
    volumes, rows = _volumes(spark, a.volumes, a.axes), tables.read_dataset(spark, a.dataset)
    rows = rows.filter(F.col("row_idx") < a.limit) if a.limit is not None else rows
    weights = training.load_model(spark, a.model) if a.model else None
    step, kept = max(max(v.shape) for v in volumes.values()) / a.size, _kept(spark, a)
    made_with = f"{a.index} {kept.path} {kept.version}" if kept else a.index
    for mode in MODES if a.mode == "all" else [a.mode]:
        out = f"{a.out}/{mode}"
        cfg = evaluate.EvalConfig(size_px=a.size, step=step, local=MODES[mode], final_k=a.final_k, k_per_view=a.k_per_view, index_version=made_with)
        markers, sources, sig = incremental.read_markers(spark, out), sorted(volumes), cfg.signature()
        todo = written(incremental.pending_marked(rows, markers, sig, sources))
        if not todo.isEmpty():
            hits = evaluate.evaluate(todo, volumes, tables.read_manifest(spark, a.index), volume.pooled_encoder(), cfg, weights=weights, mode=a.rerank_mode, index=kept)
            incremental.append_marked(hits, todo.select("row_idx", F.explode(F.array(*map(F.lit, sources))).alias("source")), out, sig)


def _search(spark, a) -> None:
    patches = tables.read_manifest(spark, a.index)
    weights = training.load_model(spark, a.model) if a.model else None
    if a.images:
        cfg = evaluate.EvalConfig()
        read = png.read_png_images(spark, a.images)
        # Queries are numbered -1, -2 .. by path; only paths meet in one task.
        ids = written(spark.read.format("binaryFile").load(a.images).select("path").withColumn("query_id", -F.row_number().over(Window.orderBy("path")).cast("long")))
        cut = images.prepared(read, not a.no_auto_crop).withColumn("crops", P.crop_boxes(F.col("width"), F.col("height"), mode=MODES[a.mode]))
        views = written(images.embed_views(cut.join(ids, "path"), P.view_grid(spark, cfg.angles, cfg.flip_x, cfg.flip_y), volume.pooled_encoder(), auto_crop=False))
    else:
        views = spark.read.parquet(a.queries)
    hits = evaluate.search(views, patches, a.k_per_view, a.k, a.w_local, tuple(a.scales), weights, mode=a.rerank_mode, index=_kept(spark, a))
    tables.write_csv(hits.join(ids, "query_id") if a.images else hits, a.out)


def _train(spark, a) -> None:
    volumes, patches = _volumes(spark, a.volumes, a.axes), tables.read_manifest(spark, a.index)
    vectors = patches.select("patch_id", F.col("embedding").alias("emb"))
    cfg = rerank.RerankerConfig(dim=len(vectors.first()["emb"]), hidden=tuple(a.hidden), epochs=a.epochs)
    hits = tables.read_hits(spark, a.hits).withColumnRenamed("geom_dist_vox", "dist")
    step = max(max(v.shape) for v in volumes.values()) / a.size
    queries = training.kept_query_vectors(f"{a.out}/vectors", tables.read_dataset(spark, a.dataset), volumes, volume.pooled_encoder(), evaluate.EvalConfig(size_px=a.size, step=step), "pooled-16-64-7")
    pool = written(hits.select("row_idx", "source", "patch_id", "rank", "dist"))
    splits = written(training.prepare(pool, vectors, cfg, least=a.min_candidates)[1])
    draw = lambda epoch: training.training_lists(training.prepare(pool, vectors, cfg, a.min_candidates, epoch)[0], queries, vectors)
    weights, history = training.fit(draw, splits, cfg)
    training.save_model(spark, weights, f"{a.out}/model")
    tables.write_csv(spark.createDataFrame(history, training.HISTORY).coalesce(1), f"{a.out}/history")
    lists = draw(0)
    losses = training.list_losses(lists, weights, cfg).join(splits, "row_idx").groupBy("split").agg(F.avg("loss").alias("loss"), F.count("*").alias("lists"))
    tables.write_csv(losses, f"{a.out}/losses")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.what == "index" and not (0 <= a.overlap < 1 and a.depth_step > 0 and a.margin >= 0):
        raise SystemExit("overlap must be in [0, 1), the step positive, the margin not negative")
    spark = session()
    if a.what == "index":
        _index(spark, a)
    elif a.what == "search":
        _search(spark, a)
    elif a.what == "dataset":
        _dataset(spark, a)
    elif a.what == "register":
        _register(spark, a)
    elif a.what == "resample":
        _resample(spark, a)
    elif a.what == "foreground":
        _foreground(spark, a)
    elif a.what == "eval":
        _eval(spark, a)
    elif a.what == "train":
        _train(spark, a)
    else:
        paths = metrics.named_runs(a.runs, a.labels)
        hits = {n: tables.read_hits(spark, p).withColumnRenamed("geom_dist_vox", "dist").withColumnRenamed("gt_tau_vox", "tau") for n, p in paths.items()}
        first = metrics.thresholds_of(next(iter(hits.values()))).first()
        tidy = {n: metrics.report_metrics(h, tuple(first), tuple(a.ks)) for n, h in hits.items()}
        result = metrics.mark_best(metrics.compare_runs(tidy), list(tidy)) if len(tidy) > 1 else next(iter(tidy.values()))
        tables.write_csv(result.orderBy("group", "source", "metric"), a.out)


if __name__ == "__main__":
    main()

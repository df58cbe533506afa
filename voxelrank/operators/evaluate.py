"""Evaluation: query planes are rendered, searched and measured against the geometry of what is found."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelrank.functions import geometry as G
from voxelrank.operators import distance, fusion, rerank, targets, topk, vector_index
from voxelrank.operators.images import crop_foreground, embed_views
from voxelrank.operators.volume import opened, resample
from voxelrank.plans import generators as P
from voxelrank.session import written
from voxelrank.streaming import incremental


@dataclass(frozen=True)
class EvalConfig:
    size_px: int = 512
    step: float = 1.0
    angles: tuple[float, ...] = (0.0, 90.0, 180.0, 270.0)
    flip_x: bool = True
    flip_y: bool = True
    auto_crop: bool = True
    local: str = "off"
    w_local: float = 0.35
    k_per_view: int = 64
    final_k: int = 100
    grid: int = 64
    trim: float = 0.10
    tau_divisor: float = 3.0
    tau_low: float = 1e-3
    tau_high: float = 1e4
    um_per_voxel: float = 25.0
    index_version: str = ""

    def signature(self) -> str:
        """Names results that belong together, the version of the index included."""
        return incremental.signature(asdict(self))


def query_id(sources: list[str]):
    """One id for a row and source, below zero so that it never is a patch id."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    return -(F.col("row_idx") * len(sources) + place).cast("long")


def posed_rows(rows: DataFrame, sources: list[str], cfg: EvalConfig) -> DataFrame:
    """A row for each query plane and source, with its crop box and the struct ``query_pose``."""
    v, size = F.col("vector"), cfg.size_px
    box = F.when(F.col("is_crop") == 1, G.crop_norm(F.col("crop_cx"), F.col("crop_cy"), F.col("crop_rw"), F.col("crop_rh"), size, size)).otherwise(F.struct(*(F.lit(x).alias(n) for n, x in (("x0", 0), ("y0", 0), ("x1", size), ("y1", size)))))
    laid = rows.withColumn("box", box).withColumn("source", F.explode(F.array(*map(F.lit, sources))))
    parts = {"nx": v[0], "ny": v[1], "nz": v[2], "depth": F.col("depth"), "rot": F.col("rotation"), "step": F.lit(cfg.step), "size_px": F.lit(size), "x0": F.col("box.x0"), "y0": F.col("box.y0"), "h": F.col("box.y1") - F.col("box.y0"), "w": F.col("box.x1") - F.col("box.x0")}
    return laid.withColumn("query_pose", F.struct(*(c.cast("double").alias(n) for n, c in parts.items()))).withColumn("query_id", query_id(sources))


def render(posed: DataFrame, volumes: dict[str, np.ndarray], cfg: EvalConfig) -> DataFrame:
    """``query_id, height, width, pixels``: each pose cut from its source's volume, cropped to the foreground if asked for."""
    shared = posed.sparkSession.sparkContext.broadcast(volumes)

    def run(batches):
        for b in batches:
            for q, source, p in zip(b["query_id"], b["source"], b["query_pose"]):
                x0, y0, w, h = (int(p[k]) for k in ("x0", "y0", "w", "h"))
                image = resample(opened(shared.value[source]), p)[y0 : y0 + h, x0 : x0 + w]
                image = crop_foreground(image) if cfg.auto_crop else image
                yield pd.DataFrame({"query_id": [q], "height": [image.shape[0]], "width": [image.shape[1]], "pixels": [image.astype(np.float32).ravel()]})

    return posed.select("query_id", "source", "query_pose").mapInPandas(run, "query_id long, height int, width int, pixels array<float>")


def query_views(posed: DataFrame, volumes: dict[str, np.ndarray], encoder: Callable[[np.ndarray], np.ndarray], cfg: EvalConfig) -> DataFrame:
    """``query_id, view_idx, branch, crop_id, emb``: global views, then those of the local windows."""
    images = render(posed, volumes, cfg).withColumn("crops", P.crop_boxes(F.col("width"), F.col("height"), mode=cfg.local))
    return embed_views(images, P.view_grid(posed.sparkSession, cfg.angles, cfg.flip_x, cfg.flip_y), encoder, auto_crop=False)


def _corners(pose):
    """Corner, end of the first row and end of the first column of a pose, in voxels from the centre."""
    basis = G.plane_basis(G.vec(pose["nx"], pose["ny"], pose["nz"]), pose["rot"])

    def at(b, col, row):
        half = (pose["size_px"] - 1) / 2
        x, y = (pose["x0"] + col - half) * pose["step"], (pose["y0"] + row - half) * pose["step"]
        return G.let(G.unit(G.vec(pose["nx"], pose["ny"], pose["nz"])), lambda n: G.vec(*(n[c] * pose["depth"] + b["u"][c] * x + b["v"][c] * y for c in "xyz")))

    none = F.lit(0.0)
    return G.let(basis, lambda b: F.struct(at(b, none, none).alias("a"), at(b, pose["w"] - 1, none).alias("b"), at(b, none, pose["h"] - 1).alias("c")))


def measure(hits: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Adds ``patch_pose, dist, corner_chamfer_3pt_um, tau, logit, prob`` to ranked hits with ``query_pose`` and manifest columns.

    A patch box of a pixel or less, or a hit without a manifest row, has no distance.
    """
    size = cfg.size_px
    held = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(size))
    x0, y0, x1, y1 = (held(c) for c in ("x0", "y0", "x1", "y1"))
    parts = {"nx": "normal_x", "ny": "normal_y", "nz": "normal_z", "depth": "depth_vox", "rot": "rotation_deg"}
    pose = F.struct(*(F.col(c).cast("double").alias(n) for n, c in parts.items()), F.lit(float(cfg.step)).alias("step"), F.lit(float(size)).alias("size_px"), *(c.cast("double").alias(n) for n, c in (("x0", x0), ("y0", y0), ("h", y1 - y0), ("w", x1 - x0))))
    posed = hits.withColumn("patch_pose", F.when((x1 > x0 + 1) & (y1 > y0 + 1), pose))
    far = distance.with_chamfer(posed, cfg.grid, cfg.trim)
    far = far.withColumn("_q", _corners(F.col("query_pose"))).withColumn("_p", F.when(F.col("patch_pose").isNotNull(), _corners(F.col("patch_pose"))))
    corner = distance.corner_chamfer([F.col(f"_q.{c}") for c in "abc"], [F.col(f"_p.{c}") for c in "abc"], cfg.um_per_voxel)
    return targets.soft_targets(far.withColumn("corner_chamfer_3pt_um", corner).drop("_q", "_p"), ["row_idx", "source"], cfg.tau_divisor, cfg.tau_low, cfg.tau_high)


def search(views: DataFrame, patches: DataFrame, k_per_view: int = 64, final_k: int = 100, w_local: float = 0.35, scales: tuple[int, ...] = (), weights: dict[str, np.ndarray] | None = None, rerank_topk: int = 100, mode: str = "max_over_angles", index: vector_index.Index | None = None) -> DataFrame:
    """Ranked slices for query views (query_id, view_idx, branch, emb): ``query_id, patch_id, score, rank, rerank_score`` and the manifest.

    ``scales`` is an allow-list, empty for all.  With ``weights`` the first ``rerank_topk`` hits of each
    query are re-ranked; else ``rerank_score`` is null.  Views are read several times: write them first.
    Neighbours come from the kept ``index`` of the same patches where one is given, else from all patches.
    """
    if index is None:
        near = topk.vector_topk(views, patches.select("patch_id", F.col("embedding").alias("emb")), k_per_view, skip_own=False)
    else:
        near = vector_index.search_index(index, views, k_per_view, skip_own=False)
    found = near.join(views.select("query_id", "view_idx", "branch"), ["query_id", "view_idx"])
    hits = fusion.with_manifest(fusion.fuse(fusion.evidence(found), 1.0, w_local), patches.drop("embedding"))
    ranked = fusion.rank_hits(fusion.dedup_slices(fusion.scale_filter(hits, scales) if scales else hits), final_k)
    if weights is None:
        return ranked.withColumn("rerank_score", F.lit(None).cast("double"))
    raw = rerank.score_hits(ranked.filter(F.col("rank") <= rerank_topk), views, patches, weights, mode)
    order = rerank.rerank_order(ranked.join(raw, ["query_id", "patch_id"], "left"), rerank_topk)
    return order.withColumn("rank", F.col("new_rank")).withColumnRenamed("raw", "rerank_score").drop("new_rank", "segment", "blend")


def evaluate(rows: DataFrame, volumes: dict[str, np.ndarray], patches: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], cfg: EvalConfig = EvalConfig(), done: DataFrame | None = None, weights: dict[str, np.ndarray] | None = None, rerank_topk: int = 100, mode: str = "max_over_angles", markers: DataFrame | None = None, index: vector_index.Index | None = None) -> DataFrame:
    """Ranked and measured hits of all dataset rows that are not done: complete in ``done`` (earlier hits), or marked in ``markers``.

    ``rows`` are parsed dataset rows with row_idx; ``patches`` an index with manifest columns and
    ``embedding``.  With ``weights`` the first ``rerank_topk`` hits are re-ranked, and
    ``primary_score`` is the re-ranker's where there is one.
    """
    sources, sig = sorted(volumes), cfg.signature()
    todo = rows if done is None else incremental.pending(rows, done, sig, cfg.final_k, sources)
    todo = incremental.pending_marked(todo, markers, sig, sources)
    posed = posed_rows(todo, sources, cfg)
    views = written(query_views(posed, volumes, encoder, cfg))
    ranked = search(views, patches, cfg.k_per_view, cfg.final_k, cfg.w_local, (), weights, rerank_topk, mode, index)
    keep = [c for c in ("is_crop", "crop_kind", "crop_bin") if c in posed.columns]
    area = G.crop_area(F.col("is_crop") == 1, F.col("crop_rw"), F.col("crop_rh")).alias("q_crop_area_frac")
    about = posed.select("query_id", "row_idx", "source", "query_pose", *(F.col(c).alias(f"q_{c}") for c in keep), area)
    # View angles repeat for the whole image and for each window, in the order of the grid.
    grid = P.view_grid(rows.sparkSession, cfg.angles, cfg.flip_x, cfg.flip_y)
    n_views = len(cfg.angles) * (1 + cfg.flip_x) * (1 + cfg.flip_y)
    turns = F.broadcast(grid.select(F.col("view_idx").alias("_turn"), F.col("angle").alias("query_angle_deg"), F.col("flip_x").alias("query_flip_x"), F.col("flip_y").alias("query_flip_y")))  # n_views rows
    found = ranked.join(about, "query_id").withColumn("_turn", F.col("view_idx") % n_views).join(turns, "_turn").withColumn("query_crop_id", (F.floor(F.col("view_idx") / n_views) - 1).cast("int"))
    order_by = F.when(F.col("rerank_score").isNotNull(), "rerank_score").otherwise("score")
    return measure(found, cfg).select(
        F.lit(sig).alias("eval_sig"), "row_idx", "source", "rank", "patch_id", "score", "rerank_score", order_by.alias("order_by"), F.coalesce("rerank_score", "score").alias("primary_score"),
        F.lit(cfg.local).alias("search_mode"), "query_angle_deg", "query_flip_x", "query_flip_y", F.col("branch").alias("query_branch"), "query_crop_id",
        *(F.col(f"query_pose.{a}").alias(f"q_{b}") for a, b in (("nx", "normal_x"), ("ny", "normal_y"), ("nz", "normal_z"), ("depth", "depth_vox"), ("rot", "rot_deg"))),
        *(f"q_{c}" for c in keep), "q_crop_area_frac", "normal_idx", "depth_idx", "rot_idx", "normal_x", "normal_y", "normal_z", "depth_vox", "rotation_deg", "scale", "patch_row", "patch_col", "x0", "y0", "x1", "y1",
        "corner_chamfer_3pt_um", F.col("dist").alias("geom_dist_vox"), F.col("tau").alias("gt_tau_vox"), F.col("logit").alias("gt_logit"), F.col("prob").alias("gt_prob"),
    )

"""Re-ranking: MLP scorer, query modes, blending, order; and its training."""

from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelrank.functions.numbers import blend, minmax, zscore


@dataclass(frozen=True)
class RerankerConfig:
    dim: int = 768
    hidden: tuple[int, int] = (512, 256)
    list_k: int = 64
    lr: float = 3e-4
    weight_decay: float = 1e-4
    clip: float = 1.0
    distance_weight: float = 0.25
    epochs: int = 10
    patience: int = 6
    min_delta: float = 1e-3
    seed: int = 42
    normalise: bool = True
    query_scale: int = 128  # hidden units of the scale that a query gives its scores; 0 for none
    dropout: float = 0.15
    train_topk: int = 100
    sampling: str = "stratified"
    wants: tuple[int, int, int] = (16, 24, 24)
    distance_loss: str = "huber"
    distance_target: str = "log1p"
    plateau_patience: int = 2
    plateau_factor: float = 0.5
    least_lr: float = 1e-6

    def __post_init__(self):
        checks = {
            "dim, hidden and epochs must be positive": self.dim >= 1 and min(self.hidden) >= 1 and self.epochs >= 1,
            "list_k must be positive": self.list_k >= 1,
            "train_topk must be positive": self.train_topk >= 1,
            "sampling is stratified or uniform": self.sampling in ("stratified", "uniform"),
            "distance_loss is huber or mse": self.distance_loss in ("huber", "mse"),
            "distance_target is raw, clipped or log1p": self.distance_target in ("raw", "clipped", "log1p"),
            "patience must be at least 1": self.patience >= 1,
            "min_delta must not be negative": self.min_delta >= 0,
            "plateau_patience must not be negative": self.plateau_patience >= 0,
            "plateau_factor lies between 0 and 1": 0 < self.plateau_factor < 1,
            "least_lr must not be negative": self.least_lr >= 0,
            "wants of stratified sampling must add up to list_k": self.sampling != "stratified" or sum(self.wants) == self.list_k,
            "lr must be positive, other rates not negative": self.lr > 0 and self.weight_decay >= 0 and self.distance_weight >= 0 and self.query_scale >= 0,
            "dropout lies in [0, 1)": 0 <= self.dropout < 1,
        }
        if broken := [message for message, fine in checks.items() if not fine]:
            raise ValueError("; ".join(broken))


def features(q: np.ndarray, c: np.ndarray, unit: bool = False) -> np.ndarray:
    """[q, c, |q-c|, q*c, cos, |q|, |c|] by row; of unit vectors if asked for."""
    if unit:
        q, c = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (q, c))
    nq, nc = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    cos = (q * c).sum(1) / np.maximum(nq * nc, 1e-12)
    return np.concatenate([q, c, np.abs(q - c), q * c, cos[:, None], nq[:, None], nc[:, None]], 1)


def init_weights(cfg: RerankerConfig) -> dict[str, np.ndarray]:
    rng, w, size = np.random.default_rng(cfg.seed), {}, 4 * cfg.dim + 3
    for i, h in enumerate(cfg.hidden):
        w |= {f"w{i}": rng.standard_normal((size, h)) / math.sqrt(size), f"b{i}": np.zeros(h), f"g{i}": np.ones(h), f"s{i}": np.zeros(h)}
        size = h
    if cfg.query_scale:
        w |= {"wq0": rng.standard_normal((cfg.dim, cfg.query_scale)) / math.sqrt(cfg.dim), "bq0": np.zeros(cfg.query_scale), "wq1": rng.standard_normal(cfg.query_scale) / math.sqrt(cfg.query_scale), "bq1": np.zeros(1)}
    w["unit"] = np.array([float(cfg.normalise)])  # travels with the weights, never trained
    return w | {"wr": rng.standard_normal(size) / math.sqrt(size), "br": np.zeros(1), "wd": rng.standard_normal(size) / math.sqrt(size), "bd": np.zeros(1)}


_erf = np.vectorize(math.erf, otypes=[float])


def _gelu(x):
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def _gelu_slope(x):
    return 0.5 * (1 + _erf(x / math.sqrt(2))) + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def forward(w: dict[str, np.ndarray], x: np.ndarray, q: np.ndarray | None = None, drop: tuple[float, np.random.Generator] | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """(rank scores, distance predictions, what the backward pass needs).

    With the query rows ``q`` the scale head, if there is one, multiplies the scores of a query;
    ``drop`` (a rate and a generator) drops hidden units while training.
    """
    kept = []
    for i in (0, 1):
        z = x @ w[f"w{i}"] + w[f"b{i}"]
        sd = np.sqrt(z.var(1, keepdims=True) + 1e-5)
        n = (z - z.mean(1, keepdims=True)) / sd
        a = n * w[f"g{i}"] + w[f"s{i}"]
        mask = (drop[1].random(a.shape) >= drop[0]) / (1 - drop[0]) if drop and drop[0] else 1.0
        kept.append((x, n, sd, a, mask))
        x = _gelu(a) * mask
    raw, scale = x @ w["wr"] + w["br"][0], None
    if q is not None and "wq0" in w:
        a = q @ w["wq0"] + w["bq0"]
        h = _gelu(a)
        s = h @ w["wq1"] + w["bq1"][0]
        scale = (q, a, h, raw, np.exp(np.clip(s, -5, 5)), np.abs(s) < 5)
    return raw if scale is None else raw * scale[4], x @ w["wd"] + w["bd"][0], [*kept, x, scale]


def score(w: dict[str, np.ndarray], q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rank scores of pairs of rows."""
    if 4 * q.shape[1] + 3 != len(w["w0"]) or q.shape != c.shape:
        raise ValueError(f"vectors of {q.shape[1]} and {c.shape[1]} components, but the model takes {(len(w['w0']) - 3) // 4}")
    return forward(w, features(q, c, bool(w.get("unit", [0])[0])), q)[0]


def backward(w, kept, dr: np.ndarray, dd: np.ndarray) -> dict[str, np.ndarray]:
    x, scale, g = kept[2], kept[3], {k: np.zeros_like(v) for k, v in w.items()}
    if scale is not None:
        q, a, h, raw, factor, inside = scale
        ds = dr * raw * factor * inside
        da = np.outer(ds, w["wq1"]) * _gelu_slope(a)
        g |= {"wq1": h.T @ ds, "bq1": ds.sum(keepdims=True), "wq0": q.T @ da, "bq0": da.sum(0)}
        dr = dr * factor
    g |= {"wr": x.T @ dr, "br": dr.sum(keepdims=True), "wd": x.T @ dd, "bd": dd.sum(keepdims=True)}
    dx = np.outer(dr, w["wr"]) + np.outer(dd, w["wd"])
    for i in (1, 0):
        xin, n, sd, a, mask = kept[i]
        da = dx * mask * _gelu_slope(a)
        g[f"g{i}"], g[f"s{i}"] = (da * n).sum(0), da.sum(0)
        dn = da * w[f"g{i}"]
        dz = (dn - dn.mean(1, keepdims=True) - n * (dn * n).mean(1, keepdims=True)) / sd
        g[f"w{i}"], g[f"b{i}"] = xin.T @ dz, dz.sum(0)
        dx = dz @ w[f"w{i}"].T
    return g


def save_weights(w: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def load_weights(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return dict(z)


def score_pairs(pairs: DataFrame, weights: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``raw``: the model's rank score for rows with arrays ``q`` and ``c``."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(score(shared.value, np.stack(q), np.stack(c)) if len(q) else [], dtype=float)

    return pairs.select(*keep, run("q", "c").alias("raw"))


def max_over_views(scored: DataFrame) -> DataFrame:
    """Best raw score of each (query_id, patch_id) over its views."""
    return scored.groupBy("query_id", "patch_id").agg(F.max("raw").alias("raw"))


def score_hits(hits: DataFrame, views: DataFrame, patches: DataFrame, weights: dict[str, np.ndarray], mode: str = "max_over_angles") -> DataFrame:
    """``query_id, patch_id, raw`` for hits with ``rank`` and ``view_idx``, by the query views that ``mode`` names.

    ``best_angle`` scores all hits with the view of the first, ``per_hit_angle`` each with its own,
    ``max_over_angles`` with every global view, keeping the best.
    """
    q = views.select("query_id", "view_idx", F.col("emb").alias("q"), *(["branch"] if "branch" in views.columns else []))
    slim = hits.select("query_id", "patch_id", "view_idx")
    if mode == "max_over_angles":
        pairs = slim.drop("view_idx").join(q.filter("branch = 'global'") if "branch" in q.columns else q, "query_id")
    elif mode == "per_hit_angle":
        pairs = slim.join(q, ["query_id", "view_idx"])
    elif mode == "best_angle":
        first = hits.groupBy("query_id").agg(F.min_by("view_idx", "rank").alias("view_idx"))
        pairs = slim.drop("view_idx").join(q.join(first, ["query_id", "view_idx"]), "query_id")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    vectors = patches.select("patch_id", F.col("embedding" if "embedding" in patches.columns else "emb").cast("array<double>").alias("c"))
    return max_over_views(score_pairs(pairs.join(vectors, "patch_id"), weights, ["query_id", "patch_id"]))


def rerank_order(hits: DataFrame, topk: int = 100, alpha: float = 1.0, norm: str = "zscore") -> DataFrame:
    """New ranks: the first ``topk`` by the blend of normalised coarse and raw scores, the rest as before.

    Adds ``blend`` (null in the rest), ``segment`` and ``new_rank``; hits have query_id, patch_id, rank, score, raw.
    """
    top = Window.partitionBy("query_id", "segment")
    f = {"zscore": zscore, "minmax": minmax}[norm]
    cut = hits.withColumn("segment", F.when(F.col("rank") <= max(topk, 1), 0).otherwise(1))
    mixed = F.when(F.col("segment") == 0, blend(f(F.col("score"), top), f(F.col("raw"), top), alpha))
    order = Window.partitionBy("query_id").orderBy("segment", F.desc("blend"), F.desc(F.when(F.col("segment") == 0, F.col("raw"))), "rank", "patch_id")
    return cut.withColumn("blend", mixed).withColumn("new_rank", F.row_number().over(order).cast("long"))


def list_parts(w: dict[str, np.ndarray], example, cfg: RerankerConfig, drop: tuple[float, np.random.Generator] | None = None, grad: bool = False):
    """(cross-entropy, distance loss, gradient of their weighted sum or None) of a list (query, candidates, soft targets, distance targets).

    The distance loss is Huber's or the mean square; candidates without a finite distance target are left out of it.
    """
    q, c, p, d = example
    rows = np.repeat(q[None], len(c), 0)
    r, dist, kept = forward(w, features(rows, c, bool(w.get("unit", [0])[0])), rows, drop)
    ls = r - r.max()
    ls -= np.log(np.exp(ls).sum())
    known = np.isfinite(d)
    e, n = np.where(known, dist - np.where(known, d, 0), 0), max(int(known.sum()), 1)
    if cfg.distance_loss == "mse":
        far, slope = (e * e).sum() / n, 2 * e / n
    else:
        far, slope = np.where(np.abs(e) <= 1, 0.5 * e * e, np.abs(e) - 0.5).sum() / n, np.clip(e, -1, 1) / n
    return -(p * ls).sum(), far, backward(w, kept, np.exp(ls) * p.sum() - p, cfg.distance_weight * slope) if grad else None


def list_loss(w: dict[str, np.ndarray], example, cfg: RerankerConfig) -> float:
    """Cross-entropy of a list plus the weighted distance loss."""
    rank, far, _ = list_parts(w, example, cfg)
    return rank + cfg.distance_weight * far


class Descent:
    """AdamW with a schedule: the rate falls by ``plateau_factor`` after each ``plateau_patience`` epochs without ``min_delta`` of
    progress, of which ``patience`` end the training; the best weights and the history are kept."""

    def __init__(self, cfg: RerankerConfig):
        self.cfg, self.w, self.lr, self.t = cfg, init_weights(cfg), cfg.lr, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        self.best, self.best_w, self.best_epoch, self.stale, self.history = math.inf, self.w, 0, 0, []

    def step(self, g: dict[str, np.ndarray]) -> None:
        """One step along a gradient, which is clipped to its greatest length."""
        size = math.sqrt(sum((x * x).sum() for x in g.values()))
        self.t += 1
        for k in self.w.keys() - {"unit"}:
            gk = g[k] * min(1.0, self.cfg.clip / max(size, 1e-12))
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * gk, 0.999 * self.v[k] + 0.001 * gk * gk
            self.w[k] = self.w[k] - self.lr * (self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8) + self.cfg.weight_decay * self.w[k])

    def close_epoch(self, epoch: int, parts: dict[str, tuple[float, float]]) -> bool:
        """Notes the mean losses (cross-entropy, distance) of train and val; False where training is over."""
        row = {"epoch": epoch, "lr": self.lr}
        for name, (rank, far) in parts.items():
            row |= {f"{name}_rank_loss": rank, f"{name}_dist_loss": far, f"{name}_loss": rank + self.cfg.distance_weight * far}
        self.history.append(row)
        if row["val_loss"] < self.best - self.cfg.min_delta:
            self.best, self.best_w, self.best_epoch, self.stale = row["val_loss"], {k: x.copy() for k, x in self.w.items()}, epoch, 0
            return True
        self.stale += 1
        if self.stale % max(self.cfg.plateau_patience, 1) == 0:
            self.lr = max(self.lr * self.cfg.plateau_factor, self.cfg.least_lr)
        return self.stale < self.cfg.patience


def train(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], cfg: RerankerConfig, held_out: list | None = None, groups=None) -> tuple[dict[str, np.ndarray], list[dict]]:
    """Training of lists (query, candidates, soft targets, distance targets) that are here; the best weights and the history.

    Listwise cross-entropy plus ``distance_weight`` times the distance loss, with dropout.  ``groups`` gives the
    mini-batches (places of lists) of an epoch, whose gradients are averaged; each list is one where not given.
    """
    run, held_out = Descent(cfg), held_out or examples
    mean = lambda parts: tuple(np.mean(parts, 0).tolist()) if parts else (0.0, 0.0)
    for epoch in range(cfg.epochs):
        seen, rng = [], np.random.default_rng((cfg.seed, epoch))
        for group in groups(epoch) if groups else rng.permutation(len(examples))[:, None]:
            found = [list_parts(run.w, examples[i], cfg, (cfg.dropout, rng), True) for i in group]
            seen += [f[:2] for f in found]
            run.step({k: sum(f[2][k] for f in found) / len(found) for k in found[0][2]})
        if not run.close_epoch(epoch, {"train": mean(seen), "val": mean([list_parts(run.w, ex, cfg)[:2] for ex in held_out])}):
            break
    return run.best_w, run.history

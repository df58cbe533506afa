"""Inverted lists with product-quantised residuals, and exact refinement of what they find."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelrank.functions.vectors import dot
from voxelrank.operators.cells import fit_cells, matrix, nearest, nearest_by_shard, nearest_cells
from voxelrank.operators.topk import VIEWS, ranked, shard_topk
from voxelrank.session import written

#: Codes of a shard that meet views in one go at most (in expectation); more are dealt out. Shards of lists that are not kept.
BLOCK, SHARDS = 1 << 15, 64
#: Vectors that fit the codebooks at most.
SAMPLE = 50_000


def list_count(n_train: int) -> int:
    """Lists for a training set: a fortieth of it in multiples of 128, from 256 to 65536."""
    return min(max(256, n_train // 40) // 128 * 128, 65536)


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres (lists, dim) and codebooks (parts, 2 ** bits, dim / parts) of their residuals."""

    centres: np.ndarray
    books: np.ndarray

    def nearest(self, x: np.ndarray, probes: int = 1) -> np.ndarray:
        """The ``probes`` nearest lists of each row, nearest first."""
        s = x @ self.centres.T - 0.5 * (self.centres**2).sum(1)
        return np.argsort(-s, axis=1, kind="stable")[:, :probes]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        left = (x - self.centres[cell]).reshape(len(x), len(self.books), -1)
        return np.stack([nearest(left[:, m], b) for m, b in enumerate(self.books)], 1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for; their inner products are the sums of lookup tables."""
        return self.centres[cell] + np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)


def _means(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        total, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fit_books(vectors: DataFrame, centres: np.ndarray, parts: int = 16, bits: int = 8, sample: int = SAMPLE, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Codebooks of the residuals of ``patch_id, emb``, fitted on at most ``sample`` vectors; all are coded later."""
    total = max(vectors.count(), 1)
    few = vectors.filter(F.pmod(F.xxhash64(F.lit(seed), "patch_id"), F.lit(total)) < sample).limit(sample).select(F.col("emb").cast("array<double>").alias("emb")).toArrow()
    x = matrix(few["emb"])
    if not len(x):
        raise ValueError("no vectors to train on")
    if x.shape[1] % parts or not 1 <= bits <= 8:
        raise ValueError("parts must divide the dimension, bits lie within 1 to 8")
    left = (x - centres[nearest(x, centres)]).reshape(len(x), parts, -1)
    rng = np.random.default_rng(seed)
    return np.stack([_means(left[:, m], 1 << bits, rounds, rng) for m in range(parts)])


def train_quantiser(patches: DataFrame, lists: int | None = None, parts: int = 16, bits: int = 8, sample: int = SAMPLE, seed: int = 42) -> Quantiser:
    """Lists and codebooks for ``patch_id, emb``."""
    centres = fit_cells(patches, lists or list_count(patches.count()), seed=seed)
    return Quantiser(centres, fit_books(patches, centres, parts, bits, sample, seed=seed))


def with_codes(rows: DataFrame, model: Quantiser) -> DataFrame:
    """Adds ``code``, one byte for each part, to rows with ``emb`` and ``cell``; no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("binary")
    def code(emb: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series([c.tobytes() for c in shared.value.encode(np.stack(emb), cell.to_numpy())] if len(emb) else [], dtype=object)

    return rows.withColumn("code", code(F.col("emb").cast("array<double>"), "cell"))


def encode_patches(patches: DataFrame, model: Quantiser) -> DataFrame:
    """``patch_id, emb, cell, code`` of each patch in its nearest list."""
    near = nearest_cells(patches.select(F.col("patch_id").cast("long").alias("patch_id"), F.col("emb").cast("array<double>").alias("emb")), model.centres, 1)
    return with_codes(near.select("patch_id", "emb", F.element_at("near", 1).alias("cell")), model)


def ivfpq_search(asked: DataFrame, rows: DataFrame, model: Quantiser, k: int, refine: int = 4, skip_own: bool = True) -> DataFrame:
    """``query_id, view_idx, patch_id, score, view_rank``: approximate top-k with exact scores.

    ``asked`` has the lists that each view looks into (query_id, view_idx, emb, shard, cells, first), ``rows`` the
    coded vectors (patch_id, emb, cell, shard, code).  Codes give the ``refine * k`` best of each view; these are
    scored on their vectors.  Lists and views meet in blocks of a shard, so no task holds a
    whole long one; a patch that several lists hold counts once.
    """
    shared = asked.sparkSession.sparkContext.broadcast(model)
    decode = lambda cell, code: shared.value.decode(cell, np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1))
    near = shard_topk(asked, rows, refine * k, skip_own, (BLOCK, min(BLOCK, VIEWS)), decode)
    kept = ranked(near, refine * k).select("query_id", "view_idx", "patch_id")
    vectors = rows.select("patch_id", F.col("emb").cast("array<double>").alias("p"))
    exact = kept.join(vectors, "patch_id").join(asked.filter("first").select("query_id", "view_idx", F.col("emb").alias("q")), ["query_id", "view_idx"])
    return ranked(exact.select("query_id", "view_idx", "patch_id", dot(F.col("q"), F.col("p")).alias("score")), k)


def ivfpq_topk(views: DataFrame, codes: DataFrame, model: Quantiser, k: int, probes: int = 8, refine: int = 4) -> DataFrame:
    """:func:`ivfpq_search` of views (query_id, view_idx, emb) in their ``probes`` nearest lists; none meets the patch of its own query id."""
    per_shard = -(-len(model.centres) // SHARDS)
    asked = written(nearest_by_shard(views, model.centres, probes, per_shard))
    return ivfpq_search(asked, codes.withColumn("shard", F.floor(F.col("cell") / per_shard).cast("int")), model, k, refine)

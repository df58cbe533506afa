"""Cells of vectors: k-means fitted by Spark jobs, and the nearest cells of each vector."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelrank.session import written

#: Distances to centres that are held at once; rows of views and shards that are handed on together.
HELD, ROWS = 1 << 20, 1 << 13
#: Cells at most; vectors for each cell that fit them at most; rounds of fitting at most.
CELLS, FITTED, ROUNDS = 65_536, 64, 8


def cell_count(n: int) -> int:
    """Cells for n vectors: a quarter of them, growing with the root of a larger number."""
    return max(1, min(n // 4, int(16 * math.sqrt(n)), CELLS))


def _nearness(x: np.ndarray, centres: np.ndarray):
    """Nearness of rows to centres, by slices of ``x``: HELD numbers at a time, however many rows and centres there are."""
    half, many = 0.5 * (centres**2).sum(1), max(1, HELD // max(len(centres), 1))
    for lo in range(0, len(x), many):
        s = x[lo : lo + many] @ centres.T
        s -= half
        yield s


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return np.concatenate([s.argmax(1) for s in _nearness(x, centres)]) if len(x) else np.empty(0, np.int64)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as rows of a matrix, without a Python number for each entry."""
    flat = column.combine_chunks()
    return np.array(flat.flatten(), float).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def fit_cells(vectors: DataFrame, cells: int, fitted: int = FITTED, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Centres of k-means over at most ``fitted`` vectors for each cell.

    Each round is a job: partitions sum their vectors by nearest centre, and sums meet by cell.  Only centres reach the driver.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col("emb").cast("array<double>").alias("emb"), F.xxhash64(F.lit(seed), "patch_id").alias("h"))
    share = cells * fitted / max(vectors.count(), 1)
    sample = written(slim if share >= 1 else slim.filter(F.pmod(F.col("h"), F.lit(1_000_000)) < int(share * 1_000_000)))
    centres = matrix(sample.orderBy("h").limit(cells).select("emb").toArrow()["emb"])
    if not len(centres):
        raise ValueError("no vectors to fit cells on")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def sums(batches):
            c = shared.value
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in batches:
                if len(b):
                    x = np.stack(b["emb"])
                    near = nearest(x, c)
                    np.add.at(total, near, x)
                    n += np.bincount(near, minlength=len(c))
            some = np.flatnonzero(n)
            if len(some):
                yield pd.DataFrame({"cell": some, "n": n[some], "total": list(total[some])})

        def meet(batches):
            parts = [b for b in batches if len(b)]
            if parts:  # all sums of a cell are here: as many rows as partitions, for each of this task's cells
                part = pd.concat(parts)
                cell, at = np.unique(part["cell"].to_numpy(), return_inverse=True)
                total, n = np.zeros((len(cell), len(part["total"].iloc[0]))), np.bincount(at, part["n"])
                np.add.at(total, at, np.stack(part["total"]))
                yield pd.DataFrame({"cell": cell, "centre": list(total / n[:, None])})

        moved = sample.select("emb").mapInPandas(sums, "cell int, n long, total array<double>").repartition("cell").mapInPandas(meet, "cell int, centre array<double>").toArrow()
        new = centres.copy()
        if len(moved):
            new[moved["cell"].to_numpy()] = matrix(moved["centre"])
        shared.unpersist()
        if np.abs(new - centres).max(initial=0) < 1e-9:
            break
        centres = new
    return centres


def _best(s: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` nearest cells of each row, in no order."""
    return np.argpartition(-s, many - 1, axis=1)[:, :many] if many < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))


def nearest_cells(vectors: DataFrame, centres: np.ndarray, many: int, emb: str = "emb") -> DataFrame:
    """Adds ``near array<int>``: the ``many`` nearest cells, nearest first; no shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def near(x: pd.Series) -> pd.Series:
        out = []
        for s in _nearness(np.stack(x), shared.value) if len(x) else ():
            at = _best(s, many)
            order = np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable")
            out += list(np.take_along_axis(at, order, 1).astype(np.int32))
        return pd.Series(out)

    return vectors.withColumn("near", near(F.col(emb).cast("array<double>")))


def nearest_by_shard(views: DataFrame, centres: np.ndarray, many: int, per_shard: int) -> DataFrame:
    """``query_id, view_idx, emb, shard, cells, first``: each view once for each shard (run of ``per_shard`` cells) with some of its ``many`` nearest cells.

    A vector goes where its cells are, not once for each of them; ``first`` marks one of a view's rows.  No shuffle.
    """
    shared = views.sparkSession.sparkContext.broadcast(centres)
    slim = views.select(F.col("query_id").cast("long"), F.col("view_idx").cast("int"), F.col("emb").cast("array<double>"))
    many = min(many, len(centres))
    step = max(1, ROWS // min(many, -(-len(centres) // per_shard)))

    def split(batches):
        for b in batches:
            for lo in range(0, len(b), step):
                part = b.iloc[lo : lo + step]
                near = np.concatenate([_best(s, many).astype(np.int32) for s in _nearness(np.stack(part["emb"]), shared.value)])
                near.sort(axis=1)
                shard = near // per_shard
                new = np.ones(near.shape, bool)
                new[:, 1:] = shard[:, 1:] != shard[:, :-1]
                row, col = np.nonzero(new)
                yield part.iloc[row].assign(shard=shard[row, col], cells=np.split(near.ravel(), np.flatnonzero(new)[1:]), first=col == 0)

    return slim.mapInPandas(split, "query_id long, view_idx int, emb array<double>, shard int, cells array<int>, first boolean")

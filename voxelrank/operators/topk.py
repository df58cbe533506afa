"""Vector top-k joins of query views with patches, over all of them or within cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelrank.session import written

#: Doubles of query views that may be broadcast (128 MB), views, and best patches that each task may hold for them; more are dealt out in a grid.
BROADCAST_DOUBLES, BROADCAST_VIEWS, BROADCAST_BEST = 16_000_000, 50_000, 1 << 18
#: Views and patches of a block of the grid; answers of blocks that a task ranks (in expectation).
VIEWS, PATCHES, ANSWERS = 8192, 32_768, 1 << 18
#: Scores that a task computes in one go; first patches whose k-th best score bounds that of a whole block from below.
SCORES, FIRST = 1 << 22, 2048
#: Scores of cells that are held before only the best stay.
HELD = 1 << 18
#: Rows of a block of patches or views of a cell.
BLOCK = 4096
FLAT_TO, GRAPH_TO = 200_000, 2_000_000
KINDS = ("auto", "flat", "graph", "ivf", "ivfpq")


def choose_index(n: int, kind: str = "auto", flat_to: int = FLAT_TO, graph_to: int = GRAPH_TO) -> str:
    """The kind of index for ``n`` vectors: searched whole, a neighbour graph, or inverted lists of codes; ``kind`` if it is one."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if kind != "auto":
        return kind
    return "flat" if n <= flat_to else "graph" if n <= graph_to else "ivfpq"


def _cut(view: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (view, id, score) of each view; ties to the smaller id."""
    order = np.lexsort((ids, -score, view))
    place = np.arange(len(order)) - np.searchsorted(view[order], view[order])
    order = order[place < k]
    return view[order], ids[order], score[order]


def _block(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, skip_own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_cut` of a block of patches for all views, SCORES at a time."""
    m, out, many = min(k, len(ids)), [], max(1, SCORES // len(ids))
    few = max(m, min(FIRST, len(ids)))
    for lo in range(0, len(q), many):
        s = q[lo : lo + many] @ x.T
        if skip_own:
            s[own[lo : lo + many, None] == ids] = -np.inf
        bound = np.partition(s[:, :few], few - m, axis=1)[:, [few - m]]
        row, col = np.nonzero(s >= np.maximum(bound, np.finfo(float).min))
        out.append(_cut(row + lo, ids[col], s[row, col], k))
    return tuple(np.concatenate(c) for c in zip(*out))


def _named(found: tuple[np.ndarray, np.ndarray, np.ndarray], keys: pd.DataFrame) -> pd.DataFrame:
    view, ids, score = found
    return pd.DataFrame({"query_id": keys["query_id"].to_numpy()[view], "view_idx": keys["view_idx"].to_numpy()[view], "patch_id": ids, "score": score})


def vector_topk(views: DataFrame, patches: DataFrame, k: int, skip_own: bool = True) -> DataFrame:
    """``query_id, view_idx, patch_id, score, view_rank``: the k patches of largest inner product for each view.

    ``views`` has query_id, view_idx, emb; ``patches`` has patch_id, emb.  With ``skip_own`` a view
    never meets the patch of its own query id.  Views are broadcast if they are within BROADCAST_DOUBLES, and
    the k best that a task holds for each within BROADCAST_BEST; then a partition of patches keeps its running
    k best over all of its batches and answers once, and no patch is shuffled.  More views meet the
    patches in a grid of blocks, whose answers are ranked by query in tasks of bounded size.
    """
    spark, out = views.sparkSession, "query_id long, view_idx int, patch_id long, score double"
    slim = views.select(F.col("query_id").cast("long"), F.col("view_idx").cast("int"), F.col("emb").cast("array<double>"))
    rows = patches.select(F.col("patch_id").cast("long"), F.col("emb").cast("array<double>"))
    most = min(BROADCAST_VIEWS, BROADCAST_BEST // k)
    size = slim.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("emb")), F.lit(0)).alias("doubles")).first()
    if size.n <= most and size.doubles <= BROADCAST_DOUBLES:
        held = slim.toPandas()
        shared = spark.sparkContext.broadcast((np.stack(held["emb"]) if len(held) else np.empty((0, 1)), held[["query_id", "view_idx"]]))

        def scan(batches):
            q, keys = shared.value
            best = None
            for b in batches:
                if len(b) and len(q):
                    new = _block(q, keys["query_id"].to_numpy(), np.stack(b["emb"]), b["patch_id"].to_numpy(), k, skip_own)
                    best = new if best is None else _cut(*map(np.concatenate, zip(best, new)), k)
            if best is not None:
                yield _named(best, keys)

        near = rows.mapInPandas(scan, out)
    else:
        slim, rows = written(slim), written(rows)  # counted and dealt out: evaluated once
        salt = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
        pb, qb = (max(1, -(-df.count() // most)) for df, most in ((rows, PATCHES), (slim, VIEWS)))
        tasks = min(2 * pb * qb, 4096)
        left = rows.withColumn("pb", salt("patch_id", pb)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
        right = slim.withColumn("qb", F.pmod(F.xxhash64("query_id", "view_idx"), F.lit(qb)).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(pb - 1))))

        def meet(p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(p) or not len(v):
                return pd.DataFrame({"query_id": [], "view_idx": [], "patch_id": [], "score": []})
            return _named(_block(np.stack(v["emb"]), v["query_id"].to_numpy(), np.stack(p["emb"]), p["patch_id"].to_numpy(), k, skip_own), v)

        met = left.repartition(tasks, "pb", "qb").groupBy("pb", "qb").cogroup(right.repartition(tasks, "pb", "qb").groupBy("pb", "qb")).applyInPandas(meet, out)
        near = met.repartition(max(1, -(-size.n * k * pb // ANSWERS)), "query_id")
    order = Window.partitionBy("query_id", "view_idx").orderBy(F.desc("score"), "patch_id")
    return near.withColumn("view_rank", F.row_number().over(order)).filter(F.col("view_rank") <= k)


def list_topk(asked: DataFrame, rows: DataFrame, k: int, skip_own: bool = True) -> DataFrame:
    """``query_id, view_idx, patch_id, score``: the k best of each view in each block of the cells it asks for.

    Views and vectors of a cell meet in blocks of at most BLOCK each, as products of matrices.
    """
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(rows, "cb").join(blocks(asked, "vb"), "cell")
    part = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(sizes, "cell").select("cell", part("cb", "patch_id").alias("ci"), every("vb").alias("vi"), "patch_id", "emb")
    right = asked.join(sizes, "cell").select("cell", every("cb").alias("ci"), part("vb", "query_id", "view_idx").alias("vi"), "query_id", "view_idx", "emb")
    keys = ("cell", "ci", "vi")

    def meet(p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(v):
            return pd.DataFrame({"query_id": [], "view_idx": [], "patch_id": [], "score": []})
        return _named(_block(np.stack(v["emb"]), v["query_id"].to_numpy(), np.stack(p["emb"]), p["patch_id"].to_numpy(), k, skip_own), v)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, view_idx int, patch_id long, score double")


def _trim(found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, views: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """What is as good as the k-th best of its view, and that score (the least number where there are fewer); :func:`_cut` without order, but for many ties."""
    view, ids, score = found
    order = np.argsort(-score)
    order = order[np.argsort(view[order].astype(np.uint16 if views <= 1 << 16 else np.int64), kind="stable")]  # few bits are sorted by counting
    n = np.bincount(view, minlength=views)
    full, least = n >= k, np.full(views, np.finfo(float).min)
    least[full] = score[order[(np.cumsum(n) - n)[full] + k - 1]]
    keep = score >= least[view]
    kept = view[keep], ids[keep], score[keep]
    return (_cut(*kept, k) if len(kept[0]) > 2 * k * views else kept), least


def _in_shard(q: np.ndarray, own: np.ndarray, asked: list[np.ndarray], x: np.ndarray, ids: np.ndarray, cell: np.ndarray, k: int, skip_own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (view, id, score) of each view among the vectors of the cells it asks for; an id in several cells counts once.

    A cell meets its views as a product of matrices; of its scores those stay that may be among the best, SCORES at a time.
    """
    order = np.argsort(cell, kind="stable")
    x, ids, (cells, lo) = x[order], ids[order], np.unique(cell[order], return_index=True)
    hi = np.append(lo[1:], len(ids))
    wanted, view = np.concatenate(asked), np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    order = np.argsort(wanted, kind="stable")
    wanted, view = wanted[order], view[order]
    most = k * np.unique(ids, return_counts=True)[1].max()
    best, fresh, size = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), [], 0
    least = np.full(len(q), np.finfo(float).min)
    for c, a, b in zip(cells, lo, hi):
        some = view[np.searchsorted(wanted, c) : np.searchsorted(wanted, c, "right")]
        many = max(1, SCORES // (b - a))
        for at in range(0, len(some), many):
            v = some[at : at + many]
            s = q[v] @ x[a:b].T
            if skip_own:
                s[own[v, None] == ids[a:b]] = -np.inf
            row, col = np.nonzero(s >= least[v, None])
            fresh.append((v[row], ids[a + col], s[row, col]))
            size += len(row)
            if size > HELD:
                best, least = _trim(tuple(map(np.concatenate, zip(best, *fresh))), most, len(q))
                fresh, size = [], 0
    view, ids, score = _trim(tuple(map(np.concatenate, zip(best, *fresh))), most, len(q))[0]
    order = np.lexsort((-score, ids, view))
    view, ids, score = view[order], ids[order], score[order]
    once = np.ones(len(view), bool)
    once[1:] = (view[1:] != view[:-1]) | (ids[1:] != ids[:-1])
    return _cut(view[once], ids[once], score[once], k)


def shard_topk(asked: DataFrame, rows: DataFrame, k: int, skip_own: bool = True, blocks: tuple[int, int] = (PATCHES, VIEWS), decode: Callable[[np.ndarray, pd.Series], np.ndarray] | None = None) -> DataFrame:
    """``query_id, view_idx, patch_id, score``: the k best of each view in each block of a shard, among the cells that it asks for there; by query.

    ``asked`` has query_id, view_idx, emb, shard, cells; ``rows`` has shard, cell, patch_id and emb, or a code that
    ``decode`` (cells, codes) makes vectors of.  Vectors and views of a shard meet in ``blocks`` of at most so many each (in
    expectation), so that what is moved grows with views and shards, not with the cells that views ask for.
    """
    name = "code" if decode else "emb"
    counts = lambda df, n: df.groupBy("shard").agg(F.count("*").alias(n))
    met = counts(rows, "c").join(counts(asked, "v"), "shard").collect()  # one row a shard
    dealt = [(r.shard, -(-r.c // blocks[0]), -(-r.v // blocks[1])) for r in met]
    sizes = F.broadcast(asked.sparkSession.createDataFrame(dealt, "shard int, cb int, vb int"))
    tasks = max(1, min(2 * sum(cb * vb for _, cb, vb in dealt), 4096))
    answers = max(1, sum(cb * r.v * k for r, (_, cb, _) in zip(met, dealt)) // ANSWERS)
    part = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(sizes, "shard").select("shard", part("cb", "patch_id").alias("ci"), every("vb").alias("vi"), "cell", "patch_id", name)
    right = asked.join(sizes, "shard").select("shard", every("cb").alias("ci"), part("vb", "query_id", "view_idx").alias("vi"), "query_id", "view_idx", "emb", "cells")
    keys = ("shard", "ci", "vi")

    def meet(p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(v):
            return pd.DataFrame({"query_id": [], "view_idx": [], "patch_id": [], "score": []})
        cell = p["cell"].to_numpy()
        x = decode(cell, p["code"]) if decode else np.stack(p["emb"])
        return _named(_in_shard(np.stack(v["emb"]), v["query_id"].to_numpy(), list(v["cells"]), x, p["patch_id"].to_numpy(), cell, k, skip_own), v)

    near = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(meet, "query_id long, view_idx int, patch_id long, score double")
    return near.repartition(answers, "query_id")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of what lists have found; a patch that several lists hold counts once."""
    once = found.groupBy("query_id", "view_idx", "patch_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "view_idx").orderBy(F.desc("score"), "patch_id")
    return once.withColumn("view_rank", F.row_number().over(order)).filter(F.col("view_rank") <= k)

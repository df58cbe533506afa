"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is read as a sparse row: dimension (the term) -> integer weight.  Rows are dealt into
blocks; a block keeps its postings by term, a list that names many of the block's rows as a whole
column.  Each block of query rows meets each block of postings once: term by term, the queries that
hold the term scatter their weight times the postings' weights into dense score arrays.  A partition
selection keeps the best few of each query and block, and these are merged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelrank.llm.common import materialise

K = 5
#: Components of a block of rows at most (32 MB as float) and of queries; blocks wanted; rows and queries of a block at least.
CELLS, ASKED_CELLS, WANTED, LEAST, LEAST_ASKED = 8_000_000, 2_000_000, 64, 1024, 256
#: Scores of one dense array; a posting list longer than this share of the block is a column.
SCORES, FULL = 1 << 17, 0.25
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 * value) of finite numbers, as int64 where that holds them, else as Python integers."""
    x = values.astype(float)
    if not len(x) or np.abs(x).max() < 2.0**54:
        return np.floor(256 * x).astype(np.int64)
    return np.array([int(c) * 256 if abs(c) >= 2.0**52 else math.floor(256 * c) for c in x.tolist()], object)


def sparse(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero weights of a list column, in the order of rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    weight = scaled(pc.list_flatten(column).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    some = np.flatnonzero(weight != 0)
    return row[some], term[some], weight[some]


def by_term(row: np.ndarray, term: np.ndarray, weight: np.ndarray):
    """Yields (term, rows, weights) of each term."""
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    at = np.r_[0, np.flatnonzero(np.diff(term)) + 1, len(term)] if len(term) else [0]
    for lo, hi in zip(at, at[1:]):
        yield int(term[lo]), row[lo:hi], weight[lo:hi]


def _reach(weight: np.ndarray) -> int:
    return max(map(abs, (int(weight.max()), int(weight.min())))) if len(weight) else 0


def accumulate(asked: tuple, rows: tuple, n_asked: int, n_rows: int):
    """Yields (first query, dense scores of the next queries with all rows, their bound), term at a time."""
    bound = _reach(asked[2]) * _reach(rows[2]) * (int(min(asked[1].max(initial=0), rows[1].max(initial=0))) + 1)
    kind = np.int32 if bound < 2**31 - 1 else np.int64 if bound < HIGHEST else object
    lists = {}
    for term, at, weight in by_term(*rows):
        weight = weight.astype(kind)
        if len(at) > FULL * n_rows:
            at, column = None, np.zeros(n_rows, kind)
            column[rows[0][rows[1] == term]] = weight
            weight = column
        lists[term] = at, weight
    step = max(1, SCORES // max(n_rows, 1))
    cut = np.searchsorted(asked[0], np.arange(0, n_asked + step, step))
    room = np.empty((min(step, n_asked), n_rows), kind)
    for k, first in enumerate(range(0, n_asked, step)):
        own = slice(cut[k], cut[k + 1])
        m = min(step, n_asked - first)
        scores = np.zeros((m, n_rows), kind)
        for term, who, weight in by_term(asked[0][own] - first, asked[1][own], asked[2][own]):
            if term not in lists:
                continue
            at, posted = lists[term]
            weight = weight.astype(kind)[:, None]
            if at is not None:
                scores[np.ix_(who, at)] += weight * posted
            elif 2 * len(who) < m:
                scores[who] += weight * posted
            else:  # nearly all of these queries hold the term
                every = np.zeros((m, 1), kind)
                every[who] = weight
                scores += np.multiply(every, posted, out=room[:m])
        yield first, scores, bound


def select(scores: np.ndarray, ids: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the k largest above ``least`` in each row of scores; ties to the smaller position.  ``ids`` rise."""
    n, rows, places = len(ids), [], []
    m = min(k, n)
    edge = (np.sort(scores, axis=1) if scores.dtype == object else np.partition(scores, n - m, axis=1))[:, n - m]
    for r in range(len(scores)):
        s = scores[r]
        above, equal = np.flatnonzero(s > edge[r]), ()
        if edge[r] > least:
            equal = np.flatnonzero(s == edge[r])[: m - len(above)]
        rows.append(np.full(len(above) + len(equal), r))
        places.append(np.r_[above, equal].astype(np.int64))
    return np.concatenate(rows), np.concatenate(places)


def best_of_block(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """``query_id, vec_id, score``: the k best different ids of the block ``left`` for each query of ``right``."""
    found = ([], [], [])
    if left.num_rows and right.num_rows:
        ids, asks = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        row, term, weight = sparse(left["v"])
        ids, first = np.unique(ids[order], return_index=True)
        for lo, scores, bound in accumulate(sparse(right["v"]), (place[row], term, weight), len(asks), len(place)):
            if len(ids) < len(place):  # rows that repeat an id count once, with their best score
                scores = np.maximum.reduceat(scores, first, axis=1)
            own = asks[lo : lo + len(scores)]
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            same = np.flatnonzero(ids[at] == own)
            scores[same, at[same]] = -bound - 1
            who, where = select(scores, ids, k, -bound - 1)
            found[0].append(own[who])
            found[1].append(ids[where])
            found[2].append(np.clip(scores[who, where], LOWEST, HIGHEST).astype(np.int64))
    return pa.table([np.concatenate(c) if c else np.empty(0, np.int64) for c in found], names=["query_id", "vec_id", "score"])


def _clean(vectors: DataFrame) -> DataFrame:
    v, kind = F.col("v"), vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return slim.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def search(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest integer inner product for each row where ``is_query``.

    A component c counts as floor(256 * c).  A query's own id is no candidate; ties go to the smaller
    id; fewer than k candidates give fewer rows.  Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id; a shorter vector, the empty one included, has
    zeros at its end.  Rows that repeat an id count once, with their best score, as query and as
    candidate.  A score beyond 64 bits is given as the nearest 64-bit number.  Rows that repeat, also
    one that is a third of the table, are dealt evenly: blocks go by the rows' numbers.  An empty
    table gives no rows; other columns are ignored.
    """
    out = "query_id long, vec_id long, score long"
    rows = materialise(_clean(vectors).withColumns({"n": F.monotonically_increasing_id(), "asks": F.coalesce(is_query(F.col("vec_id")), F.lit(False))}))
    size = rows.agg(F.count("*").alias("rows"), F.count_if("asks").alias("asked"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("longest")).first()
    longest = max(size.longest, 1)
    blocks = max(1, -(-size.rows // min(max(LEAST, size.rows // WANTED), max(1, CELLS // longest))))
    asked = max(1, -(-size.asked // min(max(LEAST_ASKED, size.asked // 4), max(1, ASKED_CELLS // longest))))
    deal = lambda by: F.pmod(F.xxhash64("n"), F.lit(by)).cast("int")
    every = lambda by: F.explode(F.sequence(F.lit(0), F.lit(by - 1)))
    left = rows.select(deal(blocks).alias("block"), every(asked).alias("ask"), "vec_id", "v")
    right = rows.filter("asks").select(every(blocks).alias("block"), deal(asked).alias("ask"), F.col("vec_id").alias("vec_id"), F.col("v").alias("v"))
    right = right.toDF(*right.columns)
    found = left.groupBy("block", "ask").cogroup(right.groupBy("block", "ask")).applyInArrow(lambda x, q: best_of_block(x, q, k), out)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

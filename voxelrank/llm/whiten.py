"""Embedding whitening by a tiled covariance.

The dimensions are cut into column blocks and the rows into row blocks.  A pair of column blocks is a
tile; each packed column block is sent to the tiles it belongs to, keyed by row block and tile, the
two blocks of a pair are multiplied where they meet, and the products are summed tile by tile.  Only
the assembled matrix, whose size is that of the dimensions, reaches the driver, which decomposes it.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelrank.llm.common import materialise

#: Components that are returned; columns of a tile; rows of a block.
COMPONENTS, TILE, ROWS = 4, 32, 8192
_INT64 = (1 << 63) - 1


def matrix(column) -> np.ndarray:
    """Rows of a list column whose lists are of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S without rounding: int64 where that holds it, else Python integers."""
    big = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * big + max(map(abs, total), default=0) <= _INT64:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def deviations(d: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exact; None where one is beyond 64 bits."""
    big = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0)))) if d.size else 0
    if big * big * max(d.shape[1], 1) <= _INT64:
        return (d.astype(np.int64) ** 2).sum(1).tolist()
    return [s if s <= _INT64 else None for s in (d.astype(object) ** 2).sum(1).tolist()]


def sums(rows: DataFrame, dim: int) -> list[int]:
    """Exact sums of the dimensions of integer arrays: partial sums in each partition, then one small aggregation."""

    def partial(batches):
        total = [0] * dim
        for b in batches:
            x = matrix(b.column("x")) if b.num_rows else np.zeros((0, dim), np.int64)
            big = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
            part = (x if big * max(len(x), 1) <= _INT64 else x.astype(object)).sum(0)
            total = [a + int(p) for a, p in zip(total, part.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["dim", "s"])

    return [int(r.s) for r in rows.mapInArrow(partial, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("dim").collect()]


def covariance(rows: DataFrame, n: int, dim: int, centre: Callable[[np.ndarray], np.ndarray], tile: int = TILE, block: int = ROWS) -> np.ndarray:
    """Covariance with divisor n of the arrays ``x`` of ``rows``, which ``centre`` turns into centred doubles.

    A task holds one row block, and where blocks meet, two column blocks of it.
    """
    parts = -(-dim // tile)

    def pack(batches):
        """A record for each row block and column block: its cells, row by row."""
        number, held, count = TaskContext.get().partitionId() << 33, [], 0

        def cut():
            nonlocal number, held, count
            x = np.concatenate(held)
            held, count = [], 0
            width = [x[:, c * tile : (c + 1) * tile] for c in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * parts, pa.int64()), pa.array(range(parts), pa.int32()), pa.array([len(x)] * parts, pa.int32()), pa.array([w.ravel() for w in width], pa.list_(pa.float64()))], names=["rb", "cb", "m", "cells"])
            number += 1

        for b in batches:
            for lo in range(0, b.num_rows, block):
                held.append(centre(matrix(b.column("x").slice(lo, block))))
                count += len(held[-1])
                if count >= block:
                    yield from cut()
        if held:
            yield from cut()

    def multiply(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        a, b = key[1].as_py(), key[2].as_py()
        cells = {cb: c.values.to_numpy().reshape(m, -1) for cb, m, c in zip(group["cb"].to_pylist(), group["m"].to_pylist(), group["cells"])}
        return pa.table([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([(cells[a].T @ cells[b]).ravel()], pa.list_(pa.float64()))], names=["a", "b", "cells"])

    packed = rows.select("x").mapInArrow(pack, "rb long, cb int, m int, cells array<double>")
    first = F.transform(F.sequence("cb", F.lit(parts - 1)), lambda b: F.struct(F.col("cb").alias("a"), b.alias("b")))
    second = F.when(F.col("cb") > 0, F.transform(F.sequence(F.lit(0), F.col("cb") - 1), lambda a: F.struct(a.alias("a"), F.col("cb").alias("b")))).otherwise(F.slice(first, 1, 0))
    keyed = packed.withColumn("tile", F.explode(F.concat(first, second))).select("rb", "tile.a", "tile.b", "cb", "m", "cells")
    products = keyed.groupBy("rb", "a", "b").applyInArrow(multiply, "a int, b int, cells array<double>")
    entries = products.select("a", "b", F.posexplode("cells").alias("at", "v")).groupBy("a", "b", "at").agg(F.sum("v").alias("v"))
    found = np.zeros((dim, dim))
    for r in entries.toLocalIterator():
        i, j = divmod(r.at, min(tile, dim - r.b * tile))
        i, j = r.a * tile + i, r.b * tile + j
        found[i, j] = found[j, i] = r.v / n
    return found


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the first components by falling eigenvalue; 0 for what is rounding."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    floor = len(v) * np.finfo(float).eps * max(float(np.trace(v)), 0.0)
    return np.where(e > floor, e, 0.0), u


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component.

    Rows whose vector is null or holds null or non-finite entries are dropped; x = floor(256 * entry).
    The fit list holds each distinct x once, so copies, however many, weigh once.  Rows that repeat
    are returned each, and a null id stays null.  A shorter vector has zeros at its end.  There are no
    more components than dimensions.  Where a component has no variance (one distinct vector, or
    dimensions that depend on each other) whitened is null, and it does not enter identity_error,
    which is null if no component has variance; explained is 0, or null if the trace is 0.  A
    deviation beyond 64 bits is null.  An empty table gives no rows; other columns are ignored.
    """
    v, out = F.col("v"), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(v.isNotNull() & fine)
    dim = kept.agg(F.max(F.size("v"))).first()[0] or 0
    if not dim:
        return spark.createDataFrame([], out)
    x = F.transform(v, lambda c: F.floor(c * 256))
    kept = kept.select("vec_id", F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(x))).alias("x"))
    fit = materialise(kept.select("x").distinct())
    n = fit.count()
    total = sums(fit, dim)
    cov = covariance(fit, n, dim, lambda x: centred(x, n, total).astype(float) / n)
    e, u = components(cov, most)
    trace, r = float(np.trace(cov)), len(e)
    live = np.flatnonzero(e > 0)
    turn = u[:, live] / np.sqrt(e[live])
    error = None
    if len(live):

        def project(batches):
            for b in batches:
                w = centred(matrix(b.column("x")), n, total).astype(float) / n @ turn
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, w.size + 1, len(live), dtype=np.int32), w.ravel())], names=["x"])

        white = fit.mapInArrow(project, "x array<double>")
        mean = np.array(white.agg(*(F.avg(F.element_at("x", i + 1)) for i in range(len(live)))).first())
        error = float(np.abs(covariance(white, n, len(live), lambda x: x - mean) - np.eye(len(live))).max())
    explained = [float(x) / trace if trace > 0 else None for x in e]

    def score(batches):
        for b in batches:
            d = centred(matrix(b.column("x")), n, total)
            w = np.full((b.num_rows, r), np.nan)
            w[:, live] = d.astype(float) / n @ turn
            own = np.repeat(np.arange(b.num_rows), r)
            cols = (
                b.column("vec_id").take(pa.array(own)), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(len(own), n)), pa.array(deviations(d), pa.int64()).take(pa.array(own)),
                pa.array(w.ravel(), from_pandas=True), pa.array(explained * b.num_rows, pa.float64()), pa.array([error] * len(own), pa.float64()),
            )
            yield pa.RecordBatch.from_arrays(list(cols), names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(score, out)

"""Running averages of an evaluation, kept while its first hits arrive."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelrank.functions.numbers import finite

#: Of a row and source: what its first hit scored, how far it is, and what the search took.
FIRST = "row_idx long, source string, score double, dist double, corner double, latency_s double, row_latency_s double"
#: What totals are kept of; averages are quotients of two of them.
TOTALS = ("rows", "row_latency", "queries", "latency", "top1", "rows_dist", "dist", "rows_corner", "corner")


def _averages(t: DataFrame) -> DataFrame:
    part = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return t.select(
        F.col("rows").cast("long").alias("n_rows"), F.col("queries").cast("long").alias("n_queries"), part("top1", "rows").alias("avg_top1"), (1000 * part("row_latency", "rows")).alias("avg_row_latency_ms"),
        (1000 * part("latency", "queries")).alias("avg_query_latency_ms"), part("dist", "rows_dist").alias("avg_dist1"), part("corner", "rows_corner").alias("avg_corner1"),
    )


def averages(first: DataFrame) -> DataFrame:
    """The averages of all rows at once: by row over its sources, then over rows; missing and non-finite distances do not count.

    A row without a score counts with 0, one without a finite distance is left out of that average.
    """
    by_row = first.groupBy("row_idx").agg(
        F.max("row_latency_s").alias("r"), F.count("latency_s").alias("q"), F.sum("latency_s").alias("l"), F.avg("score").alias("s"), F.avg(finite(F.col("dist"))).alias("d"), F.avg(finite(F.col("corner"))).alias("c"),
    )
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0.0)).alias(name)
    return _averages(by_row.agg(F.count("*").alias("rows"), total("r", "row_latency"), F.coalesce(F.sum("q"), F.lit(0)).alias("queries"), total("l", "latency"), total("s", "top1"), F.count("d").alias("rows_dist"), total("d", "dist"), F.count("c").alias("rows_corner"), total("c", "corner")))


def _of_row(state: tuple) -> list[float]:
    """The TOTALS of one row, from (sources, latest row latency, count and sum of latencies, scores, distances, corners)."""
    _, row, q, lat, n, s, nd, d, nc, c = state
    mean = lambda total, count: total / count if count else 0.0
    return [1.0, row, float(q), lat, mean(s, n), float(nd > 0), mean(d, nd), float(nc > 0), mean(c, nc)]


def _changes(key, parts, state):
    """By how much the totals change with what arrived for a row; a source counts once."""
    held = state.get if state.exists else None
    sources, row, q, lat, n, s, nd, d, nc, c = held or ([], 0.0, 0, 0.0, 0, 0.0, 0, 0.0, 0, 0.0)
    sources = list(sources)
    for part in parts:
        for r in part.sort_values("source", kind="stable").itertuples():
            if r.source in sources:
                continue
            sources.append(r.source)
            row = row if pd.isna(r.row_latency_s) else max(row, r.row_latency_s)
            q, lat = (q, lat) if pd.isna(r.latency_s) else (q + 1, lat + r.latency_s)
            n, s = (n, s) if pd.isna(r.score) else (n + 1, s + r.score)
            nd, d = (nd + 1, d + r.dist) if r.dist is not None and math.isfinite(r.dist) else (nd, d)
            nc, c = (nc + 1, c + r.corner) if r.corner is not None and math.isfinite(r.corner) else (nc, c)
    new = (sources, float(row), q, float(lat), n, float(s), nd, float(d), nc, float(c))
    state.update(new)
    before = _of_row(held) if held else [0.0] * len(TOTALS)
    yield pd.DataFrame([[a - b for a, b in zip(_of_row(new), before)]], columns=TOTALS)


def average_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the averages of a stream of FIRST rows, of all that has arrived; read them with :func:`read_averages`.

    The state store holds one small state for each row of the evaluation.  A batch writes by how much
    it changes the totals, under its own number, so a repeated batch after a restart counts once.
    """
    kept = "sources array<string>, row double, q long, lat double, n long, s double, nd long, d double, nc long, c double"
    changes = stream.groupBy("row_idx").applyInPandasWithState(_changes, ", ".join(f"{c} double" for c in TOTALS), kept, "update", "NoTimeout")

    def write(batch: DataFrame, number: int) -> None:
        total = batch.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in TOTALS)).withColumn("batch", F.lit(number))
        total.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_averages(changes: DataFrame) -> DataFrame:
    """``n_rows, n_queries`` and the five averages, from what the batches have written."""
    return _averages(changes.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in TOTALS)))

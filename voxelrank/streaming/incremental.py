"""Incremental evaluation: signatures, completeness, pending work, idempotent appends."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: What tells one hit from another.
HIT_KEY = ("eval_sig", "row_idx", "source", "rank")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def signature(config: dict) -> str:
    """First 12 hex digits of the SHA-1 of the compact, sorted JSON of a configuration."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def group_counts(hits: DataFrame, sig: str) -> DataFrame:
    return hits.filter(F.col("eval_sig") == sig).groupBy("row_idx", "source").agg(F.count("*").alias("n"))


def purge_partial(hits: DataFrame, sig: str, final_k: int) -> DataFrame:
    """``hits`` without the groups of ``sig`` that have fewer than ``final_k`` rows."""
    partial = group_counts(hits, sig).filter(F.col("n") < final_k).select("row_idx", "source", F.lit(sig).alias("eval_sig"))
    return hits.join(partial, ["row_idx", "source", "eval_sig"], "left_anti")


def completed(hits: DataFrame, sig: str, final_k: int, expected: Sequence[str]) -> DataFrame:
    """``row_idx`` of rows whose expected sources are all complete."""
    full = group_counts(hits, sig).filter(F.col("n") >= final_k).groupBy("row_idx").agg(F.collect_set("source").alias("s"))
    return full.filter(F.size(F.array_except(F.array(*map(F.lit, expected)), "s")) == 0).select("row_idx")


def pending(rows: DataFrame, hits: DataFrame, sig: str, final_k: int, expected: Sequence[str]) -> DataFrame:
    """Rows that are still to be evaluated."""
    return rows.join(completed(hits, sig, final_k, expected), "row_idx", "left_anti")


def markers_of(hits: DataFrame, asked: DataFrame, sig: str, run: str) -> DataFrame:
    """``eval_sig, row_idx, source, run, n_hits``: that a row and source of ``asked`` is done, with however few hits, none included."""
    n = hits.filter(F.col("eval_sig") == sig).groupBy("row_idx", "source").agg(F.count("*").alias("n"))
    return asked.select("row_idx", "source").distinct().join(n, ["row_idx", "source"], "left").select(F.lit(sig).alias("eval_sig"), "row_idx", "source", F.lit(run).alias("run"), F.coalesce("n", F.lit(0)).alias("n_hits"))


def append_marked(hits: DataFrame, asked: DataFrame, path: str, sig: str, run: str | None = None) -> str:
    """Hits of ``asked`` rows and sources appended as a run of their own, and then, in ``path.done``, that they are done.

    A run that broke between the two has no markers: its hits are not seen (:func:`visible`), and its
    rows are pending still.  Nothing that was written before is read, moved or changed.
    """
    run = run or uuid.uuid4().hex
    hits.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)
    spark = hits.sparkSession
    fresh = spark.read.option("basePath", path).parquet(f"{path}/run={run}") if exists(spark, f"{path}/run={run}") else hits.limit(0)
    markers_of(fresh, asked, sig, run).coalesce(1).write.mode("append").parquet(f"{path}.done")
    return run


def read_markers(spark: SparkSession, path: str) -> DataFrame | None:
    """The markers beside the hits at ``path``; None where there are none."""
    return spark.read.parquet(f"{path}.done") if exists(spark, f"{path}.done") else None


def visible(hits: DataFrame, markers: DataFrame) -> DataFrame:
    """``hits`` of the runs that were committed; of runs that did a row twice, the first by name counts."""
    first = markers.groupBy("eval_sig", "row_idx", "source").agg(F.min("run").alias("run"))
    return hits.join(first, ["eval_sig", "row_idx", "source", "run"], "left_semi")


def completed_marked(markers: DataFrame, sig: str, expected: Sequence[str]) -> DataFrame:
    """``row_idx`` of rows whose expected sources all have a marker."""
    done = markers.filter((F.col("eval_sig") == sig) & F.col("source").isin(*expected)).groupBy("row_idx").agg(F.count_distinct("source").alias("n"))
    return done.filter(F.col("n") == len(set(expected))).select("row_idx")


def pending_marked(rows: DataFrame, markers: DataFrame | None, sig: str, expected: Sequence[str]) -> DataFrame:
    """Rows without a marker for some expected source."""
    return rows if markers is None else rows.join(completed_marked(markers, sig, expected), "row_idx", "left_anti")


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of hits to Parquet, each (eval_sig, row_idx, source, rank) once, with all that has arrived.

    The ranks that a row and source have are kept in the state store, so what was written before is
    never read again; of hits of one key in a batch the one with the least patch_id stays.  A repeated
    batch overwrites its own partition, so restarts leave no copies.
    """
    columns = stream.columns

    def new_ranks(key, parts, state):
        known = set(state.get[0]) if state.exists else set()
        came = pd.concat(list(parts)).sort_values(["rank", "patch_id"]).drop_duplicates("rank")
        kept = came[~came["rank"].isin(known)]
        state.update((sorted(known | set(kept["rank"].tolist())),))
        yield kept[columns]

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    once = stream.groupBy(*HIT_KEY[:3]).applyInPandasWithState(new_ranks, stream.schema, "ranks array<long>", "append", "NoTimeout")
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Training of the re-ranker from tables: query vectors, lists with targets, fitting, losses of a split."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from voxelrank.functions.numbers import distance_target
from voxelrank.operators import evaluate, pools, rerank, targets
from voxelrank.session import scratch, written
from voxelrank.sources.files import VolumeFile
from voxelrank.streaming import incremental

#: Temperature of the training targets: divisor and bounds.
TAU = (4.0, 1.0, 256.0)
#: Lists of a mini-batch, about.
BATCH = 512
HISTORY = "epoch long, lr double, " + ", ".join(f"{s}_{p}loss double" for s in ("train", "val", "test") for p in ("rank_", "dist_", ""))


def query_vectors(rows: DataFrame, volumes: dict[str, np.ndarray], encoder: Callable[[np.ndarray], np.ndarray], cfg: evaluate.EvalConfig) -> DataFrame:
    """``row_idx, source, emb``: each query plane as it is, neither turned nor cut to windows."""
    plain = replace(cfg, angles=(0.0,), flip_x=False, flip_y=False, local="off")
    posed = evaluate.posed_rows(rows, sorted(volumes), plain)
    views = evaluate.query_views(posed, volumes, encoder, plain)
    return posed.select("query_id", "row_idx", "source").join(views.select("query_id", "emb"), "query_id").drop("query_id")


def kept_query_vectors(path: str, rows: DataFrame, volumes: dict, encoder: Callable[[np.ndarray], np.ndarray], cfg: evaluate.EvalConfig, encoder_name: str) -> DataFrame:
    """:func:`query_vectors`, kept below ``path`` and read again while nothing has changed.

    A table is named by a signature of the dataset rows (any order), the volumes, the encoder's name and the configuration;
    it counts only if it was written to its end and has a vector of one length for each row and source.
    """
    spark = rows.sparkSession
    seen = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(38,0)")).alias("h")).first()
    marks = {n: repr(v) if isinstance(v, VolumeFile) else [list(v.shape), zlib.crc32(np.ascontiguousarray(v).tobytes())] for n, v in volumes.items()}
    sig = incremental.signature({"rows": [seen.n, str(seen.h)], "volumes": marks, "encoder": encoder_name, "config": cfg.signature()})
    place = f"{path}/{sig}"
    if incremental.exists(spark, f"{place}/_SUCCESS"):
        kept = spark.read.parquet(place)
        about = kept.agg(F.count("*").alias("n"), F.count_distinct(F.size("emb")).alias("sizes"), F.count_distinct("row_idx", "source").alias("keys")).first()
        if about.n == about.keys == seen.n * len(volumes) and about.sizes <= 1:
            return kept
    query_vectors(rows, volumes, encoder, cfg).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def training_lists(members: DataFrame, queries: DataFrame, vectors: DataFrame, mode: str = "log1p", clip: float = 256.0) -> DataFrame:
    """``row_idx, source, q, members`` with members (rank, patch_id, c, prob, target) by rank.

    ``members`` are pool rows (row_idx, source, patch_id, rank, dist), sampled or whole: a list is
    bounded by its pool.  Targets are taken over the rows that are there.  A list whose row and source have no
    query vector (a row number beyond the dataset, or hits of another one) is an error.
    """
    aimed = targets.soft_targets(members, ["row_idx", "source"], *TAU).withColumn("target", distance_target(F.col("dist"), mode, clip))
    full = aimed.join(vectors.select("patch_id", F.col("emb").cast("array<float>").alias("c")), "patch_id")
    lists = full.groupBy("row_idx", "source").agg(F.array_sort(F.collect_list(F.struct("rank", "patch_id", "c", "prob", "target"))).alias("members"))
    met = lists.join(queries.select("row_idx", "source", F.col("emb").cast("array<float>").alias("q")), ["row_idx", "source"], "left")
    lost = F.raise_error(F.concat_ws(" ", F.lit("no dataset row or vector for row_idx"), F.col("row_idx").cast("string"), F.lit("of source"), F.col("source"))).cast("array<float>")
    return met.withColumn("q", F.when(F.col("q").isNull(), lost).otherwise(F.col("q"))).select("row_idx", "source", "q", "members")


def _example(q, members) -> tuple[np.ndarray, ...]:
    return np.asarray(q, float), np.array([m["c"] for m in members], float), np.array([m["prob"] for m in members], float), np.array([m["target"] for m in members], float)


def _sums(lists: DataFrame, weights: dict[str, np.ndarray], cfg: rerank.RerankerConfig, epoch: int = 0, grad: bool = False) -> tuple[int, tuple[float, float], dict[str, np.ndarray]]:
    """(lists, sums of both losses, sum of gradients): every partition sums its own lists, and sums meet part by part."""
    shared = lists.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        n, losses, total = 0, np.zeros(2), None
        for b in batches:
            for i, s, q, m in zip(b["row_idx"], b["source"], b["q"], b["members"]):
                rng = np.random.default_rng((cfg.seed, epoch, int(i) & 0xFFFFFFFF, zlib.crc32(s.encode())))
                *value, g = rerank.list_parts(shared.value, _example(q, m), cfg, (cfg.dropout, rng) if grad else None, grad)
                n, losses = n + 1, losses + value
                total = g if total is None else {k: total[k] + g[k] for k in g} if grad else None
        parts = {"": np.r_[n, losses], **(total or {})}
        yield pd.DataFrame({"part": list(parts), "v": [np.ravel(x) for x in parts.values()]})

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": group["part"].iloc[:1], "v": [np.sum(np.stack(group["v"]), 0)]})

    rows = lists.select("row_idx", "source", "q", "members").mapInPandas(run, "part string, v array<double>").groupBy("part").applyInPandas(meet, "part string, v array<double>").collect()
    shared.unpersist()
    found = {r.part: np.array(r.v) for r in rows}
    n, *losses = found.pop("", np.zeros(3))
    return int(n), tuple(losses), {k: v.reshape(weights[k].shape) for k, v in found.items()}


def fit(draw: Callable[[int], DataFrame], splits: DataFrame, cfg: rerank.RerankerConfig, batch: int = BATCH) -> tuple[dict[str, np.ndarray], list[dict]]:
    """Weights of the best epoch and the history, with the losses of ``test`` in its last row.

    ``draw(epoch)`` gives an epoch's training lists, so that each can sample anew; those of epoch 0 serve
    ``val`` and ``test``.  Lists never reach the driver: a step is a job whose tasks sum the gradients of a mini-batch
    of about ``batch`` lists, each of which is a folder of the epoch's table.
    """
    spark, mean = splits.sparkSession, lambda n, losses: tuple(float(x) / max(n, 1) for x in losses)
    held = written(draw(0).join(splits.filter("split <> 'train'"), "row_idx"))
    val, test = held.filter("split = 'val'"), held.filter("split = 'test'")
    run = rerank.Descent(cfg)
    for epoch in range(cfg.epochs):
        drawn = draw(epoch).join(splits.filter("split = 'train'"), "row_idx")
        many = max(1, -(-drawn.count() // batch))
        path = scratch(spark)
        drawn.withColumn("batch", F.pmod(F.xxhash64(F.lit(cfg.seed), F.lit(epoch), "row_idx", "source"), F.lit(many)).cast("int")).write.partitionBy("batch").parquet(path)
        table, seen, losses = spark.read.schema(StructType([*drawn.schema.fields, StructField("batch", IntegerType())])).parquet(path), 0, np.zeros(2)
        for k in np.random.default_rng((cfg.seed, epoch)).permutation(many).tolist():
            n, part, g = _sums(table.filter(F.col("batch") == k), run.w, cfg, epoch, True)
            if n:
                run.step({name: x / n for name, x in g.items()})
                seen, losses = seen + n, losses + part
        if not seen:
            raise ValueError("no training lists")
        n, part, _ = _sums(val, run.w, cfg)
        means = {"train": mean(seen, losses), "val": mean(n, part) if n else mean(seen, losses)}
        if not run.close_epoch(epoch, means):
            break
    n, part, _ = _sums(test, run.best_w, cfg)
    rank, far = mean(n, part)
    tested = {"test_rank_loss": rank, "test_dist_loss": far, "test_loss": rank + cfg.distance_weight * far} if n else {}
    blank = dict.fromkeys(("test_rank_loss", "test_dist_loss", "test_loss"))
    last = {**dict.fromkeys(run.history[0]), "epoch": run.best_epoch, **blank, **tested}
    return run.best_w, [{**row, **blank} for row in run.history] + [last]


def list_losses(lists: DataFrame, weights: dict[str, np.ndarray], cfg: rerank.RerankerConfig) -> DataFrame:
    """``row_idx, source, n, loss`` of every list."""
    shared = lists.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in batches:
            rows = [(i, s, len(m), float(rerank.list_loss(shared.value, _example(q, m), cfg))) for i, s, q, m in zip(b["row_idx"], b["source"], b["q"], b["members"])]
            yield pd.DataFrame(rows, columns=["row_idx", "source", "n", "loss"])

    return lists.select("row_idx", "source", "q", "members").mapInPandas(run, "row_idx long, source string, n int, loss double")


def prepare(hits: DataFrame, vectors: DataFrame, cfg: rerank.RerankerConfig, least: int = 8, epoch: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sampled pool rows, row splits) of evaluation hits with ``dist``; each ``epoch`` draws its own sample, the splits stay."""
    pool = pools.build_pools(hits, vectors, cfg.train_topk, least)
    if cfg.sampling == "uniform":
        drawn = pools.uniform_sample(pool, cfg.list_k, seed=cfg.seed + epoch)
    else:
        drawn = pools.stratified_sample(pool, cfg.list_k, wants=cfg.wants, seed=cfg.seed + epoch)
    return drawn, pools.split_rows(pool.select("row_idx"), seed=cfg.seed)


def save_model(spark, weights: dict[str, np.ndarray], path: str) -> None:
    """One row with the weights as .npz, on any file system that Spark writes."""
    spark.createDataFrame([(bytearray(rerank.save_weights(weights)),)], "content binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> dict[str, np.ndarray]:
    return rerank.load_weights(bytes(spark.read.parquet(path).first()[0]))

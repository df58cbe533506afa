"""A kept vector index: built once, searched without a refit, appended to, opened by its newest version.

``path/vectors`` holds the vectors, split by batch and by shard (a run of neighbouring cells), and
``path/cells``, ``path/books`` and ``path/edges`` the model or graph of the build.  A small JSON file in
``path/versions`` names the kind, the shapes and the batches that belong to a version.  Data are written first
and the version last, so that a broken build or append leaves the version before it as it was.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelrank.operators import graph, quantise
from voxelrank.operators.cells import cell_count, fit_cells, matrix, nearest_by_shard, nearest_cells
from voxelrank.operators.topk import choose_index, ranked, shard_topk, vector_topk
from voxelrank.session import written

#: Folders of cells at least (if there are so many cells) and at most, vectors for each of more; cells that hold a vector; share of the cells that a search probes.
FEW_SHARDS, SHARDS, SHARD, COPIES, PROBED = 64, 4096, 20_000, 2, 3 / 16


@dataclass(frozen=True)
class Index:
    path: str
    version: int
    kind: str
    n: int
    dim: int
    cells: int
    per_shard: int
    copies: int
    batches: tuple[str, ...]

    def vectors(self, spark: SparkSession) -> DataFrame:
        """``patch_id, emb, cell, first, shard``; ``first`` marks one of a vector's copies."""
        if not self.n:  # nothing was written
            return spark.createDataFrame([], "patch_id long, emb array<double>, cell int, first boolean, shard int")
        return spark.read.parquet(f"{self.path}/vectors").filter(F.col("batch").isin(*self.batches)).drop("batch")

    def outgrown(self) -> bool:
        """Whether the planner would choose another kind by now."""
        return self.kind != choose_index(self.n)


def _versions(spark: SparkSession, path: str) -> list[int]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted(int(name) for name in names if name.isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{name}/_SUCCESS")))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def _commit(spark: SparkSession, index: Index) -> Index:
    """The version becomes visible; two writers cannot commit the same one."""
    spark.createDataFrame([(json.dumps(asdict(index)),)], "value string").coalesce(1).write.text(f"{index.path}/versions/{index.version}")
    return index


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The newest version of an index, or the one asked for."""
    known = _versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no index{'' if version is None else f' version {version}'} at {path}")
    made = json.loads(spark.read.text(f"{path}/versions/{known[-1] if version is None else version}").first()[0])
    return Index(**{**made, "path": path, "batches": tuple(made["batches"])})


def _write(index: Index, vectors: DataFrame, centres: np.ndarray | None, batch: str) -> None:
    slim = vectors.select(F.col("patch_id").cast("long").alias("patch_id"), F.col("emb").cast("array<double>").alias("emb"))
    if centres is None:
        laid = slim.withColumns({"cell": F.lit(0), "first": F.lit(True)})
    else:
        near = nearest_cells(slim, centres, min(index.copies, index.cells))
        laid = near.select("patch_id", "emb", F.posexplode("near").alias("place", "cell")).withColumn("first", F.col("place") == 0).drop("place")
    laid = laid.withColumns({"batch": F.lit(batch), "shard": F.floor(F.col("cell") / index.per_shard).cast("int")})
    if index.kind == "ivfpq":
        laid = quantise.with_codes(laid, _quantiser(vectors.sparkSession, index))
    if centres is not None:
        laid = laid.hint("rebalance", "shard").sortWithinPartitions("shard", "cell")  # few shards in a file, a large shard in several
    laid.write.mode("append").partitionBy("batch", "shard").parquet(f"{index.path}/vectors")


def _centres(spark: SparkSession, index: Index) -> np.ndarray:
    return matrix(spark.read.parquet(f"{index.path}/cells").orderBy("cell").toArrow()["centre"])


def _quantiser(spark: SparkSession, index: Index) -> quantise.Quantiser:
    books = spark.read.parquet(f"{index.path}/books").orderBy("part", "code").collect()
    parts = books[-1].part + 1
    return quantise.Quantiser(_centres(spark, index), np.array([r.word for r in books]).reshape(parts, -1, index.dim // parts))


def build_index(vectors: DataFrame, path: str, kind: str = "auto", cells: int | None = None, copies: int = COPIES, parts: int = 16, degree: int = graph.DEGREE) -> Index:
    """Index of ``patch_id, emb`` at ``path``, of the kind that the planner chooses by size: flat, graph or ivfpq, or ``ivf`` if asked for."""
    spark = vectors.sparkSession
    if exists(spark, path):
        raise FileExistsError(f"an index is at {path} already")
    first = vectors.select(F.count("*").alias("n"), F.max(F.size("emb")).alias("dim")).first()
    kind, batch = choose_index(first.n, kind), uuid.uuid4().hex
    kind = kind if first.n else "flat"  # no vectors, no cells or links
    split = kind in ("ivf", "ivfpq")
    many = (cells or cell_count(first.n)) if split else 1
    centres = fit_cells(vectors, many) if split else None
    many = len(centres) if split else 1
    index = Index(path, 1, kind, first.n, first.dim or 0, many, -(-many // min(SHARDS, max(FEW_SHARDS, first.n // SHARD))), copies if split else 1, (batch,))
    if split:
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
    if kind == "ivfpq":
        books = quantise.fit_books(vectors, centres, parts)
        spark.createDataFrame([(m, c, w.tolist()) for m, b in enumerate(books) for c, w in enumerate(b)], "part int, code int, word array<double>").coalesce(1).write.parquet(f"{path}/books")
    _write(index, vectors, centres, batch)
    if kind == "graph":
        graph.neighbour_graph(index.vectors(spark).select("patch_id", "emb"), degree).write.parquet(f"{path}/edges/{batch}")
    return _commit(spark, index)


def append_vectors(index: Index, vectors: DataFrame) -> Index:
    """The next version, with new vectors in the cells of the model; ids that are there already are left out.

    A graph is linked anew from the edges it has, so that only what is new moves far.
    """
    spark, batch = vectors.sparkSession, uuid.uuid4().hex
    known = index.vectors(spark).filter("first").select("patch_id")
    fresh = written(vectors.join(known, "patch_id", "left_anti").dropDuplicates(["patch_id"]))
    n = fresh.count()
    if not n:
        return index
    _write(index, fresh, _centres(spark, index) if index.kind in ("ivf", "ivfpq") else None, batch)
    grown = replace(index, version=index.version + 1, n=index.n + n, batches=(*index.batches, batch))
    if index.kind == "graph":
        old = spark.read.parquet(f"{index.path}/edges/{index.batches[-1]}")
        degree = old.agg(F.max(F.size("links"))).first()[0]
        graph.neighbour_graph(grown.vectors(spark).select("patch_id", "emb"), max(degree or 1, 2), start=old).write.parquet(f"{index.path}/edges/{batch}")
    return _commit(spark, grown)


def probed(index: Index, views: DataFrame, probes: int | None = None) -> DataFrame:
    """``query_id, view_idx, emb, shard, cells, first``: the cells that each view looks into, by shard."""
    many = probes or max(1, math.ceil(index.cells * PROBED))
    return nearest_by_shard(views, _centres(views.sparkSession, index), many, index.per_shard)


def pruned(index: Index, asked: DataFrame) -> DataFrame:
    """The index's vectors in the shards of the cells asked for; other folders are not read."""
    shards = [r[0] for r in asked.select("shard").distinct().collect()]  # SHARDS at most
    return index.vectors(asked.sparkSession).filter(F.col("shard").isin(shards))


def search_index(index: Index, views: DataFrame, k: int, probes: int | None = None, refine: int = 4, skip_own: bool = True) -> DataFrame:
    """``query_id, view_idx, patch_id, score, view_rank``: the k best patches found for each view, with exact scores.

    A flat index is searched whole, a graph from its entry points, the others in the ``probes`` nearest
    cells of each view (PROBED of all where not given).
    """
    spark = views.sparkSession
    if index.kind == "flat":
        return vector_topk(views, index.vectors(spark).select("patch_id", "emb"), k, skip_own)
    if index.kind == "graph":
        edges = spark.read.parquet(f"{index.path}/edges/{index.batches[-1]}")
        return graph.beam_search(views, index.vectors(spark).select("patch_id", "emb"), edges, k, skip_own=skip_own)
    asked = written(probed(index, views, probes))
    rows = pruned(index, asked)
    if index.kind == "ivfpq":
        return quantise.ivfpq_search(asked, rows, _quantiser(spark, index), k, refine, skip_own)
    return ranked(shard_topk(asked, rows, k, skip_own), k)

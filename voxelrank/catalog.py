"""Registered queries of the library's own operators, and their SQL.

The driver's ``embeddings`` stand for vectors and manifest: queries are the ids divisible by 25
(the query's own patch excluded), views are cyclic shifts, reversals and windows of the vector.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelrank.functions import geometry as G
from voxelrank.functions import numbers as N
from voxelrank.functions import vectors as V
from voxelrank.operators import builder, distance, evaluate, fusion, grids, images, metrics, pools, registration, rerank, targets, topk, training, vector_index, volume
from voxelrank.plans import generators as P
from voxelrank.session import scratch, written
from voxelrank.sources import png, tables
from voxelrank.streaming import averages, incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIM, K_VIEW, HITS_K = 64, 64, 40
THRESHOLDS = (0.5, 1.0, 1.5)


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _many(spark, sf):
    """As many directions as there are embeddings."""
    return _t(spark, sf, "embeddings").count()


def _r(c, digits=6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---------------------------------------------------------------- fixture
def _vectors(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("patch_id"), F.col("embedding").cast("array<double>").alias("emb"), "label")


def _manifest(spark, sf):
    i = F.col("vec_id")
    return _t(spark, sf, "embeddings").select(
        i.alias("patch_id"), (i % 8).alias("normal_idx"), (F.call_function("div", i, F.lit(8)) % 10).alias("depth_idx"), F.lit(0).cast("long").alias("rot_idx"),
        F.when(i % 3 == 0, 1).when(i % 3 == 1, 2).otherwise(4).cast("long").alias("scale"), F.col("label").cast("long").alias("label"),
    )


def _views(spark, sf):
    """11 views of each query: 4 shifts by 2 directions, and 3 local windows."""
    e = F.col("emb")
    made = [("global", V.rotate(x, s, DIM)) for s in (0, 16, 32, 48) for x in (e, F.reverse(e))] + [("local", V.window_only(e, s, 32)) for s in (0, 16, 32)]
    every = F.array(*(F.struct(F.lit(i).alias("view_idx"), F.lit(b).alias("branch"), x.alias("emb")) for i, (b, x) in enumerate(made)))
    return _vectors(spark, sf).filter("patch_id % 25 = 0").select(F.col("patch_id").alias("query_id"), F.explode(every).alias("v")).select("query_id", "v.*")


def _candidates(spark, sf, k=K_VIEW):
    near = topk.vector_topk(_views(spark, sf), _vectors(spark, sf), k)
    return near.withColumn("branch", F.when(F.col("view_idx") < 8, "global").otherwise("local"))


def _fused(spark, sf, w_local=0.35, local="top2_mean"):
    return fusion.fuse(fusion.evidence(_candidates(spark, sf), local), 1.0, w_local)


def _hits(spark, sf, k=HITS_K):
    """Ranked hits with the stand-in distance: 1 if the labels differ, plus |query - patch| / 100."""
    found = fusion.rank_hits(fusion.dedup_slices(fusion.with_manifest(_fused(spark, sf), _manifest(spark, sf))), k)
    label = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("q_label"))
    d = F.when(F.col("label") != F.col("q_label"), 1.0).otherwise(0.0) + F.abs(F.col("query_id") - F.col("patch_id")) / 100
    return found.join(label, "query_id").withColumn("dist", d).withColumn("row_idx", F.col("query_id")).withColumn("source", F.when(F.col("query_id") % 2 == 0, "allen").otherwise("real"))


_VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 25 = 0)"


def _shift(x, s):
    return x if not s else f"list_concat({x}[{s + 1}:64], {x}[1:{s}])"


_VIEWS = "views AS (" + " UNION ALL ".join(
    [f"SELECT vec_id AS query_id, {2 * i + j} AS view_idx, 'global' AS branch, {_shift(x, s)} AS e FROM (SELECT vec_id, e, list_reverse(e) AS r FROM q)" for i, s in enumerate((0, 16, 32, 48)) for j, x in enumerate(("e", "r"))]
    + [f"SELECT vec_id, {8 + i}, 'local', [CASE WHEN i > {s} AND i <= {s + 32} THEN e[i] ELSE 0.0 END FOR i IN range(1, 65)] FROM q" for i, s in enumerate((0, 16, 32))]
) + ")"
_CAND = f"cand AS (SELECT * FROM (SELECT w.query_id, w.view_idx, w.branch, p.vec_id AS patch_id, list_inner_product(w.e, p.e) AS score, row_number() OVER (PARTITION BY w.query_id, w.view_idx ORDER BY list_inner_product(w.e, p.e) DESC, p.vec_id) AS view_rank FROM views w, v p WHERE p.vec_id <> w.query_id) WHERE view_rank <= {K_VIEW})"


def _ev(w_local=0.35, local="top2_mean"):
    lagg = "list_avg(ls[1:2])" if local == "top2_mean" else "ls[1]"
    return f"""{_VEC}, {_VIEWS}, {_CAND},
ev0 AS (SELECT query_id, patch_id, max(score) FILTER (WHERE branch = 'global') AS g, list_reverse_sort(list(score) FILTER (WHERE branch = 'local')) AS ls FROM cand GROUP BY ALL),
ev AS (SELECT query_id, patch_id, g, {lagg} AS l, ls[1] AS l_best FROM ev0),
fused AS (SELECT query_id, patch_id, coalesce(g, 0) + coalesce({w_local} * l, 0) AS score, CASE WHEN coalesce(g >= {w_local} * l_best, g IS NOT NULL) THEN 'global' ELSE 'local' END AS branch FROM ev)"""


_MAN = "man AS (SELECT vec_id AS patch_id, vec_id % 8 AS normal_idx, (vec_id // 8) % 10 AS depth_idx, CAST(0 AS BIGINT) AS rot_idx, CAST(CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS BIGINT) AS scale, CAST(label AS BIGINT) AS label FROM embeddings)"
_DEDUP = "dd AS (SELECT * FROM (SELECT f.*, m.* EXCLUDE (patch_id), row_number() OVER (PARTITION BY query_id, normal_idx, depth_idx, rot_idx ORDER BY score DESC, f.patch_id) AS r0 FROM fused f JOIN man m USING (patch_id)) WHERE r0 = 1)"


def _hits_sql(k=HITS_K):
    return f"""{_ev()}, {_MAN}, {_DEDUP},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, patch_id) AS rank FROM dd),
hits AS (SELECT r.query_id AS row_idx, r.query_id, CASE WHEN r.query_id % 2 = 0 THEN 'allen' ELSE 'real' END AS source, r.patch_id, r.rank, r.score, r.branch, r.scale, CASE WHEN r.label <> e.label THEN 1.0 ELSE 0.0 END + abs(r.query_id - r.patch_id) / 100 AS dist FROM ranked r JOIN embeddings e ON e.vec_id = r.query_id WHERE r.rank <= {k})"""


_HITS = "WITH " + _hits_sql()


# ---------------------------------------------------------------- search
@_query(f"WITH {_ev()}, {_MAN}, {_DEDUP} SELECT query_id, patch_id, rank, round(score, 6) AS score, branch, scale FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, patch_id) AS rank FROM dd) WHERE rank <= 10")
def flagship_fused_search(spark, sf):
    hits = fusion.rank_hits(fusion.dedup_slices(fusion.with_manifest(_fused(spark, sf), _manifest(spark, sf))), 10)
    return hits.select("query_id", "patch_id", "rank", _r("score").alias("score"), "branch", "scale")


_KNN = f"WITH {_VEC} SELECT query_id, patch_id, rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS patch_id, list_inner_product(q.e, v.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id) AS rank FROM q, v WHERE q.vec_id <> v.vec_id) WHERE rank <= 5"


@_query(_KNN)
def knn_exact(spark, sf):
    q = _views(spark, sf).filter("view_idx = 0")
    return topk.vector_topk(q, _vectors(spark, sf), 5).select("query_id", "patch_id", F.col("view_rank").cast("long").alias("rank"), _r("score").alias("score"))


def _asked(spark, sf):
    return _views(spark, sf).filter("view_idx = 0")


def _found(near):
    return near.select("query_id", "patch_id", F.col("view_rank").cast("long").alias("rank"), _r("score").alias("score"))


@_query()
def knn_ivf(spark, sf):
    """An inverted-list index, built, kept and opened again; three in sixteen of its cells are probed."""
    path = scratch(spark)
    vector_index.build_index(_vectors(spark, sf), path, "ivf")
    return _found(vector_index.search_index(vector_index.open_index(spark, path), _asked(spark, sf), 5))


@_query()
def knn_graph(spark, sf):
    """A neighbour graph, built and kept, searched with a beam."""
    index = vector_index.build_index(_vectors(spark, sf), scratch(spark), "graph")
    return _found(vector_index.search_index(index, _asked(spark, sf), 5))


@_query(f"WITH {_VEC}, r AS (SELECT q.vec_id AS query_id, v.vec_id AS patch_id, list_inner_product(q.e, v.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id) AS rank FROM q JOIN v ON v.vec_id <> q.vec_id) SELECT query_id, patch_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5")
def index_append(spark, sf):
    """A kept index of half the vectors takes in the other half, then all of them again, which adds none; the planner chooses its kind."""
    vectors, path = _vectors(spark, sf), scratch(spark)
    half = F.pmod(F.xxhash64("patch_id"), F.lit(2)) == 0
    vector_index.build_index(vectors.filter(half), path)
    vector_index.append_vectors(vector_index.open_index(spark, path), vectors.filter(~half))
    vector_index.append_vectors(vector_index.open_index(spark, path), vectors)
    return _found(vector_index.search_index(vector_index.open_index(spark, path), _asked(spark, sf), 5))


@_query(f"WITH {_VEC}, {_VIEWS}, {_CAND} SELECT query_id, CAST(view_idx AS BIGINT) AS view_idx, patch_id, view_rank, round(score, 6) AS score FROM cand WHERE view_rank <= 10")
def multiview_topk_per_view(spark, sf):
    return _candidates(spark, sf, 10).select("query_id", F.col("view_idx").cast("long").alias("view_idx"), "patch_id", F.col("view_rank").cast("long").alias("view_rank"), _r("score").alias("score"))


def _fused_case(name, w_local, local):
    def f(spark, sf):
        return _fused(spark, sf, w_local, local).select("query_id", "patch_id", _r("score").alias("score"), "branch")

    f.__name__ = name
    _query(f"WITH {_ev(w_local, local)} SELECT query_id, patch_id, round(score, 6) AS score, branch FROM fused")(f)


_fused_case("local_max", 0.35, "max")
_fused_case("local_top2_mean", 0.35, "top2_mean")
_fused_case("fused_local_dominant", 1.5, "top2_mean")


@_query(f"WITH {_ev()}, {_MAN}, d1 AS (SELECT * FROM (SELECT f.*, m.* EXCLUDE (patch_id), row_number() OVER (PARTITION BY query_id, normal_idx, depth_idx, rot_idx ORDER BY score DESC, f.patch_id) AS r0 FROM fused f JOIN man m USING (patch_id) WHERE scale IN (1, 2)) WHERE r0 = 1) SELECT * FROM (SELECT query_id, patch_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, patch_id) AS rank, round(score, 6) AS score, scale FROM d1) WHERE rank <= 10")
def scale_postfilter(spark, sf):
    kept = fusion.scale_filter(fusion.with_manifest(_fused(spark, sf), _manifest(spark, sf)), (1, 2))
    return fusion.rank_hits(fusion.dedup_slices(kept), 10).select("query_id", "patch_id", "rank", _r("score").alias("score"), "scale")


@_query(f"WITH {_VEC}, {_MAN} SELECT query_id, patch_id, rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS patch_id, list_inner_product(q.e, v.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id) AS rank FROM q, v JOIN man ON man.patch_id = v.vec_id WHERE q.vec_id <> v.vec_id AND scale IN (1, 2)) WHERE rank <= 10")
def scale_prefilter(spark, sf):
    few = fusion.scale_filter(_vectors(spark, sf).drop("label").join(_manifest(spark, sf), "patch_id"), (1, 2))
    return topk.vector_topk(_views(spark, sf).filter("view_idx = 0"), few, 10).select("query_id", "patch_id", F.col("view_rank").cast("long").alias("rank"), _r("score").alias("score"))


@_query(f"WITH {_ev()}, {_MAN}, {_DEDUP} SELECT query_id, patch_id, normal_idx, depth_idx, rot_idx, round(score, 6) AS score FROM dd")
def slice_dedup(spark, sf):
    return fusion.dedup_slices(fusion.with_manifest(_fused(spark, sf), _manifest(spark, sf))).select("query_id", "patch_id", *fusion.SLICE_KEY, _r("score").alias("score"))


@_query(f"WITH {_ev()}, {_MAN} SELECT query_id, count(*) AS n_candidates, count(DISTINCT normal_idx * 100 + depth_idx) AS n_slices FROM fused JOIN man USING (patch_id) GROUP BY 1")
def candidate_counts(spark, sf):
    return fusion.candidate_counts(fusion.with_manifest(_fused(spark, sf), _manifest(spark, sf)))


@_query(f"{_HITS} SELECT h.query_id, h.patch_id, h.rank, m.normal_idx, m.depth_idx, m.scale FROM hits h LEFT JOIN (SELECT * FROM man WHERE patch_id % 7 <> 0) m USING (patch_id)")
def missing_manifest_rows(spark, sf):
    few = _manifest(spark, sf).filter("patch_id % 7 != 0").select("patch_id", "normal_idx", "depth_idx", "scale")
    hits = _hits(spark, sf).select("query_id", "patch_id", "rank")
    return fusion.with_manifest(hits, few, keep_missing=True).select("query_id", "patch_id", "rank", "normal_idx", "depth_idx", "scale")


@_query(f"WITH {_VEC}, d AS (SELECT vec_id, e FROM v UNION ALL SELECT vec_id + 100000, e FROM v WHERE vec_id % 2 = 0) SELECT * FROM (SELECT q.vec_id AS query_id, d.vec_id AS patch_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.e, d.e), 9) DESC, d.vec_id) AS rank FROM q, d WHERE q.vec_id <> d.vec_id) WHERE rank <= 6")
def topk_ties(spark, sf):
    v = _vectors(spark, sf).select("patch_id", "emb")
    both = v.unionByName(v.filter("patch_id % 2 = 0").withColumn("patch_id", F.col("patch_id") + 100000))
    near = topk.vector_topk(_views(spark, sf).filter("view_idx = 0"), both, 12).withColumn("score", F.round("score", 9))
    return fusion.rank_hits(near, 6).select("query_id", "patch_id", "rank")


@_query("SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS norm2, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS cos_rev FROM embeddings")
def vector_functions(spark, sf):
    e = F.col("emb")
    return _vectors(spark, sf).select(F.col("patch_id").alias("vec_id"), _r(V.dot(e, e)).alias("norm2"), _r(V.cosine(V.l2_normalise(e), F.reverse(e))).alias("cos_rev"))


# ---------------------------------------------------------------- scores
def _norm_case(name, expr, f):
    def g(spark, sf):
        from pyspark.sql import Window

        return _hits(spark, sf).select("query_id", "patch_id", _r(f(F.col("score"), Window.partitionBy("query_id")), 5).alias("z"))

    g.__name__ = name
    _query(f"{_HITS} SELECT query_id, patch_id, round({expr}, 5) AS z FROM hits WINDOW w AS (PARTITION BY query_id)")(g)


_norm_case("score_zscore", "CASE WHEN stddev_pop(score) OVER w < 1e-6 THEN 0.0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END", N.zscore)
_norm_case("score_minmax", "CASE WHEN max(score) OVER w - min(score) OVER w < 1e-6 THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END", N.minmax)


@_query(f"""{_HITS}, c AS (SELECT *, (patch_id * 7919 % 1000) / 1000.0::DOUBLE AS raw, CASE WHEN rank <= 10 THEN 0 ELSE 1 END AS segment FROM hits),
b AS (SELECT *, CASE WHEN segment = 0 THEN 0.4::DOUBLE * (score - avg(score) OVER w) / stddev_pop(score) OVER w + 0.6::DOUBLE * (raw - avg(raw) OVER w) / stddev_pop(raw) OVER w END AS blend FROM c WINDOW w AS (PARTITION BY query_id, segment))
SELECT query_id, patch_id, segment::BIGINT AS segment, row_number() OVER (PARTITION BY query_id ORDER BY segment, blend DESC NULLS LAST, CASE WHEN segment = 0 THEN raw END DESC NULLS LAST, rank, patch_id) AS new_rank FROM b""")
def rerank_segment_order(spark, sf):
    hits = _hits(spark, sf).withColumn("raw", (F.col("patch_id") * 7919 % 1000) / 1000)
    return rerank.rerank_order(hits, topk=10, alpha=0.6).select("query_id", "patch_id", F.col("segment").cast("long").alias("segment"), "new_rank")


@_query()
def mlp_rerank(spark, sf):
    cfg = rerank.RerankerConfig(dim=DIM, hidden=(32, 16))
    hits = _hits(spark, sf, 10)
    views = _views(spark, sf).filter("branch = 'global'").select("query_id", "view_idx", F.col("emb").alias("q"))
    pairs = hits.select("query_id", "patch_id").join(views, "query_id").join(_vectors(spark, sf).select("patch_id", F.col("emb").alias("c")), "patch_id")
    raw = rerank.max_over_views(rerank.score_pairs(pairs, rerank.init_weights(cfg), ["query_id", "patch_id"]))
    return rerank.rerank_order(hits.join(raw, ["query_id", "patch_id"]), 10).select("query_id", "patch_id", "rank", "new_rank", _r("raw").alias("raw"))


# ---------------------------------------------------------------- metrics
@_query(f"{_HITS} SELECT row_idx, source, " + ", ".join(f"round(min(dist) FILTER (WHERE rank <= {k}), 6) AS geom_at_{k}" for k in metrics.KS) + " FROM hits GROUP BY 1, 2")
def geom_at_k(spark, sf):
    return metrics.geom_at_k(_hits(spark, sf)).select("row_idx", "source", *(_r(f"geom_at_{k}").alias(f"geom_at_{k}") for k in metrics.KS))


@_query(f"{_HITS} SELECT row_idx, source, first(rank ORDER BY dist, rank) AS rank_best FROM hits GROUP BY 1, 2")
def rank_best_geom(spark, sf):
    return metrics.rank_best(_hits(spark, sf))


@_query(f"{_HITS} SELECT row_idx, source, " + ", ".join(f"max(CASE WHEN dist <= {t} AND rank <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sr_{k}_{i}" for i, t in enumerate(THRESHOLDS) for k in (10, 100)) + " FROM hits GROUP BY 1, 2")
def success_rate(spark, sf):
    return metrics.success(_hits(spark, sf), THRESHOLDS)


@_query(f"{_HITS} SELECT row_idx, source, " + ", ".join(f"round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE dist <= {t} AND rank <= 100), 0.0), 6) AS rr_{i}" for i, t in enumerate(THRESHOLDS)) + " FROM hits GROUP BY 1, 2")
def mrr(spark, sf):
    return metrics.reciprocal_rank(_hits(spark, sf), THRESHOLDS).select("row_idx", "source", *(_r(f"rr_{i}").alias(f"rr_{i}") for i in range(3)))


_NDCG = f"""{_HITS}, t AS (SELECT *, greatest(quantile_cont(dist, 0.5) OVER (PARTITION BY row_idx, source), 1e-6) AS tau FROM hits),
g AS (SELECT *, exp(-dist / tau) AS gain, row_number() OVER (PARTITION BY row_idx, source ORDER BY dist, rank) AS ideal FROM t)
SELECT row_idx, source, """ + ", ".join(f"round(sum(gain / log2(rank + 1)) FILTER (WHERE rank <= {k}) / sum(gain / log2(ideal + 1)) FILTER (WHERE ideal <= {k}), 6) AS ndcg_{k}" for k in (10, 100)) + " FROM g GROUP BY 1, 2"


@_query(_NDCG)
def ndcg(spark, sf):
    return metrics.ndcg(_hits(spark, sf)).select("row_idx", "source", *(_r(f"ndcg_{k}").alias(f"ndcg_{k}") for k in (10, 100)))


@_query(f"{_HITS} SELECT " + ", ".join(f"round(greatest(quantile_cont(dist, {p}), 1e-6), 6) AS {n}" for p, n in ((0.25, "t25"), (0.5, "t50"), (0.75, "t75"))) + " FROM hits WHERE rank = 1")
def thresholds_from_baseline(spark, sf):
    return metrics.thresholds_of(_hits(spark, sf)).select(*(_r(c).alias(c) for c in ("t25", "t50", "t75")))


def _labelled(spark, sf):
    return _hits(spark, sf).withColumn("q_is_crop", F.col("query_id") % 50 == 0).withColumn("search_mode", F.when(F.col("query_id") % 75 == 0, "fast").otherwise("smart"))


_PER = f"""per AS (SELECT row_idx, source, row_idx % 50 = 0 AS crop, CASE WHEN row_idx % 75 = 0 THEN 'fast' ELSE 'smart' END AS mode, min(dist) FILTER (WHERE rank <= 1) AS g1, min(dist) FILTER (WHERE rank <= 10) AS g10, max(CASE WHEN dist <= {THRESHOLDS[0]} AND rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s10, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE dist <= {THRESHOLDS[0]} AND rank <= 100), 0.0) AS rr FROM hits GROUP BY ALL),
lab AS (SELECT *, unnest(['ALL', CASE WHEN crop THEN 'CROP' ELSE 'FULL' END, 'SEARCH_MODE=' || mode]) AS grp FROM per), src AS (SELECT * EXCLUDE (source), unnest(['ALL', source]) AS source FROM lab),
agg AS (SELECT grp, source, count(*) AS n, avg(g1) AS a, quantile_cont(g1, 0.5) AS b, avg(g10) AS c, quantile_cont(g10, 0.5) AS d, avg(s10) AS e, avg(rr) AS f FROM src GROUP BY ALL)"""
_TIDY = "SELECT grp AS \"group\", source, metric, round(value, 6) AS value, n AS n_queries FROM (SELECT grp, source, n, unnest(['Geom@1 mean', 'Geom@1 median', 'Geom@10 mean', 'Geom@10 median', 'SR@10(t0) mean', 'MRR(t0) mean']) AS metric, unnest([a, b, c, d, e, f]) AS value FROM agg)"
_SHOWN = ("Geom@1 mean", "Geom@1 median", "Geom@10 mean", "Geom@10 median", "SR@10(t0) mean", "MRR(t0) mean")


@_query(f"{_HITS}, {_PER} {_TIDY}")
def metrics_by_group(spark, sf):
    tidy = metrics.report_metrics(_labelled(spark, sf), THRESHOLDS)
    return tidy.filter(F.col("metric").isin(*_SHOWN)).select("group", "source", "metric", _r("value").alias("value"), "n_queries")


@_query(f"{_HITS}, {_PER} SELECT grp AS \"group\", round(max(a) FILTER (WHERE source = 'ALL'), 6) AS \"ALL\", round(max(a) FILTER (WHERE source = 'allen'), 6) AS allen, round(max(a) FILTER (WHERE source = 'real'), 6) AS \"real\" FROM agg GROUP BY 1")
def report_pivot(spark, sf):
    tidy = metrics.report_metrics(_labelled(spark, sf), THRESHOLDS).filter("metric = 'Geom@1 mean'")
    return tidy.groupBy("group").pivot("source", ["ALL", "allen", "real"]).agg(F.round(F.first("value"), 6))


@_query(f"""{_HITS}, {_PER}, per2 AS (SELECT row_idx, source, min(dist) AS g1 FROM hits WHERE rank = 2 GROUP BY ALL),
a2 AS (SELECT 'ALL' AS grp, s AS source, avg(g1) AS a FROM (SELECT g1, unnest(['ALL', source]) AS s FROM per2) GROUP BY ALL)
SELECT coalesce(x.grp, y.grp) AS "group", coalesce(x.source, y.source) AS source, round(x.a, 6) AS base, round(y.a, 6) AS other, round(y.a - x.a, 6) AS delta_other FROM (SELECT grp, source, a FROM agg) x FULL OUTER JOIN a2 y ON x.grp = y.grp AND x.source = y.source""")
def compare_runs(spark, sf):
    hits = written(_labelled(spark, sf).select("row_idx", "source", "rank", "dist", "q_is_crop", "search_mode"))  # both runs read them
    second = hits.drop("q_is_crop", "search_mode").filter("rank = 2").withColumn("rank", F.lit(1).cast("long"))
    runs = {"base": metrics.report_metrics(hits, THRESHOLDS), "other": metrics.report_metrics(second, THRESHOLDS)}
    both = metrics.compare_runs({n: r.filter("metric = 'Geom@1 mean'") for n, r in runs.items()})
    return both.select("group", "source", *(_r(c).alias(c) for c in ("base", "other", "delta_other")))


@_query(f"{_HITS}, f AS (SELECT row_idx, avg(score) AS s, avg(dist) AS d FROM hits WHERE rank = 1 GROUP BY 1) SELECT round(avg(s), 6) AS avg_top1, round(avg(d), 6) AS avg_dist1, count(*) AS n_rows FROM f")
def running_stats(spark, sf):
    return metrics.running_stats(_hits(spark, sf)).select(_r("avg_top1").alias("avg_top1"), _r("avg_dist1").alias("avg_dist1"), "n_rows")


# ---------------------------------------------------------------- targets
def _targets_case(name, divisor, low, high):
    def f(spark, sf):
        got = targets.soft_targets(_hits(spark, sf), ["row_idx", "source"], divisor, low, high)
        return got.select("row_idx", "source", "patch_id", *(_r(c).alias(c) for c in ("tau", "logit", "prob")))

    f.__name__ = name
    _query(f"""{_HITS}, t AS (SELECT *, least(greatest(greatest(quantile_cont(dist, 0.9) OVER w - quantile_cont(dist, 0.1) OVER w, 1e-6) / {divisor}, {low}), {high}) AS tau FROM hits WINDOW w AS (PARTITION BY row_idx, source)),
e AS (SELECT *, -dist / tau AS logit, exp(-dist / tau - max(-dist / tau) OVER (PARTITION BY row_idx, source)) AS x FROM t)
SELECT row_idx, source, patch_id, round(tau, 6) AS tau, round(logit, 6) AS logit, round(x / sum(x) OVER (PARTITION BY row_idx, source), 6) AS prob FROM e""")(f)


_targets_case("soft_targets_eval", 3.0, 1e-3, 1e4)
_targets_case("soft_targets_train", 4.0, 1.0, 256.0)


@_query(f"{_HITS} SELECT row_idx, source, round(greatest((quantile_cont(dist, 0.5) - min(dist)) / ln(10), 1e-6), 6) AS tau FROM hits GROUP BY 1, 2")
def adaptive_tau(spark, sf):
    return targets.adaptive_tau(_hits(spark, sf), ["row_idx", "source"]).select("row_idx", "source", _r("tau").alias("tau"))


@_query(f"{_HITS} SELECT row_idx, patch_id, round(least(greatest(dist, 0), 2.0), 6) AS clipped, round(ln(1 + least(greatest(dist, 0), 2.0)), 6) AS log1p FROM hits")
def distance_targets(spark, sf):
    d = F.col("dist")
    return _hits(spark, sf).select("row_idx", "patch_id", _r(N.distance_target(d, "clipped", 2.0)).alias("clipped"), _r(N.distance_target(d, "log1p", 2.0)).alias("log1p"))


@_query(f"{_HITS}, a AS (SELECT row_idx, list_sort(list(dist)) AS ds FROM hits GROUP BY 1) SELECT row_idx, round(list_avg(ds[1:greatest(1, CAST(floor(len(ds) * 0.9) AS BIGINT))]), 6) AS tm FROM a")
def trimmed_mean(spark, sf):
    return _hits(spark, sf).groupBy("row_idx").agg(F.collect_list("dist").alias("ds")).select("row_idx", _r(N.trimmed_mean(F.col("ds"), 0.1)).alias("tm"))


# ---------------------------------------------------------------- pools
_MIX = "((0 * 31 + {0}) % 4294967296 * 2654435761) % 4294967296"


@_query(f"{_HITS} SELECT row_idx, source, patch_id, rank, round(dist, 6) AS dist FROM (SELECT *, count(*) OVER (PARTITION BY row_idx, source) AS n FROM hits WHERE rank <= 20 AND patch_id % 3 <> 0) WHERE n >= 12")
def pool_build(spark, sf):
    known = _vectors(spark, sf).filter("patch_id % 3 != 0")
    return pools.build_pools(_hits(spark, sf), known, 20, 12).withColumn("dist", _r("dist"))


@_query("""WITH k AS (SELECT vec_id AS row_idx, ((42 * 31 + vec_id) % 4294967296 * 2654435761) % 4294967296 AS o FROM embeddings),
p AS (SELECT row_idx, count(*) OVER () AS n, row_number() OVER (ORDER BY o, row_idx) AS i FROM k)
SELECT row_idx, CASE WHEN i <= round_even(n * 0.8, 0) THEN 'train' WHEN i <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM p""")
def split_rows(spark, sf):
    return pools.split_rows(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("row_idx")))


@_query(f"""{_HITS}, b AS (SELECT row_idx, source, patch_id, rank, CASE WHEN rank <= 4 THEN 0 WHEN rank <= 12 THEN 1 ELSE 2 END AS band, ((((0 * 31 + row_idx) % 4294967296) * 31 + patch_id) % 4294967296 * 2654435761) % 4294967296 AS o, count(*) OVER (PARTITION BY row_idx, source) AS n FROM hits),
r AS (SELECT *, row_number() OVER (PARTITION BY row_idx, source, band ORDER BY o, patch_id) AS r FROM b), w AS (SELECT *, r > [3, 4, 4][band + 1] AS over FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY row_idx, source ORDER BY over, CASE WHEN over THEN 0 ELSE band END, o, patch_id) AS p FROM w)
SELECT row_idx, source, patch_id, rank, band::BIGINT AS band FROM p WHERE n <= 12 OR p <= 12""")
def stratified_sample(spark, sf):
    base = _hits(spark, sf).select("row_idx", "source", "patch_id", "rank")
    return pools.stratified_sample(base, 12, (4, 12), (3, 4, 4)).withColumn("band", F.col("band").cast("long"))


# ---------------------------------------------------------------- resume
def _log(spark, sf):
    """Hits in which some rows are incomplete."""
    return _hits(spark, sf).filter("NOT (row_idx % 100 = 0 AND rank > 7)").select(F.lit("sig1").alias("eval_sig"), "row_idx", "source", "rank", "patch_id")


_LOG = f"{_HITS}, log AS (SELECT 'sig1' AS eval_sig, row_idx, source, rank, patch_id FROM hits WHERE NOT (row_idx % 100 = 0 AND rank > 7)), cnt AS (SELECT row_idx, source, count(*) AS n FROM log GROUP BY ALL)"


@_query(f"{_LOG} SELECT vec_id AS row_idx FROM embeddings WHERE vec_id NOT IN (SELECT row_idx FROM cnt WHERE n >= 20 AND source = 'allen')")
def pending_rows(spark, sf):
    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("row_idx"))
    return incremental.pending(rows, _log(spark, sf), "sig1", 20, ["allen"])


@_query(f"{_LOG} SELECT l.row_idx, l.source, l.rank, l.patch_id FROM log l JOIN cnt USING (row_idx, source) WHERE n >= 20")
def partial_groups_purge(spark, sf):
    return incremental.purge_partial(_log(spark, sf), "sig1", 20).select("row_idx", "source", "rank", "patch_id")


@_query(f"{_LOG} SELECT row_idx FROM cnt WHERE n >= 20 AND source = 'real'")
def completed_queries(spark, sf):
    return incremental.completed(_log(spark, sf), "sig1", 20, ["real"])


@_query(f"{_LOG} SELECT eval_sig, row_idx, source, rank, patch_id FROM log")
def stream_append_hits(spark, sf):
    path = scratch(spark)
    _log(spark, sf).repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("eval_sig string, row_idx long, source string, rank long, patch_id long").parquet(f"{path}/in")
    incremental.append_stream(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")

@_query(f"{_LOG} SELECT vec_id AS row_idx FROM embeddings WHERE vec_id NOT IN (SELECT row_idx FROM cnt WHERE source = 'allen') AND NOT (vec_id % 10 = 1)")
def pending_marked(spark, sf):
    """What is left to do after a run that was marked, short lists and rows without hits included, and one that broke before its markers."""
    path, hits = scratch(spark), written(_log(spark, sf))
    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("row_idx"))
    asked = hits.filter("source = 'allen'").select("row_idx", "source").unionByName(rows.filter("row_idx % 10 = 1").withColumn("source", F.lit("allen")))
    incremental.append_marked(hits.filter("source = 'allen'"), asked, path, "sig1")
    hits.filter("source = 'real'").withColumn("run", F.lit("broken")).write.mode("append").partitionBy("run").parquet(path)
    return incremental.pending_marked(rows, incremental.read_markers(spark, path), "sig1", ["allen"])


@_query(f"{_LOG} SELECT row_idx, source, rank, patch_id FROM log WHERE source = 'allen'")
def visible_hits(spark, sf):
    """Hits of marked runs; those of a run that broke are not seen."""
    path, hits = scratch(spark), written(_log(spark, sf))
    allen = hits.filter("source = 'allen'")
    incremental.append_marked(allen, allen, path, "sig1")
    hits.withColumn("run", F.lit("broken")).write.mode("append").partitionBy("run").parquet(path)
    return incremental.visible(spark.read.parquet(path), incremental.read_markers(spark, path)).select("row_idx", "source", "rank", "patch_id")


def _first_hits(spark, sf):
    row = F.call_function("div", F.col("query_id"), F.lit(50))
    return _hits(spark, sf).filter("rank = 1").select(
        row.alias("row_idx"), "source", "score", F.when(F.col("patch_id") % 5 > 0, F.col("dist")).alias("dist"), F.when(F.col("patch_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("dist") * 25).alias("corner"),
        ((F.col("patch_id") % 97) / 100).alias("latency_s"), ((row % 13) / 10).alias("row_latency_s"),
    )


_FIRST = f"""{_HITS}, f AS (SELECT query_id // 50 AS row_idx, source, score, CASE WHEN patch_id % 5 > 0 THEN dist END AS d, CASE WHEN patch_id % 3 <> 0 THEN dist * 25 END AS c, (patch_id % 97)::DOUBLE / 100 AS l, (query_id // 50 % 13)::DOUBLE / 10 AS rl FROM hits WHERE rank = 1),
r AS (SELECT row_idx, max(rl) AS rl, count(*) AS q, sum(l) AS l, avg(score) AS s, avg(d) AS d, avg(c) AS c FROM f GROUP BY row_idx)
SELECT count(*) AS n_rows, CAST(sum(q) AS BIGINT) AS n_queries, round(avg(s), 6) AS avg_top1, round(1000 * avg(rl), 6) AS avg_row_latency_ms, round(1000 * sum(l) / sum(q), 6) AS avg_query_latency_ms, round(avg(d), 6) AS avg_dist1, round(avg(c), 6) AS avg_corner1 FROM r"""


def _rounded(found):
    return found.select("n_rows", "n_queries", *(_r(c).alias(c) for c in ("avg_top1", "avg_row_latency_ms", "avg_query_latency_ms", "avg_dist1", "avg_corner1")))


@_query(_FIRST)
def batch_averages(spark, sf):
    return _rounded(averages.averages(_first_hits(spark, sf)))


@_query(_FIRST)
def stream_averages(spark, sf):
    """The same averages kept over a stream whose rows come apart over batches, some twice, with a restart."""
    path, first = scratch(spark), written(_first_hits(spark, sf))
    for source in ("allen", "real", "allen"):
        first.filter(F.col("source") == source).coalesce(2).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(averages.FIRST).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        averages.average_stream(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return _rounded(averages.read_averages(spark.read.parquet(f"{path}/out")))


# ---------------------------------------------------------------- generators
@_query(f"SELECT i AS normal_idx, round(sqrt(1 - z * z) * cos(th) / n, 6) AS nx, round(sqrt(1 - z * z) * sin(th) / n, 6) AS ny, round(z / n, 6) AS nz FROM (SELECT i, z, th, sqrt((1 - z * z) * cos(th) * cos(th) + (1 - z * z) * sin(th) * sin(th) + z * z) AS n FROM (SELECT i, 1 - 2 * (i + 0.5::DOUBLE) / (SELECT count(*) FROM embeddings) AS z, 2 * pi() * (i + 0.5::DOUBLE) / {P.GOLDEN!r}::DOUBLE AS th FROM range((SELECT count(*) FROM embeddings)) t(i)))")
def fibonacci_normals(spark, sf):
    return P.fibonacci_normals(spark, _many(spark, sf)).select("normal_idx", *(_r(c).alias(c) for c in ("nx", "ny", "nz")))


_FIB = f"fib AS (SELECT i AS normal_idx, sqrt(1 - z * z) * cos(th) AS nx, sqrt(1 - z * z) * sin(th) AS ny, z AS nz FROM (SELECT i, 1 - 2 * (i + 0.5::DOUBLE) / (SELECT count(*) FROM embeddings) AS z, 2 * pi() * (i + 0.5::DOUBLE) / {P.GOLDEN!r}::DOUBLE AS th FROM range((SELECT count(*) FROM embeddings)) t(i))), half AS (SELECT *, abs(nx) * 9.5::DOUBLE + abs(ny) * 14.5::DOUBLE + abs(nz) * 19.5::DOUBLE AS hd FROM fib)"


@_query(f"WITH {_FIB}, d AS (SELECT *, unnest(range(0, CAST(floor((2 * hd - 2) / 2.5::DOUBLE) AS BIGINT) + 1)) AS depth_idx FROM half) SELECT normal_idx, depth_idx, round(-hd + 1 + depth_idx * 2.5::DOUBLE, 6) AS depth FROM d")
def depth_schedule(spark, sf):
    return P.slice_plan(P.fibonacci_normals(spark, _many(spark, sf)), (20, 30, 40), 2.5, 1.0).select("normal_idx", F.col("depth_idx").cast("long").alias("depth_idx"), _r("depth").alias("depth"))


@_query(f"WITH {_FIB} SELECT normal_idx, i AS depth_idx, abs(round(-hd + i * 2 * hd / 6, 6)) * sign(round(-hd + i * 2 * hd / 6, 6)) AS depth FROM half, range(7) t(i)")
def depth_linspace(spark, sf):
    half = G.depth_bounds(G.vec(F.col("nx"), F.col("ny"), F.col("nz")), (20, 30, 40))
    laid = P.fibonacci_normals(spark, _many(spark, sf)).select("normal_idx", F.posexplode(P.depths_linspace(-half, half, 7)).alias("depth_idx", "depth"))
    return laid.select("normal_idx", F.col("depth_idx").cast("long").alias("depth_idx"), _r("depth").alias("depth"))


@_query(f"WITH {_FIB} SELECT CAST(sum((CAST(floor((2 * hd - 2) / 2.5::DOUBLE) AS BIGINT) + 1) * 3) AS BIGINT) AS n_slices FROM half")
def slice_plan_count(spark, sf):
    return P.slice_count(P.fibonacci_normals(spark, _many(spark, sf)), (20, 30, 40), 2.5, 1.0, 3)


@_query(f"WITH {_FIB}, d AS (SELECT *, unnest(range(0, CAST(floor((2 * hd - 2) / 2.5::DOUBLE) AS BIGINT) + 1)) AS depth_idx FROM half) SELECT normal_idx, depth_idx, r AS rot_idx, r * 45.0::DOUBLE AS rotation FROM d, range(3) t(r)")
def slice_plan(spark, sf):
    plan = P.slice_plan(P.fibonacci_normals(spark, _many(spark, sf)), (20, 30, 40), 2.5, 1.0, (0.0, 45.0, 90.0))
    return plan.select("normal_idx", F.col("depth_idx").cast("long").alias("depth_idx"), F.col("rot_idx").cast("long").alias("rot_idx"), "rotation")


@_query("""WITH s AS (SELECT scale, CAST(round_even(512.0::DOUBLE / scale, 0) AS BIGINT) AS w FROM (VALUES (1), (2), (4)) t(scale)), p AS (SELECT *, greatest(1, CAST(round_even(w * 0.75::DOUBLE, 0) AS BIGINT)) AS st FROM s), n AS (SELECT *, (512 - w) // st AS n FROM p),
g AS (SELECT scale, r AS patch_row, c AS patch_col, c * st AS x0, r * st AS y0, c * st + w AS x1, r * st + w AS y1 FROM n, range(20) a(r), range(20) b(c) WHERE r <= n AND c <= n)
SELECT o_orderkey, CAST(scale AS BIGINT) AS scale, patch_row, patch_col, x0, y0, x1, y1 FROM orders JOIN g ON o_orderkey * 7 % 512 >= x0 AND o_orderkey * 7 % 512 < x1 AND o_custkey * 13 % 512 >= y0 AND o_custkey * 13 % 512 < y1""")
def patch_grid(spark, sf):
    """Orders as points of a slice, and the patches that hold each."""
    g = P.patch_grid(spark, 512, (1, 2, 4), 0.25)
    g = g.select(*(F.col(c).cast("long").alias(c) for c in g.columns))
    points = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 7 % 512).alias("x"), (F.col("o_custkey") * 13 % 512).alias("y"))
    return points.join(F.broadcast(g), F.col("x").between(F.col("x0"), F.col("x1") - 1) & F.col("y").between(F.col("y0"), F.col("y1") - 1)).drop("x", "y")


_STARTS = "st AS (SELECT o_orderkey AS id, o_orderkey % 900 + 100 AS total, o_orderkey % 90 + 30 AS win FROM orders), sp AS (SELECT *, greatest(1, CAST(round_even(win * 0.5::DOUBLE, 0) AS BIGINT)) AS step FROM st), ss AS (SELECT *, CASE WHEN total - win <= 0 THEN [0] ELSE list_sort(list_distinct(list_append(range(0, total - win + 1, step), total - win))) END AS starts FROM sp)"


def _windows(spark, sf):
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 900 + 100).cast("int").alias("total"), (F.col("o_orderkey") % 90 + 30).cast("int").alias("win"))


@_query(f"WITH {_STARTS} SELECT id, unnest(starts) AS start FROM ss")
def sliding_starts(spark, sf):
    return _windows(spark, sf).select("id", F.explode(P.sliding_starts(F.col("total"), F.col("win"), 0.5)).alias("start")).withColumn("start", F.col("start").cast("long"))


@_query(f"WITH {_STARTS}, a AS (SELECT id, starts, len(starts) AS n FROM ss) SELECT id, unnest(CASE WHEN n <= 4 THEN starts ELSE list_sort(list_distinct([starts[CAST(round_even(i * (n - 1) / 3.0::DOUBLE, 0) AS BIGINT) + 1] FOR i IN range(4)])) END) AS start FROM a")
def reduce_positions(spark, sf):
    starts = P.sliding_starts(F.col("total"), F.col("win"), 0.5)
    return _windows(spark, sf).select("id", F.explode(P.reduce_positions(starts, 4)).alias("start")).withColumn("start", F.col("start").cast("long"))


@_query("""WITH im AS (SELECT o_orderkey AS image_id, o_orderkey % 700 + 40 AS w, o_orderkey % 300 + 50 AS h FROM orders), a AS (SELECT *, least(w, h) AS s, greatest(w, h) AS l FROM im WHERE least(w, h) >= 64 AND greatest(w, h) / least(w, h) >= 1.35),
b AS (SELECT *, greatest(1, CAST(round_even(s * 0.5::DOUBLE, 0) AS BIGINT)) AS step FROM a), c AS (SELECT *, list_sort(list_distinct(list_append(range(0, l - s + 1, step), l - s))) AS st FROM b),
d AS (SELECT *, CASE WHEN len(st) <= 3 THEN st ELSE list_sort(list_distinct([st[CAST(round_even(i * (len(st) - 1) / 2.0::DOUBLE, 0) AS BIGINT) + 1] FOR i IN range(3)])) END AS p FROM c), e AS (SELECT *, unnest(p) AS x, unnest(range(0, len(p))) AS k FROM d)
SELECT image_id, k AS crop_id, CASE WHEN w > h THEN x ELSE 0 END AS x0, CASE WHEN w > h THEN 0 ELSE x END AS y0, CASE WHEN w > h THEN x ELSE 0 END + s AS x1, CASE WHEN w > h THEN 0 ELSE x END + s AS y1 FROM e""")
def local_crop_boxes(spark, sf):
    images = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % 700 + 40).cast("int").alias("width"), (F.col("o_orderkey") % 300 + 50).cast("int").alias("height"))
    got = P.local_crops(images)
    return got.select(*(F.col(c).cast("long").alias(c) for c in got.columns))


@_query("SELECT vec_id, i AS view_idx, (i // 4) * 90.0::DOUBLE AS angle, (i // 2) % 2 = 1 AS flip_x, i % 2 = 1 AS flip_y FROM embeddings, range(16) t(i)")
def view_expansion(spark, sf):
    grid = P.view_grid(spark, flip_y=True).withColumn("view_idx", F.col("view_idx").cast("long"))
    asked = _t(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("view_idx"))
    return asked.join(F.broadcast(grid), "view_idx")


@_query()
def crop_sampler(spark, sf):
    """Nine crops of each image; an embedding stands for one."""
    return P.random_crops(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("plane_id"))).drop("attempt")


# ---------------------------------------------------------------- geometry
def _parts(spark, sf):
    k = F.col("p_partkey")
    return _t(spark, sf, "part").select(k.alias("id"), (k % 17 - 8.0).alias("x"), (k % 13 - 6.0).alias("y"), (k % 11 - 4.5).alias("z"), (k % 90 * 1.0).alias("deg"), (k % 20 - 10.0).alias("depth"))


_PART = "pt AS (SELECT p_partkey AS id, p_partkey % 17 - 8.0::DOUBLE AS x, p_partkey % 13 - 6.0::DOUBLE AS y, p_partkey % 11 - 4.5::DOUBLE AS z, p_partkey % 90 * 1.0::DOUBLE AS deg, p_partkey % 20 - 10.0::DOUBLE AS depth FROM part), un AS (SELECT id, deg, depth, x / (l + 1e-12) AS nx, y / (l + 1e-12) AS ny, z / (l + 1e-12) AS nz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM pt)), rf AS (SELECT *, CASE WHEN abs(nz) < 0.9 THEN 0.0 ELSE 1.0 END AS rx, CASE WHEN abs(nz) < 0.9 THEN 1.0 ELSE 0.0 END AS rz FROM un), gs AS (SELECT *, rx - nx * (rx * nx + rz * nz) AS ax, -ny * (rx * nx + rz * nz) AS ay, rz - nz * (rx * nx + rz * nz) AS az FROM rf), u0 AS (SELECT *, ax / (sqrt(ax * ax + ay * ay + az * az) + 1e-12) AS bx, ay / (sqrt(ax * ax + ay * ay + az * az) + 1e-12) AS by_, az / (sqrt(ax * ax + ay * ay + az * az) + 1e-12) AS bz FROM gs), uv AS (SELECT *, ny * bz - nz * by_ AS cx, nz * bx - nx * bz AS cy, nx * by_ - ny * bx AS cz, cos(radians(deg)) AS co, sin(radians(deg)) AS si FROM u0), ax AS (SELECT *, bx * co + cx * si AS ux, by_ * co + cy * si AS uy, bz * co + cz * si AS uz, -bx * si + cx * co AS vx, -by_ * si + cy * co AS vy, -bz * si + cz * co AS vz FROM uv)"


@_query(f"WITH {_PART} SELECT id, " + ", ".join(f"abs(round({c}, 6)) * sign(round({c}, 6)) AS {c}" for c in ("ux", "uy", "uz", "vx", "vy", "vz")) + " FROM ax")
def plane_basis(spark, sf):
    basis = G.plane_basis(G.vec(F.col("x"), F.col("y"), F.col("z")), F.col("deg"))
    return _parts(spark, sf).select("id", basis.alias("b")).select("id", *(_r(F.col(f"b.{n}.{c}")).alias(f"{n}{c}") for n in "uv" for c in "xyz"))


@_query(f"WITH {_PART} SELECT id, " + ", ".join(f"round(16 + depth * n{c} + (id % 64 - 31.5::DOUBLE) * 0.5 * u{c} + (id % 48 - 31.5::DOUBLE) * 0.5 * v{c}, 6) AS p{c}" for c in "xyz") + " FROM ax")
def pixel_to_voxel(spark, sf):
    n = G.vec(F.col("x"), F.col("y"), F.col("z"))
    posed = _parts(spark, sf).withColumn("b", G.plane_basis(n, F.col("deg")))
    p = G.pixel_to_voxel(G.vec(16, 16, 16), n, F.col("depth"), F.col("b.u"), F.col("b.v"), F.col("id") % 64, F.col("id") % 48, 64, 0.5)
    return posed.select("id", p.alias("p")).select("id", *(_r(F.col(f"p.{c}")).alias(f"p{c}") for c in "xyz"))


@_query("""WITH c AS (SELECT p_partkey AS id, (p_partkey % 101) / 100.0::DOUBLE AS cx, (p_partkey % 89) / 88.0::DOUBLE AS cy, (p_partkey % 97) / 128.0::DOUBLE AS rw, (p_partkey % 83) / 64.0::DOUBLE AS rh FROM part),
s AS (SELECT *, greatest(CAST(round_even(rw * 512, 0) AS BIGINT), 1) AS w, greatest(CAST(round_even(rh * 400, 0) AS BIGINT), 1) AS h FROM c),
o AS (SELECT *, CAST(round_even(cx * 511, 0) AS BIGINT) - w // 2 AS x, CAST(round_even(cy * 399, 0) AS BIGINT) - h // 2 AS y FROM s)
SELECT id, least(greatest(x, 0), 512) AS x0, least(greatest(y, 0), 400) AS y0, least(greatest(x + w, 0), 512) AS x1, least(greatest(y + h, 0), 400) AS y1, round(CASE WHEN id % 2 = 0 THEN least(1.0, greatest(0.0, rw * rh)) ELSE 1.0 END, 6) AS area FROM o""")
def crop_norm(spark, sf):
    k = F.col("p_partkey")
    c = _t(spark, sf, "part").select(k.alias("id"), (k % 101 / 100).alias("cx"), (k % 89 / 88).alias("cy"), (k % 97 / 128).alias("rw"), (k % 83 / 64).alias("rh"))
    box = c.withColumn("b", G.crop_norm(F.col("cx"), F.col("cy"), F.col("rw"), F.col("rh"), 512, 400))
    return box.select("id", *(F.col(f"b.{n}").cast("long").alias(n) for n in ("x0", "y0", "x1", "y1")), _r(G.crop_area(F.col("id") % 2 == 0, F.col("rw"), F.col("rh"))).alias("area"))


@_query(f"WITH {_PART} SELECT id, round(sqrt(power(nx * depth - 2.0 * 0, 2) + power(ny * depth, 2) + power(nz * depth - 2.0 / (1.0 + 1e-12), 2)) + 16.0 * acos(least(greatest(nz * (1.0 / (1.0 + 1e-12)), -1.0), 1.0)), 3) AS dist FROM un")
def pose_distance(spark, sf):
    d = G.pose_distance(G.vec(F.col("x"), F.col("y"), F.col("z")), F.col("depth"), G.vec(0, 0, 1), F.lit(2.0), 16.0)
    return _parts(spark, sf).select("id", _r(d, 3).alias("dist"))


def _corner_sql():
    a = [("0.0", "0.0"), ("10.0", "0.0"), ("0.0", "10.0")]
    b = [(f"({x} + id % 7)", f"({y} + id % 5)", "(id % 3)") for x, y in a]
    gap = lambda p, q: f"sqrt(power({p[0]} - {q[0]}, 2) + power({p[1]} - {q[1]}, 2) + power(0.0 - {q[2]}, 2))"
    there = " + ".join("least(" + ", ".join(gap(p, q) for q in b) + ")" for p in a)
    back = " + ".join("least(" + ", ".join(gap(p, q) for p in a) + ")" for q in b)
    return f"SELECT id, round((({there}) / 3 + ({back}) / 3) / 2 * 25.0, 5) AS corner_um FROM (SELECT p_partkey AS id FROM part)"


@_query(_corner_sql())
def corner_chamfer(spark, sf):
    i = F.col("id")
    a = [G.vec(0, 0, 0), G.vec(10, 0, 0), G.vec(0, 10, 0)]
    b = [G.vec(F.lit(x) + i % 7, F.lit(y) + i % 5, i % 3) for x, y in ((0.0, 0.0), (10.0, 0.0), (0.0, 10.0))]
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id")).select("id", _r(distance.corner_chamfer(a, b, 25.0), 5).alias("corner_um"))


def _lattice_sql(g=6):
    pts = lambda p: f"SELECT id, k, l, {p}"
    grid = f"range({g}) a(k), range({g}) b(l)"
    return f"""WITH s AS (SELECT p_partkey AS id, p_partkey % 9 * 1.0::DOUBLE AS d2 FROM part),
a AS ({pts(f"-15.5 + k * 31.0::DOUBLE / {g - 1} AS x, -15.5 + l * 31.0::DOUBLE / {g - 1} AS y, 0.0::DOUBLE AS z")} FROM s, {grid}),
b AS ({pts(f"-7.75 + k * 15.5::DOUBLE / {g - 1} AS x, -7.75 + l * 15.5::DOUBLE / {g - 1} AS y, d2 AS z")} FROM s, {grid}),
d AS (SELECT a.id, a.k AS ak, a.l AS al, b.k AS bk, b.l AS bl, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS dd FROM a JOIN b USING (id)),
f AS (SELECT id, list_sort(list(m)) AS ms FROM (SELECT id, ak, al, min(dd) AS m FROM d GROUP BY ALL) GROUP BY 1), r AS (SELECT id, list_sort(list(m)) AS ms FROM (SELECT id, bk, bl, min(dd) AS m FROM d GROUP BY ALL) GROUP BY 1)
SELECT f.id, round(list_avg(f.ms[1:{int(g * g * 0.9)}]) + list_avg(r.ms[1:{int(g * g * 0.9)}]), 6) AS dist FROM f JOIN r USING (id)"""


@_query(_lattice_sql())
def chamfer_lattice(spark, sf):
    def pose(depth, step):
        vals = {"nx": 0.0, "ny": 0.0, "nz": 1.0, "depth": depth, "rot": 0.0, "step": step, "size_px": 32, "x0": 0, "y0": 0, "h": 32, "w": 32}
        return F.struct(*((v if not isinstance(v, (int, float)) else F.lit(v)).cast("double").alias(k) for k, v in vals.items()))

    rows = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), pose(0.0, 1.0).alias("query_pose"), pose(F.col("p_partkey") % 9, 0.5).alias("patch_pose"))
    return distance.with_chamfer(rows, 6, 0.1).select("id", _r("dist").alias("dist"))


# ---------------------------------------------------------------- volumes and sources
@_query("WITH b AS (SELECT quantile_cont(l_extendedprice, 0.005) AS lo, quantile_cont(l_extendedprice, 0.995) AS hi FROM lineitem) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(least(greatest((l_extendedprice - lo) / (hi - lo), 0), 1), 6) AS v FROM lineitem, b")
def percentile_normalise(spark, sf):
    got = volume.percentile_normalise(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice")
    return got.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), _r("normalised").alias("v"))


@_query("SELECT count(*) AS n, round(count(*) FILTER (WHERE value > 50) / count(*), 6) AS fg_ratio, round(1 - count(*) FILTER (WHERE value > 50) / count(*), 6) AS bg_ratio FROM events")
def fg_bg_ratio(spark, sf):
    return volume.fg_bg_ratio(_t(spark, sf, "events"), F.col("value"), 50).select("n", _r("fg_ratio").alias("fg_ratio"), _r("bg_ratio").alias("bg_ratio"))


@_query("SELECT o_orderkey AS row_idx, 'a' || o_orderkey AS allen_path, (o_orderkey % 5)::DOUBLE AS v0, (o_orderkey % 30)::DOUBLE / 2 AS depth, CAST(o_orderkey % 2 AS BIGINT) AS is_crop, o_orderpriority AS priority FROM orders")
def dataset_parse(spark, sf):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    raw = _t(spark, sf, "orders").select(
        k.alias("row_idx"), F.concat(F.lit(" a"), s(k), F.lit(" ")).alias("allen_path"), F.lit("").alias("real_path"), F.concat(F.lit("["), s(k % 5), F.lit(", 0.5, 1]")).alias("vector"), s(k % 30 / 2).alias("depth"), F.lit("90").alias("rotation"),
        s(k % 2).alias("is_crop"), F.lit("full").alias("crop_bin"), F.lit("full").alias("crop_kind"), *(F.lit("0.5").alias(c) for c in ("crop_cx", "crop_cy", "crop_rw", "crop_rh", "crop_aspect_w", "crop_aspect_h")), F.col("o_orderpriority").alias("priority"),
    )
    return tables.parse_dataset(raw).select("row_idx", "allen_path", F.col("vector")[0].alias("v0"), "depth", F.col("is_crop").cast("long").alias("is_crop"), F.col("extra")["priority"].alias("priority"))


@_query()
def patch_index_build(spark, sf):
    plan = P.slice_plan(P.fibonacci_normals(spark, 8), (20, 20, 20), 6.0, 2.0)
    return volume.build_index(plan, P.patch_grid(spark, 64, (1, 2), 0.25), _volume(spark, sf)).drop("embedding")


# ---------------------------------------------------------------- compressed index, images, evaluation, training
@_query()
def knn_ivfpq(spark, sf):
    index = vector_index.build_index(_vectors(spark, sf), scratch(spark), "ivfpq")
    return _found(vector_index.search_index(index, _asked(spark, sf), 5, refine=8))


@_query(f"{_HITS} SELECT query_id, patch_id, round(CASE WHEN max(score) OVER w - min(score) OVER w < 1e-6 THEN 0.0 ELSE 0.7::DOUBLE * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END + 0.3::DOUBLE * (rank - 1) / {HITS_K - 1}, 5) AS blend, round(exp(score - max(score) OVER w) / (sum(exp(score)) OVER w / exp(max(score) OVER w) + 1e-12), 6) AS p FROM hits WINDOW w AS (PARTITION BY query_id)")
def blend_alpha(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id")
    mixed = N.blend(N.minmax(F.col("score"), w), (F.col("rank") - 1) / (HITS_K - 1), 0.3)
    return _hits(spark, sf).select("query_id", "patch_id", _r(mixed, 5).alias("blend"), _r(N.softmax(F.col("score"), w)).alias("p"))


@_query(f"{_HITS} SELECT query_id, patch_id, 'patches/' || lpad(CAST(patch_id AS VARCHAR), 8, '0') || '.png' AS path, CASE WHEN patch_id % 2 = 0 THEN 'own' ELSE 'other' END AS chosen FROM hits")
def patch_paths(spark, sf):
    own = F.when(F.col("patch_id") % 2 == 0, F.lit(" own ")).otherwise(F.lit("  "))
    return _hits(spark, sf).select("query_id", "patch_id", images.patch_path(F.col("patch_id")).alias("path"), images.first_path(F.lit(None).cast("string"), own, F.lit("other")).alias("chosen"))


@_query("""WITH px AS (SELECT vec_id AS image_id, i % 8 AS x, i // 8 AS y, CAST(embedding[i + 1] AS DOUBLE) > 0.05 AS fg FROM embeddings, range(64) t(i)),
b AS (SELECT k AS box_id, k % 3 AS x0, k // 2 AS y0, k % 3 + 4 AS x1, k // 2 + 3 AS y1 FROM range(6) t(k))
SELECT image_id, box_id, round(avg(CASE WHEN fg THEN 1.0 ELSE 0.0 END), 6) AS fg_ratio FROM px, b WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL""")
def fg_ratio_boxes(spark, sf):
    cells = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "value"))
    pixels = cells.select("image_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "value")
    box = lambda k: F.struct(F.lit(k).cast("long").alias("box_id"), F.lit(k % 3).alias("x0"), F.lit(k // 2).alias("y0"), F.lit(k % 3 + 4).alias("x1"), F.lit(k // 2 + 3).alias("y1"))
    boxes = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(F.array(*map(box, range(6)))).alias("b")).select("image_id", "b.*")
    return images.box_ratio(images.integral(pixels), boxes).withColumn("fg_ratio", _r("fg_ratio"))


@_query(f"{_HITS} SELECT row_idx, source, count(*) AS n FROM hits WHERE rank <= 20 AND patch_id % 3 <> 0 GROUP BY ALL HAVING count(*) >= 14")
def pool_min_candidates(spark, sf):
    pool = pools.build_pools(_hits(spark, sf), _vectors(spark, sf).filter("patch_id % 3 != 0"), 20, 14)
    return pools.pool_arrays(pool).select("row_idx", "source", F.size("members").cast("long").alias("n"))


@_query("SELECT p_partkey AS id, round(abs(x) / l * 9.5 + abs(y) / l * 14.5 + abs(z) / l * 19.5, 6) AS half, 31 - p_partkey % 32 AS mirrored FROM (SELECT p_partkey, x, y, z, sqrt(x * x + y * y + z * z) + 1e-12 AS l FROM (SELECT p_partkey, p_partkey % 17 - 8.0::DOUBLE AS x, p_partkey % 13 - 6.0::DOUBLE AS y, p_partkey % 11 - 4.5::DOUBLE AS z FROM part))")
def depth_bounds(spark, sf):
    half = G.depth_bounds(G.vec(F.col("x"), F.col("y"), F.col("z")), (20, 30, 40))
    return _parts(spark, sf).select("id", _r(half).alias("half"), G.mirror_x(F.col("id") % 32, 32).cast("long").alias("mirrored"))


@_query("""WITH s AS (SELECT unnest([-1, 1]) AS s), raw AS (
  SELECT k AS normal_idx, CASE k WHEN 0 THEN 1 ELSE 0 END AS x, CASE k WHEN 1 THEN 1 ELSE 0 END AS y, CASE k WHEN 2 THEN 1 ELSE 0 END AS z FROM range(3) t(k)
  UNION ALL SELECT 3 + ((a.s + 1) // 2 * 2 + (b.s + 1) // 2) * 3 + k, CASE k WHEN 2 THEN 0 ELSE a.s END, CASE k WHEN 0 THEN b.s WHEN 1 THEN 0 ELSE a.s END, CASE k WHEN 0 THEN 0 ELSE b.s END FROM s a, s b, range(3) t(k)
  UNION ALL SELECT 15 + (a.s + 1) // 2 * 4 + (b.s + 1) // 2 * 2 + (c.s + 1) // 2, a.s, b.s, c.s FROM s a, s b, s c)
SELECT s_suppkey, CAST(normal_idx AS BIGINT) AS normal_idx, round(x / sqrt(x * x + y * y + z * z), 6) AS nx, round(y / sqrt(x * x + y * y + z * z), 6) AS ny, round(z / sqrt(x * x + y * y + z * z), 6) AS nz FROM supplier JOIN raw ON normal_idx = s_suppkey % 23""")
def axis_normals(spark, sf):
    """Each supplier's of the 23 directions."""
    every = P.axis_normals(spark, diagonals=True).withColumn("normal_idx", F.col("normal_idx").cast("long"))
    own = _t(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 23).alias("normal_idx"))
    return own.join(F.broadcast(every), "normal_idx").select("s_suppkey", "normal_idx", *(_r(c).alias(c) for c in ("nx", "ny", "nz")))


def _counted(spark, sf):
    """How many line items fall into each of 16 x 16 x 16 cells by their keys; 4096 counts reach the driver."""
    cell = sum(F.pmod(F.col(c), F.lit(16)) * w for c, w in (("l_orderkey", 256), ("l_partkey", 16), ("l_suppkey", 1)))
    found = np.zeros(4096)
    for r in _t(spark, sf, "lineitem").groupBy(cell.cast("int").alias("cell")).agg(F.count("*").alias("n")).collect():
        found[r.cell] = r.n
    return found.reshape(16, 16, 16)


def _volume(spark, sf):
    """The counts as a volume of 32 x 32 x 32 voxels."""
    return volume.normalise(np.kron(_counted(spark, sf), np.ones((2, 2, 2))))


@_query()
def dataset_build(spark, sf):
    return builder.build_dataset(builder.valid_planes(spark, 3, _volume(spark, sf), 32, 1.0))


def _evaluated(spark, sf):
    v = _volume(spark, sf)
    index = written(volume.build_index(P.slice_plan(P.fibonacci_normals(spark, 12), (32, 32, 32), 5.0, 2.0), P.patch_grid(spark, 32, (1, 2), 0.25), v, size=32, step=1.0))
    rows = written(builder.build_dataset(builder.valid_planes(spark, 3, v, 32, 1.0)).withColumn("vector", F.array("nx", "ny", "nz")))
    cfg = evaluate.EvalConfig(size_px=32, flip_y=False, local="auto", final_k=20, grid=8)
    return rows, {"plain": v}, index, cfg, evaluate.evaluate(rows, {"plain": v}, index, volume.pooled_encoder(), cfg)


@_query()
def evaluate_hits(spark, sf):
    return _evaluated(spark, sf)[4]


@_query()
def train_reranker(spark, sf):
    """The re-ranker fitted on the hits of the fused search, over the embeddings; losses of all lists."""
    cfg, vectors = rerank.RerankerConfig(dim=DIM, hidden=(16, 8), epochs=3), _vectors(spark, sf).select("patch_id", "emb")
    hits = written(_hits(spark, sf).select("row_idx", "source", "patch_id", "rank", "dist"))
    queries = hits.select("row_idx", "source").distinct().join(vectors.withColumnRenamed("patch_id", "row_idx"), "row_idx")
    splits = written(training.prepare(hits, vectors, cfg)[1])
    draw = lambda epoch: training.training_lists(training.prepare(hits, vectors, cfg, epoch=epoch)[0], queries, vectors)
    weights, _ = training.fit(draw, splits, cfg)
    return training.list_losses(draw(0), weights, cfg).join(splits, "row_idx")


def _orientation_sql():
    perms = [f"[{a}, {b}, {3 - a - b}]" for a in range(3) for b in range(3) if a != b]
    at = lambda j: f"CASE WHEN f[{j}] = 1 THEN s[p[{j}] + 1] - 1 - a[p[{j}] + 1] ELSE a[p[{j}] + 1] END"
    return f"""WITH v AS (SELECT vec_id AS z, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i)),
o AS (SELECT p, [a, b, c] AS f FROM (SELECT unnest([{", ".join(perms)}]) AS p), range(2) x(a), range(2) y(b), range(2) z(c)),
m AS (SELECT [7 - y, z, x] AS a, [8, (SELECT max(vec_id) + 1 FROM embeddings), 8] AS s, value FROM v),
t AS (SELECT p, f, {at(1)} AS z, {at(2)} AS y, {at(3)} AS x, m.value AS b FROM m, o)
SELECT array_to_string(p, '') AS perm, array_to_string(f, '') AS flips, round(corr(v.value, b), 6) AS corr, count(*) AS n FROM t JOIN v USING (z, y, x) WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0 GROUP BY ALL"""


@_query(_orientation_sql())
def best_orientation(spark, sf):
    """The embeddings as a volume of a plane of 8 x 8 voxels each, against its own transposed and mirrored copy."""
    rows = _t(spark, sf, "embeddings")
    many = rows.agg(F.max("vec_id") + 1).first()[0]
    cells = rows.select(F.col("vec_id").alias("z"), F.posexplode("embedding").alias("i", "value")).select("z", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), "value")
    moved = grids.oriented(cells, (many, 8, 8), (1, 0, 2), (True, False, False))
    found = grids.orientation_scores(cells, moved, (many, 8, 8), (8, many, 8), 2)
    return found.select(F.array_join(F.col("perm").cast("array<string>"), "").alias("perm"), F.array_join(F.transform("flips", lambda f: f.cast("int").cast("string")), "").alias("flips"), _r("corr").alias("corr"), "n")


@_query("SELECT o_orderkey AS row_idx, o_totalprice FROM orders ORDER BY ((42 * 31 + o_orderkey) % 4294967296 * 2654435761) % 4294967296, o_orderkey LIMIT 25")
def row_sample(spark, sf):
    return images.sample_rows(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("row_idx"), "o_totalprice"), 25)


@_query()
def slice_foreground(spark, sf):
    counts = np.kron(_counted(spark, sf), np.ones((2, 2, 2)))
    labels = (counts > np.median(counts)).astype("int32")
    return registration.slice_statistics(registration.slice_foreground(spark, labels, 40, 32))


@_query("SELECT vec_id AS image_id, 8 AS height, 8 AS width, round(sum(round_even(least(greatest(v, 0), 1) * 255, 0)) / 255, 6) AS total FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) GROUP BY 1")
def image_files(spark, sf):
    """Embeddings as 8 x 8 images, encoded as PNG, stored in the shared folder and read back."""
    rows = _t(spark, sf, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(".png")).alias("name"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").cast("array<double>").alias("pixels"))
    back = png.decode_images(written(png.encode_images(rows)))
    total = F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x)
    return back.select(F.regexp_extract("name", r"(\d+)\.png$", 1).cast("long").alias("image_id"), "height", "width", F.round(total, 6).alias("total"))

"""Registered queries of single parts of the library - plans, images, labels, pools, sources - and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxelrank.catalog import _FIB, _HITS, DIM, THRESHOLDS, _hits, _labelled, _manifest, _many, _r, _t, _vectors
from voxelrank.functions import vectors as V
from voxelrank.operators import fusion, images, metrics, pools, volume
from voxelrank.plans import generators as P
from voxelrank.session import scratch
from voxelrank.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- plans
@_query(f"""WITH t AS (SELECT i, 1 - 2 * (i + 0.5::DOUBLE) / (SELECT count(*) FROM embeddings) AS z, 2 * pi() * (i + 0.5::DOUBLE) / {P.GOLDEN!r}::DOUBLE AS th FROM range((SELECT count(*) FROM embeddings)) r(i))
SELECT i AS normal_idx, round(sqrt(1 - z * z) * cos(th), 6) AS nx, round(sqrt(1 - z * z) * sin(th), 6) AS ny, round(z, 6) + 0.0 AS nz FROM t""")
def all_normals(spark, sf):
    """Directions without the removal of equal ones."""
    return P.fibonacci_normals(spark, _many(spark, sf), distinct=False).select("normal_idx", *((_r(c) + F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")))


@_query(f"""WITH {_FIB}, s AS (SELECT CAST(sum((CAST(floor((2 * hd - 2) / 2.5::DOUBLE) AS BIGINT) + 1) * 3) AS BIGINT) AS n FROM half),
g AS (SELECT scale, CAST(round_even(512.0::DOUBLE / scale, 0) AS BIGINT) AS w FROM (VALUES (1), (2), (4)) t(scale)),
h AS (SELECT scale, (512 - w) // greatest(1, CAST(round_even(w * 0.75::DOUBLE, 0) AS BIGINT)) + 1 AS k FROM g)
SELECT CAST(scale AS BIGINT) AS scale, CAST(k * k AS BIGINT) AS per_slice, CAST(k * k * n AS BIGINT) AS n_patches FROM h, s""")
def patch_count(spark, sf):
    slices = P.slice_count(P.fibonacci_normals(spark, _many(spark, sf)), (20, 30, 40), 2.5, 1.0, 3)
    return P.patch_count(slices, P.patch_grid(spark, 512, (1, 2, 4), 0.25)).withColumn("scale", F.col("scale").cast("long"))


@_query("""WITH im AS (SELECT o_orderkey AS image_id, o_orderkey % 700 + 200 AS w, o_orderkey % 300 + 150 AS h FROM orders), a AS (SELECT *, least(w, h) AS s, greatest(w, h) AS l FROM im WHERE w <> h),
b AS (SELECT *, greatest(1, CAST(round_even(s * 0.5::DOUBLE, 0) AS BIGINT)) AS step, CAST(round_even(s / 2.0::DOUBLE, 0) AS BIGINT) AS g FROM a),
c AS (SELECT *, list_sort(list_distinct(list_append(range(0, l - s + 1, step), l - s))) AS st, list_sort(list_distinct(list_append(range(0, s - g + 1, greatest(1, CAST(round_even(g * 0.5::DOUBLE, 0) AS BIGINT))), s - g))) AS gr FROM b),
d AS (SELECT *, CASE WHEN len(st) <= 8 THEN st ELSE list_sort(list_distinct([st[CAST(round_even(i * (len(st) - 1) / 7.0::DOUBLE, 0) AS BIGINT) + 1] FOR i IN range(8)])) END AS p FROM c),
e AS (SELECT image_id, k - 1 AS crop_id, CASE WHEN w > h THEN p[k] ELSE 0 END AS x0, CASE WHEN w > h THEN 0 ELSE p[k] END AS y0, s AS side FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM d)
  UNION ALL SELECT image_id, len(p) + (y - 1) * len(gr) + x - 1, gr[x], gr[y], g FROM (SELECT *, unnest(range(1, len(gr) + 1)) AS x FROM (SELECT *, unnest(range(1, len(gr) + 1)) AS y FROM d))),
f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY crop_id) - 1 AS n FROM e WHERE side >= 64)
SELECT image_id, n AS crop_id, x0, y0, x0 + side AS x1, y0 + side AS y1 FROM f WHERE n < 8""")
def forced_crop_boxes(spark, sf):
    """Local windows where they are forced: slid along the long axis, then a grid over the top-left square."""
    sides = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % 700 + 200).cast("int").alias("width"), (F.col("o_orderkey") % 300 + 150).cast("int").alias("height"))
    got = P.local_crops(sides.filter("width != height"), mode="force")
    return got.select(*(F.col(c).cast("long").alias(c) for c in got.columns))


# ---------------------------------------------------------------- vectors, pools, metrics
@_query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings), w AS (SELECT vec_id, q, list_reverse(q) AS c FROM v)
SELECT vec_id, {4 * DIM + 3} AS n, round(list_sum([abs(q[i] - c[i]) FOR i IN range(1, {DIM + 1})]), 6) AS gaps, round(list_inner_product(q, c), 6) AS products, round(list_cosine_similarity(q, c), 6) AS cos, round(sqrt(list_inner_product(c, c)), 6) AS c_norm FROM w""")
def pair_features(spark, sf):
    f = V.pair_features(F.col("emb"), F.reverse("emb"))
    total = lambda part: F.aggregate(F.slice("f", part * DIM + 1, DIM), F.lit(0.0), lambda s, x: s + x)
    rows = _vectors(spark, sf).select(F.col("patch_id").alias("vec_id"), f.alias("f"))
    return rows.select("vec_id", F.size("f").cast("long").alias("n"), _r(total(2)).alias("gaps"), _r(total(3)).alias("products"), _r(F.col("f")[4 * DIM]).alias("cos"), _r(F.col("f")[4 * DIM + 2]).alias("c_norm"))


@_query(f"""{_HITS} SELECT row_idx, source, patch_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY row_idx, source ORDER BY ((((3 * 31 + row_idx) % 4294967296) * 31 + patch_id) % 4294967296 * 2654435761) % 4294967296, patch_id) AS p FROM hits) WHERE p <= 12""")
def uniform_sample(spark, sf):
    return pools.uniform_sample(_hits(spark, sf).select("row_idx", "source", "patch_id", "rank"), 12, seed=3)


_ODD = "odd AS (SELECT row_idx, source, rank, CASE WHEN (rank + row_idx) % 5 = 0 THEN NULL WHEN row_idx % 75 = 0 OR (rank + row_idx) % 7 < 2 THEN NULL ELSE dist END AS d FROM hits)"


@_query(f"{_HITS}, {_ODD} SELECT row_idx, source, round(min(d) FILTER (WHERE rank <= 1), 6) AS geom_at_1, round(min(d) FILTER (WHERE rank <= 10), 6) AS geom_at_10, first(rank ORDER BY d, rank) FILTER (WHERE d IS NOT NULL) AS rank_best FROM odd GROUP BY 1, 2")
def finite_distances(spark, sf):
    """Metrics over distances that are null, NaN or infinite here and there, and in some queries everywhere."""
    at = F.col("rank") + F.col("row_idx")
    odd = F.when(at % 5 == 0, F.lit(None)).when(at % 7 == 0, F.lit(float("nan"))).when((at % 7 == 1) | (F.col("row_idx") % 75 == 0), F.lit(float("inf"))).otherwise(F.col("dist"))
    hits = _hits(spark, sf).withColumn("dist", odd)
    both = metrics.geom_at_k(hits, (1, 10)).join(metrics.rank_best(hits), list(metrics.KEY))
    return both.select("row_idx", "source", _r("geom_at_1").alias("geom_at_1"), _r("geom_at_10").alias("geom_at_10"), "rank_best")


@_query(f"""{_HITS}, t AS (SELECT *, CASE WHEN row_idx % 50 = 0 THEN 0.75::DOUBLE ELSE greatest(quantile_cont(dist, 0.5) OVER (PARTITION BY row_idx, source), 1e-6) END AS tau FROM hits),
g AS (SELECT *, exp(-dist / tau) AS gain, row_number() OVER (PARTITION BY row_idx, source ORDER BY dist, rank) AS ideal FROM t)
SELECT row_idx, source, round(sum(gain / log2(rank + 1)) FILTER (WHERE rank <= 10) / sum(gain / log2(ideal + 1)) FILTER (WHERE ideal <= 10), 6) AS ndcg_10 FROM g GROUP BY 1, 2""")
def ndcg_given_tau(spark, sf):
    """Every second query brings its temperature, from its third hit on; the first one found counts."""
    given = F.when((F.col("row_idx") % 50 == 0) & (F.col("rank") >= 3), F.lit(0.75) + (F.col("rank") - 3))
    return metrics.ndcg(_hits(spark, sf).withColumn("tau", given), (10,)).select("row_idx", "source", _r("ndcg_10").alias("ndcg_10"))


@_query(f"""{_HITS}, per AS (SELECT row_idx, min(dist) FILTER (WHERE rank = 1) AS a, min(dist) FILTER (WHERE rank = 2) AS b, coalesce(max(CASE WHEN dist <= {THRESHOLDS[0]} AND rank = 1 THEN 1.0 ELSE 0.0 END), 0) AS sa, coalesce(max(CASE WHEN dist <= {THRESHOLDS[0]} AND rank = 2 THEN 1.0 ELSE 0.0 END), 0) AS sb FROM hits GROUP BY 1),
m AS (SELECT 'Geom@1 mean' AS metric, round(avg(a), 9) AS x, round(avg(b), 9) AS y FROM per UNION ALL SELECT 'SR@10(t0) mean', round(avg(sa), 9), round(avg(sb), 9) FROM per)
SELECT metric, concat_ws(',', CASE WHEN x = CASE WHEN metric LIKE 'Geom%' THEN least(x, y) ELSE greatest(x, y) END THEN 'first' END, CASE WHEN y = CASE WHEN metric LIKE 'Geom%' THEN least(x, y) ELSE greatest(x, y) END THEN 'second' END) AS best FROM m""")
def best_marks(spark, sf):
    hits = _labelled(spark, sf)
    run = lambda r: metrics.report_metrics(hits.filter(F.col("rank") == r).withColumn("rank", F.lit(1).cast("long")), THRESHOLDS).filter("group = 'ALL' AND source = 'ALL' AND metric IN ('Geom@1 mean', 'SR@10(t0) mean')").withColumn("value", F.round("value", 9))
    return metrics.mark_best(metrics.compare_runs({"first": run(1), "second": run(2)}), ["first", "second"]).select("metric", "best")


# ---------------------------------------------------------------- images and labels
@_query("""WITH im AS (SELECT vec_id, [least(greatest(x, 0), 1) FOR x IN CAST(embedding AS DOUBLE[])] AS e FROM embeddings),
px AS (SELECT vec_id, k, f, i, j, CASE WHEN f = 1 THEN 7 - j ELSE j END AS c, e FROM im, range(4) a(k), range(2) b(f), range(8) y(i), range(8) x(j)),
seen AS (SELECT vec_id, k * 2 + f AS view_idx, i * 8 + j AS p, e[CASE k WHEN 0 THEN i * 8 + c WHEN 1 THEN c * 8 + 7 - i WHEN 2 THEN (7 - i) * 8 + 7 - c ELSE (7 - c) * 8 + i END + 1] AS v FROM px)
SELECT vec_id AS query_id, CAST(view_idx AS BIGINT) AS view_idx, 'global' AS branch, round(sum((p + 1) * v), 5) AS checksum FROM seen GROUP BY ALL""")
def turned_images(spark, sf):
    """Embeddings as 8 x 8 images in eight views each; the checksum tells every pixel's place."""
    shown = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").cast("array<double>").alias("pixels"))
    views = images.embed_views(shown, P.view_grid(spark), np.ravel, auto_crop=False)
    return views.select("query_id", F.col("view_idx").cast("long").alias("view_idx"), "branch", _r(_placed("emb"), 5).alias("checksum"))


def _placed(c):
    return F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)


@_query("""WITH px AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, least(greatest(CAST(embedding[i + 1] AS DOUBLE), 0), 1) AS v FROM embeddings, range(64) t(i)),
b AS (SELECT vec_id, avg(CASE WHEN v > 0.05 THEN 1.0 ELSE 0.0 END) AS share, min(r) FILTER (WHERE v > 0.05) AS r0, max(r) FILTER (WHERE v > 0.05) AS r1, min(c) FILTER (WHERE v > 0.05) AS c0, max(c) FILTER (WHERE v > 0.05) AS c1 FROM px WHERE r >= 2 AND c <= 4 GROUP BY 1),
k AS (SELECT vec_id, CASE WHEN share >= 0.05 THEN r0 ELSE 2 END AS r0, CASE WHEN share >= 0.05 THEN r1 ELSE 7 END AS r1, CASE WHEN share >= 0.05 THEN c0 ELSE 0 END AS c0, CASE WHEN share >= 0.05 THEN c1 ELSE 4 END AS c1 FROM b),
s AS (SELECT *, greatest(r1 - r0, c1 - c0) + 1 AS side FROM k)
SELECT vec_id AS query_id, CAST(any_value(side) AS BIGINT) AS side, round(sum(v * ((r - r0 + (side - (r1 - r0 + 1)) // 2) * side + c - c0 + (side - (c1 - c0 + 1)) // 2 + 1)), 5) AS checksum
FROM px JOIN s USING (vec_id) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 GROUP BY 1""")
def cropped_images(spark, sf):
    """Rows 2 to 7 and columns 0 to 4 of the 8 x 8 images, cut to their foreground and padded to a square."""
    kept = F.filter(F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when((i >= 16) & (i % 8 <= 4), x)), lambda x: x.isNotNull())
    shown = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.lit(6).alias("height"), F.lit(5).alias("width"), kept.alias("pixels"))
    views = images.embed_views(shown, P.view_grid(spark, (0,), flip_x=False), np.ravel)
    return views.select("query_id", F.sqrt(F.size("emb")).cast("long").alias("side"), _r(_placed("emb"), 5).alias("checksum"))


@_query("""WITH s AS (SELECT d, r, a, b FROM range(11) x(d), range(2) y(r), range(11) i(a), range(11) j(b)),
l AS (SELECT d, r, CASE WHEN d NOT BETWEEN 1 AND 9 OR a NOT BETWEEN 1 AND 9 OR b NOT BETWEEN 1 AND 9 THEN 0 ELSE ((d - 1) * (d - 1) + (a - 1) * 2 + (b - 1) * (d - 1)) % 5 + 1 END AS label FROM s)
SELECT 0::BIGINT AS normal_idx, d AS depth_idx, r AS rot_idx, label::BIGINT AS label, count(*) AS n FROM l WHERE d BETWEEN 1 AND 8 GROUP BY ALL""")
def label_slices(spark, sf):
    """Labels on slices across the z axis of a 9-cubed annotation volume, whole and turned by 90 degrees, with one pixel around it; a quarter voxel from either end, eight slices fit."""
    z, y, x = np.meshgrid(*(np.arange(9),) * 3, indexing="ij")
    normal = spark.range(1).select(F.lit(0).cast("long").alias("normal_idx"), *(F.lit(v).alias(c) for c, v in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))))
    plan = P.slice_plan(normal, (9, 9, 9), 1.0, 0.25, (0.0, 90.0))
    return volume.label_counts(plan, (z * z + x * 2 + y * z) % 5 + 1, 11, 1.0).withColumn("depth_idx", F.col("depth_idx") + 1)


# ---------------------------------------------------------------- sources
@_query("SELECT vec_id AS patch_id, vec_id % 8 AS normal_idx, CAST(CASE vec_id % 3 WHEN 0 THEN 1 ELSE 2 END AS BIGINT) AS scale, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings WHERE vec_id % 3 < 2")
def index_files(spark, sf):
    """Manifest and vectors written by scale, read again for two of the three scales."""
    place = scratch(spark)
    tables.write_index(_manifest(spark, sf).join(_vectors(spark, sf).drop("label"), "patch_id"), place)
    few = fusion.scale_filter(tables.read_manifest(spark, place), (1, 2))
    total = F.aggregate("emb", F.lit(0.0), lambda s, x: s + x)
    return few.select("patch_id", "normal_idx", F.col("scale").cast("long").alias("scale"), _r(total).alias("total"))


@_query(f"{_HITS} SELECT row_idx, source, rank, round(dist, 6) AS dist, CASE WHEN source = 'real' THEN 'late' END AS note FROM hits")
def hit_files(spark, sf):
    """Hits appended in two goes, the second with a column more, read with the merged header."""
    place = scratch(spark)
    hits = _hits(spark, sf).select("row_idx", "source", "rank", F.col("dist").alias("geom_dist_vox"))
    tables.append_hits(hits.filter("source = 'allen'"), place)
    tables.append_hits(hits.filter("source = 'real'").withColumn("note", F.lit("late")), place)
    return tables.read_hits(spark, place).select("row_idx", "source", "rank", _r("geom_dist_vox").alias("dist"), "note")


@_query("SELECT o_orderkey AS row_idx, 'a' || o_orderkey AS allen_path, round(o_orderkey % 7 / 8.0::DOUBLE, 6) AS v1, (o_orderkey % 30)::DOUBLE / 2 AS depth, CASE WHEN o_orderkey % 2 = 0 THEN 'wide, \"1\"' END AS crop_kind FROM orders")
def dataset_files(spark, sf):
    """Dataset rows written as CSV and parsed again: vectors, quotes and commas, empty fields."""
    place, k = scratch(spark), F.col("o_orderkey")
    numbers = {"rotation": 90.0, "is_crop": 1, **{c: 0.5 for c in ("crop_cx", "crop_cy", "crop_rw", "crop_rh", "crop_aspect_w", "crop_aspect_h")}}
    rows = _t(spark, sf, "orders").select(
        k.alias("row_idx"), F.concat(F.lit("a"), k.cast("string")).alias("allen_path"), F.array(F.lit(0.5), k % 7 / 8, F.lit(1.0)).alias("vector"), (k % 30 / 2).alias("depth"),
        F.when(k % 2 == 0, 'wide, "1"').alias("crop_kind"), F.lit("full").alias("crop_bin"), *(F.lit(v).alias(c) for c, v in numbers.items()),
    )
    tables.write_dataset(rows, place)
    return tables.read_dataset(spark, place).select("row_idx", "allen_path", _r(F.col("vector")[1]).alias("v1"), "depth", "crop_kind")

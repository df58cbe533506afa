"""Retrieval metrics over ranked hits with geometric distances.

Input rows: the query key columns, ``rank`` from 1, ``dist`` (null, NaN or infinite where missing)
and optionally ``tau``.  One window over the query key serves all metrics of a call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelrank.functions.numbers import finite

KEY = ("row_idx", "source")
KS, DEEP_KS, MRR_DEPTH, LEAST_TAU = (1, 5, 10, 100), (10, 100), 100, 1e-6
DEFAULT_THRESHOLDS = (50.0, 100.0, 200.0)


def _distance() -> Column:
    return finite(F.col("dist"))


def _geom(ks: Sequence[int]) -> list[Column]:
    return [F.min(F.when(F.col("rank") <= k, _distance())).alias(f"geom_at_{k}") for k in ks]


def _rank_best() -> Column:
    return F.min(F.when(_distance().isNotNull(), F.struct(_distance(), "rank")))["rank"].alias("rank_best")


def _success(thresholds: Sequence[float], ks: Sequence[int]) -> list[Column]:
    hit = lambda t, k: F.max(F.when((_distance() <= t) & (F.col("rank") <= k), 1.0).otherwise(0.0))
    return [hit(t, k).alias(f"sr_{k}_{i}") for i, t in enumerate(thresholds) for k in ks]


def _reciprocal(thresholds: Sequence[float], depth: int) -> list[Column]:
    first = lambda t: F.min(F.when((_distance() <= t) & (F.col("rank") <= depth), F.col("rank")))
    return [F.coalesce(1 / first(t), F.lit(0.0)).alias(f"rr_{i}") for i, t in enumerate(thresholds)]


def _with_gain(hits: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds ``_gain`` and ``_ideal``, the place in the ideal order; one window partitioning that an aggregation by the key goes on to use."""
    q, d = Window.partitionBy(*key), _distance()
    given = F.min(F.when(F.col("tau").isNotNull(), F.struct("rank", "tau"))).over(q)["tau"] if "tau" in hits.columns else F.lit(None).cast("double")
    tau = F.greatest(F.coalesce(given, F.percentile(d, F.lit(0.5)).over(q)), F.lit(LEAST_TAU))
    based = hits.withColumn("_tau", tau).withColumn("_d", d)
    ideal = F.row_number().over(q.orderBy(F.asc_nulls_last("_d"), "rank"))
    return based.withColumn("_gain", F.when(F.col("_d").isNotNull(), F.exp(-F.col("_d") / F.col("_tau"))).otherwise(0.0)).withColumn("_ideal", ideal)


def _ndcg(ks: Sequence[int]) -> list[Column]:
    at = lambda where, k: F.sum(F.when(F.col(where) <= k, F.col("_gain") / F.log2(F.col(where) + 1)))
    one = lambda k: F.when(F.max(F.when(F.col("rank") <= k, F.col("_d"))).isNull(), F.lit(None)).when(at("_ideal", k) <= 0, 0.0).otherwise(at("rank", k) / at("_ideal", k))
    return [one(k).cast("double").alias(f"ndcg_{k}") for k in ks]


def geom_at_k(hits: DataFrame, ks: Sequence[int] = KS, key: Sequence[str] = KEY) -> DataFrame:
    """Per query: least finite distance among the first K ranks (null if none), one column for each K."""
    return hits.groupBy(*key).agg(*_geom(ks))


def rank_best(hits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per query: rank of the least finite distance, the first on ties."""
    return hits.groupBy(*key).agg(_rank_best())


def success(hits: DataFrame, thresholds: Sequence[float], ks: Sequence[int] = DEEP_KS, key: Sequence[str] = KEY) -> DataFrame:
    """Per query: 1.0 if a hit among the first K is within a threshold, else 0.0."""
    return hits.groupBy(*key).agg(*_success(thresholds, ks))


def reciprocal_rank(hits: DataFrame, thresholds: Sequence[float], depth: int = MRR_DEPTH, key: Sequence[str] = KEY) -> DataFrame:
    """Per query: 1 / first rank within a threshold, 0 if there is none down to ``depth``."""
    return hits.groupBy(*key).agg(*_reciprocal(thresholds, depth))


def ndcg(hits: DataFrame, ks: Sequence[int] = DEEP_KS, key: Sequence[str] = KEY) -> DataFrame:
    """Per query: NDCG with gain exp(-d / tau) and the ideal order taken over the whole list.

    tau is the query's first, else its median finite distance, at least LEAST_TAU.  Null where no
    hit among the first K, or none at all, has a finite distance; 0 where the ideal gain is 0.
    """
    return _with_gain(hits, key).groupBy(*key).agg(*_ndcg(ks))


def thresholds_of(hits: DataFrame, least: float = 1e-6) -> DataFrame:
    """``t25, t50, t75``: quartiles of the finite distances at rank 1, at least ``least``; the defaults if there are none."""
    d = finite(F.col("dist"))
    three = hits.filter(F.col("rank") == 1).agg(F.percentile(d, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    return three.select(*(F.when(F.col("p").isNotNull(), F.greatest(F.get("p", F.lit(i)), F.lit(least))).otherwise(F.lit(x)).alias(n) for i, (n, x) in enumerate(zip(("t25", "t50", "t75"), DEFAULT_THRESHOLDS))))


def group_labels(columns: Sequence[str]) -> Column:
    """Array of the grouping labels of a row: ALL, FULL or CROP, CROP_KIND=..., SEARCH_MODE=...

    The families overlap, so a row carries each of its labels.
    """
    labels = [F.array(F.lit("ALL"))]
    if "q_is_crop" in columns:
        labels.append(F.array(F.when(F.col("q_is_crop"), "CROP").otherwise("FULL")))
    for name, title in (("q_crop_kind", "CROP_KIND"), ("search_mode", "SEARCH_MODE")):
        if name in columns:
            labels.append(F.when(F.col(name).isNotNull(), F.array(F.concat(F.lit(f"{title}="), F.col(name)))).otherwise(F.array().cast("array<string>")))
    return F.concat(*labels)


def report_metrics(hits: DataFrame, thresholds: Sequence[float] = DEFAULT_THRESHOLDS, ks: Sequence[int] = KS, deep: Sequence[int] = DEEP_KS, key: Sequence[str] = KEY) -> DataFrame:
    """Tidy rows ``group, source, metric, value, n_queries`` for all label groups and sources (and ALL).

    ``hits`` is shuffled once, by the query key; window and aggregation share that partitioning.
    """
    labels = [c for c in ("q_is_crop", "q_crop_kind", "search_mode") if c in hits.columns]
    extra = [c for c in ("eval_sig",) if c in hits.columns and c not in key]
    key = [*key, *extra]
    firsts = [F.min_by(c, "rank").alias(c) for c in labels]
    per = _with_gain(hits, key).groupBy(*key).agg(*_geom(ks), _rank_best(), *_success(thresholds, deep), *_reciprocal(thresholds, MRR_DEPTH), *_ndcg(deep), *firsts)
    values = [*((f"Geom@{k}", f"geom_at_{k}") for k in ks), ("RankBestGeom", "rank_best"), *((f"SR@{k}(t{i})", f"sr_{k}_{i}") for i in range(len(thresholds)) for k in deep), *((f"MRR(t{i})", f"rr_{i}") for i in range(len(thresholds))), *((f"NDCG@{k}", f"ndcg_{k}") for k in deep)]
    groups = per.withColumn("group", F.explode(group_labels(per.columns)))
    groups = groups.withColumn("source", F.explode(F.array(F.lit("ALL"), F.col("source")))) if "source" in key else groups.withColumn("source", F.lit("ALL"))
    means = [F.avg(c).alias(f"m_{c}") for _, c in values]
    medians = [F.median(c).alias(f"d_{c}") for n, c in values if not n.startswith(("SR", "MRR"))]
    wide = groups.groupBy("group", "source").agg(F.count("*").alias("n_queries"), *means, *medians)
    pairs = [(f"{n} mean", f"m_{c}") for n, c in values] + [(f"{n} median", f"d_{c}") for n, c in values if not n.startswith(("SR", "MRR"))]
    tall = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in pairs)))
    return wide.select("group", "source", tall.alias("x"), "n_queries").select("group", "source", "x.metric", "x.value", "n_queries")


def compare_runs(runs: dict[str, DataFrame], baseline: str | None = None) -> DataFrame:
    """Full outer join of tidy metric tables on (group, source, metric): one value column for each run, and deltas to the baseline."""
    names = list(runs)
    baseline = baseline or names[0]
    names = [baseline, *(n for n in names if n != baseline)]
    joined = None
    for n in names:
        one = runs[n].select("group", "source", "metric", F.col("value").alias(n))
        joined = one if joined is None else joined.join(one, ["group", "source", "metric"], "full_outer")
    for n in names[1:]:
        joined = joined.withColumn(f"delta_{n}", F.col(n) - F.col(baseline))
    return joined


def mark_best(report: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Adds ``best``: names of the runs with the best value of a row; distances and ranks are better when low."""
    low = F.col("metric").rlike("^(Geom|RankBest)")
    best = F.when(low, F.least(*runs)).otherwise(F.greatest(*runs)) if len(runs) > 1 else F.col(runs[0])
    return report.withColumn("best", F.concat_ws(",", *(F.when(F.col(r) == best, F.lit(r)) for r in runs)))


def named_runs(paths: Sequence[str], labels: Sequence[str] | None = None) -> dict[str, str]:
    """Labels of runs: given ones, else the last part of the path; repeated ones get _2, _3, ..."""
    if labels is not None and len(labels) != len(paths):
        raise ValueError("one label for each path")
    out: dict[str, str] = {}
    for i, p in enumerate(paths):
        name = base = labels[i] if labels else p.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        k = 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out[name] = p
    return out


def running_stats(hits: DataFrame, key: Sequence[str] = ("row_idx",)) -> DataFrame:
    """Averages by row, then over rows: ``avg_top1, avg_dist1, n_rows``."""
    first = hits.filter(F.col("rank") == 1).groupBy(*key).agg(F.avg("score").alias("s"), F.avg(finite(F.col("dist"))).alias("d"))
    return first.agg(F.avg("s").alias("avg_top1"), F.avg("d").alias("avg_dist1"), F.count("*").alias("n_rows"))

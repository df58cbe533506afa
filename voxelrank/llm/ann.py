"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

Vectors are scaled to length 1 and turned by a random rotation, so that the first columns of a
vector are a fair sample of it.  K-means lists are fitted on a bounded sample; where the table asks
for more lists than the sample can fit, each is divided by a codebook of residuals, so that lists
grow with the square root of the table.  Every vector is assigned.  Each probed list is scanned in
blocks of columns: after each block a hypothesis test on the partial distance abandons the
candidates that are almost surely beyond the query's current k-th nearest.  Survivors are scored
exactly on the original vectors.  Queries whose lists held too few go through all lists.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelrank.llm.common import materialise

K = 5
#: Vectors that fit the lists at most, lists fitted at most, parts of a list at most, queries that tune the number of probes, target.
SAMPLE, LISTS, PARTS, TUNERS, RECALL = 20_000, 4096, 256, 200, 0.97
#: Lists whose parts a query ranks.
NEAR = 64
#: Vectors and queries in one task's block; columns in one step of the scan; the test's looseness.
BLOCK, QUERIES, COLUMNS, EPSILON = 8192, 2048, 16, 2.1


class Lists(NamedTuple):
    """Lists of the vectors of one length: ids first .. first + len(centres) * len(parts) - 1."""

    first: int
    centres: np.ndarray
    parts: np.ndarray
    turn: np.ndarray
    probes: int


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_lists(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means centres of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def home_of(u: np.ndarray, centres: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The list of each unit vector: its nearest centre, then the part whose residual is nearest."""
    near = (u @ centres.T).argmax(1)
    if len(parts) == 1:
        return near
    rest = u - centres[near]
    return near * len(parts) + (rest @ parts.T - (parts * parts).sum(1) / 2).argmax(1)


def ranked(u: np.ndarray, centres: np.ndarray, parts: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` lists of each unit vector, nearest first; parts are ranked within the NEAR nearest centres."""
    sims = u @ centres.T
    near = np.argsort(-sims, axis=1, kind="stable")
    if len(parts) == 1:
        return near[:, :most]
    near = near[:, : max(NEAR, -(-most // len(parts)))]
    # Distance to centre + part, less what is the same for all: -2u.(c + r) + |c + r|^2.
    whole = -2 * (np.take_along_axis(sims, near, 1)[:, :, None] + (u @ parts.T)[:, None, :])
    whole += (centres * centres).sum(1)[near][:, :, None] + 2 * (centres @ parts.T)[near] + (parts * parts).sum(1)
    order = np.argsort(whole.reshape(len(u), -1), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, order // len(parts), 1) * len(parts) + order % len(parts)


def tune_probes(x: np.ndarray, centres: np.ndarray, parts: np.ndarray, k: int, tuners: int, target: float) -> int:
    """Fewest probes by which the sample's own neighbours are found with ``target`` recall."""
    q = x[: min(tuners, len(x))]
    sims = q @ x.T
    sims[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-sims, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    every = len(centres) * len(parts)
    order, home = ranked(q, centres, parts, every), home_of(x, centres, parts)
    need = [int(at[0]) if len(at := np.flatnonzero(o == h)) else every - 1 for o, row in zip(order, home[best]) for h in row]
    need = np.sort(need)
    return min(every, int(need[min(len(need) - 1, int(np.ceil(target * len(need))))]) + 1) if len(need) else 1


def fit_model(drawn: list[np.ndarray], total: int, k: int, recall: float) -> dict[int, Lists]:
    """The lists of each vector length that the sample holds; ``total`` vectors are shared among them as in the sample."""
    model, first = {}, 0
    by: dict[int, list[np.ndarray]] = {}
    for v in drawn:
        by.setdefault(len(v), []).append(v)
    for dim, vectors in sorted(by.items()):
        x = np.unique(unit(np.array(vectors)), axis=0)
        x = x[np.random.default_rng(7).permutation(len(x))]
        wanted = max(1, int(np.sqrt(total * len(vectors) / len(drawn)) / 2))
        lists = min(wanted, LISTS, max(1, len(x) // 8))
        centres = fit_lists(x, lists)
        n_parts = min(PARTS, wanted // lists, max(1, len(x) // 8))
        parts = np.zeros((1, dim))
        if n_parts > 1:
            rest = x - centres[(x @ centres.T).argmax(1)]
            parts = euclidean_centres(rest, n_parts)
        model[dim] = Lists(first, centres, parts, rotation(dim), tune_probes(x, centres, parts, k, TUNERS, recall))
        first += len(centres) * len(parts)
    return model


def euclidean_centres(x: np.ndarray, n: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """K-means centres."""
    centres = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T - (centres * centres).sum(1) / 2).argmax(1)
        count = np.bincount(near, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def leaders(part: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the least ``part`` of the k ids that come first by it; fewer if there are fewer ids."""
    first = np.argpartition(part, k - 1)[:k] if len(part) > k else np.arange(len(part))
    if len(set(ids[first].tolist())) < min(k, len(part)):  # an id with several vectors
        order = np.argsort(part, kind="stable")
        first = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]
    return first


def scan(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON) -> np.ndarray:
    """Positions of candidates that survive the tests; ``own`` masks the query's own rows.

    ``query`` and ``rows`` are rotated unit vectors, ``ids`` those of the rows.  The k-th nearest id so
    far starts from the first candidates, taken whole, and is brought up to date from the nearest
    partial distances.  Fewer than k ids set no limit.
    """
    dim = rows.shape[1]
    alive = np.flatnonzero(~own)
    if len(alive) <= 4 * k:
        return alive
    part = np.zeros(len(alive))
    limit = np.inf
    for at in range(0, dim, columns):
        to = min(at + columns, dim)
        diff = rows[alive, at:to] - query[at:to]
        part = part + np.einsum("ij,ij->i", diff, diff)
        first = alive[leaders(part, ids[alive], k)]
        if len(first) == k:
            whole = rows[first] - query
            limit = min(limit, np.einsum("ij,ij->i", whole, whole).max() + 1e-9)
        # A distance beyond the limit shows in a share to/dim of the columns, up to a factor that the test allows.
        slack = 1.0 if to == dim else (1 + epsilon / np.sqrt(to)) ** 2
        stays = part <= limit * (to / dim) * slack
        alive, part = alive[stays], part[stays]
        if len(alive) <= k:
            break
    return alive


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision of one vector with the rows of ``x``, whatever their lengths.

    Rows are scaled by powers of two first, which leaves their digits as they are.
    """
    q, x = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1]) for v in (q, x))
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def _clean(vectors: DataFrame) -> DataFrame:
    """Rows that take part: an id, and a vector of finite numbers that are not all zero; numbers keep their width."""
    v = F.col("v")
    kind = vectors.schema["embedding"].dataType.simpleString()
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return slim.filter(v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0)).filter(fine & F.exists(v, lambda x: x != 0))


def _assign(model):
    """``lists`` of each row: one for a candidate, the probed ones for a query.  A length the sample lacks is one list."""

    def run(batches):
        lists = model.value
        for b in batches:
            values, ends = b.column("v").values.to_numpy().astype(float), b.column("v").offsets.to_numpy()
            size, asks, out = np.diff(ends), b.column("is_query").to_numpy(zero_copy_only=False), [None] * b.num_rows
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                if (own := lists.get(int(dim))) is None:
                    for i in at:
                        out[i] = [-int(dim)]
                    continue
                u = unit(values[ends[at][:, None] + np.arange(dim)])
                home = home_of(u, own.centres, own.parts)
                for i, h in zip(at, home.tolist()):
                    out[i] = [own.first + h]
                if asks[at].any():
                    for i, h, order in zip(at[asks[at]], home[asks[at]].tolist(), ranked(u[asks[at]], own.centres, own.parts, own.probes).tolist()):
                        out[i] = [own.first + h] + [own.first + x for x in order if x != h][: max(own.probes - 1, 0)] if h in order else [own.first + h] + [own.first + x for x in order]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(out, pa.list_(pa.int64())), b.column("is_query")], names=["vec_id", "v", "lists", "is_query"])

    return run


def _searched(rows: DataFrame, asked: DataFrame, k: int, model) -> DataFrame:
    """``query_id, vec_id, score`` of what each query (list, vec_id, v) finds in its lists of ``rows``; k at most of each list's block."""
    # Counts of lists: how many blocks each is dealt into.
    sizes = rows.groupBy("list").agg(F.count("*").alias("n"))
    asks = asked.groupBy("list").agg(F.count("*").alias("m"))
    grid = materialise(sizes.join(asks, "list").select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("m") / QUERIES).cast("int").alias("mb")))
    salt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col(n).cast("long")).cast("int")
    cols = ["list", "vb", "qb", "vec_id", "v"]
    left = rows.join(grid, "list").withColumn("vb", salt("nb", "v")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).select(cols)
    right = asked.join(grid, "list").withColumn("qb", salt("mb", "q")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(cols)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids, raw, asks = left["vec_id"].to_numpy(), np.stack(left["v"]).astype(float), np.stack(right["v"]).astype(float)
            own = model.value.get(raw.shape[1])
            turn = rotation(raw.shape[1]) if own is None else own.turn
            turned, wanted = unit(raw) @ turn, unit(asks) @ turn
            for q, v, t in zip(right["vec_id"], asks, wanted):
                at = scan(t, turned, ids, ids == q, k)
                s = cosine(v, raw[at])
                order = np.lexsort((ids[at], -s))
                best = order[np.sort(np.unique(ids[at][order], return_index=True)[1])][:k]  # each id once
                found["query_id"] += [q] * len(best)
                found["vec_id"] += ids[at][best].tolist()
                found["score"] += s[best].tolist()
        return pd.DataFrame(found)

    key = ["list", "vb", "qb"]
    right = right.toDF(*right.columns)  # fresh column identities: both sides come from one table
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = K, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each row where ``is_query``.

    Nearness is the cosine, ties to the smaller id; a query's own id is no candidate.  Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do rows without an id.  A cosine needs vectors of
    one length, so a query's candidates are those as long as itself; each length has lists of its
    own.  Rows that repeat an id count once, with their best score.  An empty table gives no rows;
    other columns are ignored.  A list of any
    length is dealt out in blocks of vectors and of queries, so one very common vector does not
    gather in a task.  The sample fits lists and the number of probes; all vectors are indexed.  A
    query that found fewer than k is asked of all lists of its length.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    clean = _clean(vectors)
    total = clean.select("vec_id", F.xxhash64("v")).distinct().count()  # a size only
    drawn = clean.filter(F.pmod(F.xxhash64(F.lit("lists"), "vec_id"), F.lit(max(total, 1))) < sample * 9 // 10).dropDuplicates(["vec_id", "v"]).limit(sample).collect()
    if not total:
        return spark.createDataFrame([], out)
    model = spark.sparkContext.broadcast(fit_model([np.array(r["v"], float) for r in drawn], total, k, recall))
    kind = clean.schema["v"].dataType.simpleString()
    flagged = clean.dropDuplicates(["vec_id", "v"]).select("vec_id", "v", is_query(F.col("vec_id")).alias("is_query"))
    indexed = materialise(flagged.mapInArrow(_assign(model), f"vec_id long, v {kind}, lists array<long>, is_query boolean"))
    rows = indexed.select(F.element_at("lists", 1).alias("list"), "vec_id", "v")
    asked = indexed.filter("is_query")
    hits = materialise(_searched(rows, asked.select(F.explode("lists").alias("list"), "vec_id", "v"), k, model).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    found = hits.groupBy("query_id").agg(F.count("*").alias("found"))
    short = asked.select("vec_id", "v").join(found, F.col("query_id") == F.col("vec_id"), "left").filter(F.coalesce("found", F.lit(0)) < k).select("vec_id", "v", F.size("v").alias("dim"))
    if short.limit(1).count():
        lists = indexed.select(F.size("v").alias("dim"), F.element_at("lists", 1).alias("list")).distinct()
        hits = hits.unionByName(_searched(rows, short.join(lists, "dim").select("list", "vec_id", "v"), k, model)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

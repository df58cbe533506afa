"""A graph of near neighbours, begun in cells, grown by neighbour descent, and searched with a bounded beam.

The graph is a table ``patch_id, links``.  Patches first meet those of the cells that are nearest to them.  A round
of descent lets the linked neighbours of each patch meet each other: whoever finds a better neighbour that way links to it.  A search moves a beam of
patches for all views at once: each hop follows the links of the best that were not followed yet.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelrank.functions.vectors import dot
from voxelrank.operators.cells import fit_cells, nearest_cells
from voxelrank.operators.topk import list_topk
from voxelrank.session import written

#: Links of a patch; rounds of descent at most; share of changed links at which it ends.
DEGREE, ROUNDS, SETTLED = 16, 12, 0.002
#: Patches of a cell on average, cells that a patch meets, and times the average that are met in a cell (its others may be found by descent).
CELL, CELLS, PART = 1024, 8, 4
#: Patches in a view's beam; of these followed in one hop; hops at most; entry points.
BEAM, STEP, HOPS, ENTRIES = 64, 8, 40, 32


def _best(edges: DataFrame, by: str, n: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.xxhash64("src", "dst"))
    return edges.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def _score(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``score`` to pairs src, dst."""
    a, b = rows.select(F.col("patch_id").alias("src"), F.col("emb").alias("_a")), rows.select(F.col("patch_id").alias("dst"), F.col("emb").alias("_b"))
    return pairs.join(a, "src").join(b, "dst").withColumn("score", dot(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def _in_cells(asked: DataFrame, rows: DataFrame, n: int, degree: int) -> DataFrame:
    """``src, dst, score``: the ``degree`` best that ``asked`` find in each of their nearest cells; cells far above the average are met in parts."""
    centres = fit_cells(rows, max(1, n // CELL))
    held = written(nearest_cells(rows, centres, 1).select("patch_id", "emb", F.element_at("near", 1).cast("long").alias("cell")))
    sizes = F.broadcast(held.groupBy("cell").agg(F.ceil(F.count("*") / (PART * CELL)).alias("parts")))  # one row a cell
    part = lambda df, by: df.join(sizes, "cell").withColumn("cell", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64(by), "parts")).drop("parts")
    views = nearest_cells(asked, centres, min(CELLS, len(centres))).select(F.col("patch_id").alias("query_id"), F.lit(0).alias("view_idx"), "emb", F.explode(F.col("near").cast("array<long>")).alias("cell"))
    return list_topk(part(views, "query_id"), part(held, "patch_id"), degree).select(F.col("query_id").alias("src"), F.col("patch_id").alias("dst"), "score")


def _meet(batches):
    """The members around a patch meet: each goes away with the others that are better than its worst link, if one of the two is new."""

    def met(part: pd.DataFrame) -> pd.DataFrame:
        _, group, size = np.unique(part["centre"].to_numpy(), return_inverse=True, return_counts=True)
        place = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)
        shape, emb = (len(size), size.max()), np.stack(part["emb"])
        x, there = np.zeros((*shape, emb.shape[1])), np.zeros(shape, bool)
        ids, fresh, least = np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(shape)
        for to, values in ((x, emb), (there, True), (ids, part["member"]), (fresh, part["fresh"]), (least, part["least"])):
            to[group, place] = values
        s = x @ x.transpose(0, 2, 1)
        pair = there[:, :, None] & there[:, None] & (fresh[:, :, None] | fresh[:, None]) & (ids[:, :, None] != ids[:, None]) & (s > least[:, :, None])
        g, i, j = np.nonzero(pair)
        return pd.DataFrame({"src": ids[g, i], "dst": ids[g, j], "score": s[g, i, j]}).drop_duplicates(["src", "dst"])

    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b])
        if len(b):
            cut = b["centre"].searchsorted(b["centre"].iloc[-1])  # the last patch's may go on in the next batch
            rest = b.iloc[cut:]
            if cut:
                yield met(b.iloc[:cut])
    if rest is not None and len(rest):
        yield met(rest)


def neighbour_graph(vectors: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, settled: float = SETTLED, start: DataFrame | None = None) -> DataFrame:
    """``patch_id, links array<long>``: links to near neighbours by inner product, nearest first, and to some that link here.

    Descent starts from links within near cells, or for patches that ``start`` (patch_id, links) knows from those.  A
    patch meets at most ``2 * degree`` others in a round - its own links and the best of those that
    link to it - so no task holds a group that grows with the table.  Patches around which nothing is new are left out.  Each round is written.
    """
    rows = written(vectors.select(F.col("patch_id").cast("long").alias("patch_id"), F.col("emb").cast("array<double>").alias("emb")))
    n = rows.count()
    degree = min(degree, max(n - 1, 1))
    if start is None:
        edges = _in_cells(rows, rows, n, degree)
    else:
        old = _score(start.select(F.col("patch_id").alias("src"), F.explode("links").alias("dst")), rows)
        new = written(_in_cells(rows.join(start, "patch_id", "left_anti"), rows, n, degree))
        edges = old.unionByName(new).unionByName(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
        edges = edges.groupBy("src", "dst").agg(F.max("score").alias("score"))
    edges = written(_best(edges, "src", degree).withColumn("fresh", F.lit(True)))
    for _ in range(rounds):
        back = _best(edges, "dst", degree).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "fresh")
        around = edges.select("src", "dst", "fresh").unionByName(back).groupBy(F.col("src").alias("centre"), F.col("dst").alias("member")).agg(F.max("fresh").alias("fresh"))
        around = around.withColumn("some", F.max("fresh").over(Window.partitionBy("centre"))).filter("some").drop("some")
        worst = edges.groupBy(F.col("src").alias("member")).agg(F.when(F.count("*") >= degree, F.min("score")).otherwise(float("-inf")).alias("least"))
        known = rows.select(F.col("patch_id").alias("member"), "emb").join(worst, "member", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        met = around.join(known, "member").repartition("centre").sortWithinPartitions("centre").mapInPandas(_meet, "src long, dst long, score double")
        both = edges.select("src", "dst", "score", F.lit(True).alias("had")).unionByName(met.withColumn("had", F.lit(False)))
        edges = written(_best(both.groupBy("src", "dst").agg(F.max("score").alias("score"), (~F.bool_or("had")).alias("fresh")), "src", degree))
        if edges.filter("fresh").count() <= settled * n * degree:
            break
    back = _best(edges, "dst", degree).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score")
    linked = edges.select("src", "dst", "score").unionByName(back).groupBy("src", "dst").agg(F.max("score").alias("score"))
    found = linked.groupBy(F.col("src").alias("patch_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "dst"))).alias("l"))
    alone = rows.select("patch_id").join(found, "patch_id", "left")  # a table of one patch has no links
    return alone.select("patch_id", F.coalesce(F.transform("l", lambda x: x["dst"]), F.array().cast("array<bigint>")).alias("links"))


def beam_search(views: DataFrame, vectors: DataFrame, links: DataFrame, k: int, beam: int = BEAM, step: int = STEP, hops: int = HOPS, entries: int = ENTRIES, skip_own: bool = True, visited: list | None = None) -> DataFrame:
    """``query_id, view_idx, patch_id, score, view_rank``: the k best patches that a beam through the graph finds for each view.

    All views move together.  A hop follows the ``step`` best patches of each beam that were not
    followed yet; what they link to is scored once for each view, and the ``beam`` best stay.  It ends
    when every beam is followed.  ``visited`` gets (pairs scored, views, patches), the work that was done.
    """
    spark = views.sparkSession
    rows = vectors.select(F.col("patch_id").cast("long").alias("patch_id"), F.col("emb").cast("array<double>").alias("p"))
    asked = written(views.select(F.col("query_id").cast("long").alias("query_id"), F.col("view_idx").cast("int").alias("view_idx"), F.col("emb").cast("array<double>").alias("q")))
    keys, width = ["query_id", "view_idx"], max(beam, k + 1)
    per_view = Window.partitionBy(*keys)
    seeds = [r.patch_id for r in rows.orderBy(F.xxhash64("patch_id")).limit(entries).select("patch_id").collect()]
    pairs = asked.select(*keys, F.explode(F.array(*map(F.lit, seeds)) if seeds else F.array().cast("array<bigint>")).alias("patch_id"))
    held = spark.createDataFrame([], "query_id long, view_idx int, patch_id long, score double, followed boolean")
    seen = None
    for _ in range(hops):
        scored = written(pairs.join(rows, "patch_id").join(asked, keys).select(*keys, "patch_id", dot(F.col("q"), F.col("p")).alias("score"), F.lit(False).alias("followed")))
        seen = scored.select(*keys, "patch_id") if seen is None else seen.unionByName(scored.select(*keys, "patch_id"))
        place = F.row_number().over(per_view.orderBy(F.desc("score"), "patch_id"))
        kept = held.unionByName(scored).withColumn("_r", place).filter(F.col("_r") <= width).drop("_r")
        open_ = ~F.col("followed")
        nth = F.sum(open_.cast("int")).over(per_view.orderBy(F.desc("score"), "patch_id"))
        held = written(kept.withColumn("now", open_ & (nth <= step)))
        follow = held.filter("now").select(*keys, "patch_id")
        held = held.select(*keys, "patch_id", "score", (F.col("followed") | F.col("now")).alias("followed"))
        pairs = written(follow.join(links, "patch_id").select(*keys, F.explode("links").alias("patch_id")).distinct().join(seen, [*keys, "patch_id"], "left_anti"))
        if pairs.isEmpty():
            break
    if visited is not None:
        visited.append((seen.count(), asked.count(), rows.count()))
    found = held.filter(F.col("patch_id") != F.col("query_id")) if skip_own else held
    order = F.row_number().over(per_view.orderBy(F.desc("score"), "patch_id"))
    return found.withColumn("view_rank", order).filter(F.col("view_rank") <= k).select(*keys, "patch_id", "score", "view_rank")

import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelrank.operators import cells, graph, topk, vector_index
from voxelrank.session import scratch, written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return written(spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("patch_id"), F.col("embedding").cast("array<double>").alias("emb")))


@pytest.fixture(scope="module")
def views(vectors):
    return vectors.filter("patch_id % 25 = 0").select(F.col("patch_id").alias("query_id"), F.lit(0).alias("view_idx"), "emb")


@pytest.fixture(scope="module")
def exact(vectors, views):
    return {(r.query_id, r.patch_id): r.score for r in topk.vector_topk(views, vectors, 5).collect()}


def pairs(found):
    rows = found.collect()
    assert all(1 <= r.view_rank <= 5 and r.query_id != r.patch_id for r in rows)
    got = {(r.query_id, r.patch_id): r.score for r in rows}
    assert len(got) == len(rows)
    return got


def recall(got, want):
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got.keys() & want.keys())
    return len(got.keys() & want.keys()) / len(want)



def test_planner_and_cells():
    assert [topk.choose_index(n) for n in (1, 200_000, 200_001, 2_000_000, 2_000_001)] == ["flat", "flat", "graph", "graph", "ivfpq"]
    assert topk.choose_index(5, "ivf") == "ivf"
    with pytest.raises(ValueError):
        topk.choose_index(5, "tree")
    assert [cells.cell_count(n) for n in (0, 3, 500, 1_000_000, 10**9)] == [1, 1, 125, 16_000, 65_536]


def test_nearest_centres_take_bounded_memory():
    rng = np.random.default_rng(4)
    x, centres = rng.standard_normal((10_000, 8)), rng.standard_normal((5000, 8))
    tracemalloc.start()
    got = cells.nearest(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6  # all distances at once are 400 MB
    assert np.array_equal(got[:500], ((x[:500, None] - centres) ** 2).sum(2).argmin(1))


def test_inverted_lists_are_kept_and_prune(spark, vectors, views, exact):
    path = scratch(spark)
    built = vector_index.build_index(vectors, path, "ivf")
    index = vector_index.open_index(spark, path)
    assert (index.kind, index.n, index.cells, index.version) == ("ivf", 500, 125, 1) and index == built
    probes = index.cells // 4
    first, second = (pairs(vector_index.search_index(index, views, 5, probes)) for _ in range(2))
    assert first == second and recall(first, exact) >= 0.9
    assert recall(pairs(vector_index.search_index(index, views, 5, index.cells)), exact) == 1
    # One view reads the folders of its cells only.
    one = vector_index.pruned(index, written(vector_index.probed(index, views.filter("query_id = 0"), 8)))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*shard#\d+ IN", plan)
    held = one.select(F.input_file_name().alias("f")).distinct().count()
    every = index.vectors(spark).select(F.input_file_name().alias("f")).distinct().count()
    assert held <= 8 * 8 and held < every / 5


def test_views_go_to_shards_not_to_each_of_their_cells(spark, vectors, views, monkeypatch):
    monkeypatch.setattr(vector_index, "FEW_SHARDS", 4)
    index = vector_index.build_index(vectors, scratch(spark), "ivf")
    asked, rows = written(vector_index.probed(index, views, 30)), written(index.vectors(spark))
    assert asked.count() <= 20 * 4  # 20 views have 30 cells each
    cells_of = {}
    for r in asked.collect():
        cells_of.setdefault(r.query_id, []).extend(r.cells)
    assert all(len(set(c)) == len(c) == 30 for c in cells_of.values()) and asked.filter("first").count() == 20
    x = {r.patch_id: np.array(r.emb) for r in rows.collect()}
    held = [(r.cell, r.patch_id) for r in rows.collect()]
    want = {}
    for q, mine in cells_of.items():
        near = sorted((-round(float(x[q] @ x[p]), 9), p) for p in {p for c, p in held if c in mine and p != q})[:5]
        want |= {(q, p): -s for s, p in near}
    assert pairs(vector_index.search_index(index, views, 5, 30)) == pytest.approx(want)
    for blocks in ((32_768, 8192), (40, 7)):  # each shard once, or many blocks of it
        assert pairs(topk.ranked(topk.shard_topk(asked, rows, 5, blocks=blocks), 5)) == pytest.approx(want)


@pytest.mark.parametrize("held", [1 << 20, 1, 60])
def test_best_of_a_shard_with_ties_and_copies(monkeypatch, held):
    monkeypatch.setattr(topk, "HELD", held)
    rng = np.random.default_rng(5)
    x, ids, cell = rng.integers(-2, 3, (90, 3)).astype(float), rng.permutation(90) * 7, rng.integers(0, 9, 90)
    x, ids, cell = (np.concatenate([a, a[:30]]) for a in (x, ids, cell))
    cell[90:] = (cell[90:] + 1) % 9  # 30 of them lie in two cells
    q, own = rng.integers(-2, 3, (25, 3)).astype(float), np.arange(25) * 7
    asked = [np.sort(rng.permutation(11)[: i % 10 + 1]) for i in range(25)]  # some cells hold nothing
    got = {}
    for v, i, s in zip(*topk._in_shard(q, own, asked, x, ids, cell, 6, True)):
        got.setdefault(int(v), []).append((-s, int(i)))
    for v in range(25):
        every = {int(i): -float(q[v] @ e) for i, e, c in zip(ids, x, cell) if c in asked[v] and i != own[v]}
        assert got.get(v, []) == sorted((s, i) for i, s in every.items())[:6]


def test_appends_go_to_cells_and_earlier_versions_stay(spark, vectors, views, exact):
    path = scratch(spark)
    half = F.col("patch_id") < 250
    old = vector_index.build_index(vectors.filter(half), path, "ivf")
    new = vector_index.append_vectors(old, vectors.unionByName(vectors))  # the first half is known, the second comes twice
    assert (new.version, new.n, len(new.batches)) == (2, 500, 2) and vector_index.open_index(spark, path) == new
    assert vector_index.append_vectors(new, vectors) == new
    got = pairs(vector_index.search_index(new, views, 5, new.cells))
    assert got.keys() == exact.keys()
    assert all(p < 250 for _, p in pairs(vector_index.search_index(vector_index.open_index(spark, path, 1), views, 5, 4)))


def test_a_broken_append_leaves_the_index_as_it_was(spark, vectors, views, monkeypatch):
    path = scratch(spark)
    index = vector_index.build_index(vectors.filter("patch_id < 300"), path, "ivf")
    before = pairs(vector_index.search_index(index, views, 5))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(vector_index, "_commit", fail)
        vector_index.append_vectors(index, vectors)
    again = vector_index.open_index(spark, path)
    assert again == index and pairs(vector_index.search_index(again, views, 5)) == before
    assert vector_index.append_vectors(again, vectors).n == 500
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):  # a second writer of the same version
        vector_index.append_vectors(index, vectors)
    with pytest.raises(FileExistsError):
        vector_index.build_index(vectors, path)
    with pytest.raises(FileNotFoundError):
        vector_index.open_index(spark, path + "-none")


def test_codes_are_kept(spark, vectors, views, exact):
    index = vector_index.build_index(vectors, scratch(spark), "ivfpq")
    assert recall(pairs(vector_index.search_index(index, views, 5, index.cells // 4, refine=8)), exact) >= 0.9
    assert len(index.vectors(spark).first().code) == 16


def test_flat_is_exact_and_outgrown(spark, vectors, views, exact, monkeypatch):
    index = vector_index.build_index(vectors, scratch(spark))
    assert index.kind == "flat" and not index.outgrown() and pairs(vector_index.search_index(index, views, 5)) == pytest.approx(exact)
    monkeypatch.setattr(topk.choose_index, "__defaults__", ("auto", 100, 1000))
    assert index.outgrown()


def test_graph_links_near_neighbours_and_is_searched(spark, vectors, views, exact):
    index = vector_index.build_index(vectors.filter("patch_id < 400"), scratch(spark), "graph")
    index = vector_index.append_vectors(index, vectors)
    edges = spark.read.parquet(f"{index.path}/edges/{index.batches[-1]}")
    rows = sorted(vectors.collect())
    x, links = np.array([r.emb for r in rows]), {r.patch_id: r.links for r in edges.collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    near = np.argsort(-s, axis=1)[:, :16]
    assert links.keys() == {r.patch_id for r in rows} and max(map(len, links.values())) <= 2 * graph.DEGREE
    assert all(i not in l and len(set(l)) == len(l) for i, l in links.items())
    assert np.mean([len(set(near[i]) & set(links[i])) / 16 for i in links]) > 0.8
    work = []
    got = pairs(graph.beam_search(views, vectors, edges, 5, beam=12, step=4, entries=8, visited=work))
    scored, asked, n = work[0]
    assert recall(got, exact) >= 0.9 and asked == 20 and scored < 0.6 * asked * n


def test_graph_begins_in_near_cells(vectors, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 100, raising=False)
    rows = sorted(vectors.collect())
    s = np.array([r.emb for r in rows]) @ np.array([r.emb for r in rows]).T
    np.fill_diagonal(s, -np.inf)
    near = np.argsort(-s, axis=1)[:, :16]
    links = {r.patch_id: r.links for r in graph.neighbour_graph(vectors, rounds=1).collect()}
    assert np.mean([len(set(near[i]) & set(links[i])) / 16 for i in range(len(rows))]) > 0.95


@pytest.mark.parametrize("n", [0, 1, 2, 5])
@pytest.mark.parametrize("kind", ["flat", "ivf", "graph"])
def test_tiny_tables(spark, vectors, views, n, kind):
    few = vectors.filter(F.col("patch_id") < n)
    index = vector_index.build_index(few, scratch(spark), kind)
    got = pairs(vector_index.search_index(index, views, 5))
    assert got.keys() == {(q, p) for q in range(0, 500, 25) for p in range(n) if p != q}

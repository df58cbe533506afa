import math

import numpy as np
import pytest

from voxelrank.llm import whiten as W

KIND = "vec_id long, embedding array<double>, n int, component string"


def run(spark, rows, most=4):
    return W.whiten(spark.createDataFrame([(i, v, 1, "c") for i, v in rows], KIND), most).collect()


def brute(rows, most=4):
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(v) for _, v in x)
    x = [(i, v + [0] * (dim - len(v))) for i, v in x]
    fit = np.array(sorted({tuple(v) for _, v in x}), float)
    n, total = len(fit), [sum(int(r[j]) for r in fit) for j in range(dim)]
    c = fit - fit.mean(0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    white = [(np.array(v) - fit.mean(0)) @ u / np.sqrt(e) for _, v in x]
    return [(i, sum((n * a - s) ** 2 for a, s in zip(v, total)), w) for (i, v), w in zip(x, white)], n, e / np.trace(c.T @ c / n), c @ u / np.sqrt(e)


def check(spark, rows, most=4):
    got, (want, n, explained, fit) = run(spark, rows, most), brute(rows, most)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(got) == len(want) * len(explained)
    signs = [np.sign(sum(r.whitened * w[k - 1] for i, d, w in want for r in by[i, d][k])) for k in range(1, len(explained) + 1)]
    for i, d, w in want:
        for k, found in by[i, d].items():
            for r in found:
                assert r.n == n and r.explained == pytest.approx(explained[k - 1], rel=1e-9)
                assert r.whitened == pytest.approx(signs[k - 1] * w[k - 1], abs=1e-8)
                assert 0 <= r.identity_error < 1e-9
    assert np.abs(fit.T @ fit / n - np.eye(len(explained))).max() < 1e-9


def test_random_vectors_with_copies(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 10)) * np.arange(1, 11) + 100
    x[100:200] = x[100]
    check(spark, list(enumerate(x.tolist())))
    check(spark, list(enumerate(x[:, :3].tolist())))


def test_tiles_and_row_blocks_give_the_whole_covariance(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-900, 900, (157, 11))
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(3)
    total = W.sums(df, 11)
    assert total == x.sum(0).tolist()
    for tile, block in ((4, 10), (11, 1000), (1, 64), (5, 50)):
        v = W.covariance(df, len(x), 11, lambda a: W.centred(a, len(x), total).astype(float) / len(x), tile, block)
        assert np.allclose(v, np.cov(x.T, bias=True), rtol=1e-12)


def test_rows_that_are_dropped_and_short_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5, 2.0]), (1, [0.25]), (2, None), (3, []), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf]), (None, [1.0, 1.0]), (7, [3.0, -1.0, 0.5]), (7, [3.0, -1.0, 0.5])]
    check(spark, rows)
    assert run(spark, []) == [] and run(spark, [(2, None)]) == [] and run(spark, [(2, [])]) == []


def test_components_without_variance(spark):
    same = run(spark, [(i, [1.0, 2.0]) for i in range(20)])
    assert len(same) == 40 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in same)
    line = run(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)])
    assert all((r.whitened is None) == (r.component > 1) for r in line) and all(r.identity_error < 1e-9 for r in line)
    assert {r.component: round(r.explained, 9) for r in line} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e9 + i, float(i * i), 1e12]) for i in range(30)]
    got = {r.vec_id: r.deviation for r in run(spark, rows)}
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], object)
    want = [int(s) for s in ((30 * x - x.sum(0)) ** 2).sum(1)]
    assert got == {i: s if s < 2**63 else None for i, s in enumerate(want)}
    far = run(spark, [(0, [1e16]), (1, [-1e16]), (2, [0.0])])
    assert {r.deviation for r in far} == {0, None} and all(math.isclose(abs(r.whitened), (r.vec_id < 2) * math.sqrt(1.5), abs_tol=1e-9) for r in far)


def test_floats_of_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(spark, [(r.vec_id, list(r.embedding)) for r in vectors.collect()])

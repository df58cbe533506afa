import math

import numpy as np
import pytest

from voxelrank.llm import topk

KIND = "vec_id long, embedding array<double>, rank int, score string"


def brute(rows, k=5):
    """Best score of each pair of ids, then the k best ids of each query."""
    x = [(i, [int(c) * 256 if abs(c) >= 2**53 else math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    pairs = {}
    for q, a in x:
        for i, b in x:
            if q % 50 == 0 and i != q:
                s = min(max(sum(map(int.__mul__, a, b)), topk.LOWEST), topk.HIGHEST)
                pairs[q, i] = max(s, pairs.get((q, i), s))
    out = {}
    for (q, i), s in pairs.items():
        out.setdefault(q, []).append((-s, i))
    return {(q, n, i, -s) for q, found in out.items() for n, (s, i) in enumerate(sorted(found)[:k], 1)}


def run(spark, rows, kind=KIND):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], kind)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, lambda i: i % 50 == 0).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_vectors_with_ties_and_zeros(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((700, 24)), 1) * (rng.random((700, 24)) < 0.4)
    x[200:400] = x[200]  # one very common vector
    rows = list(enumerate(x.tolist()))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("full", [0.0, 2.0])
def test_posting_lists_as_lists_or_as_columns_give_the_same(full, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(topk, "FULL", full)
    monkeypatch.setattr(topk, "SCORES", 300)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((90, 8)) * (rng.random((90, 8)) < 0.6)
    block = pa.table({"vec_id": pa.array(range(90)), "v": pa.array(x.tolist())})
    got = topk.best_of_block(block, block, 4)
    w = np.floor(256 * x).astype(int)
    s = (w @ w.T).astype(float)
    np.fill_diagonal(s, -np.inf)
    want = [(q, i, int(s[q, i])) for q in range(90) for i in np.lexsort((np.arange(90), -s[q]))[:4]]
    assert sorted(zip(*(c.to_pylist() for c in got.columns))) == sorted(want)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i // 2, v) for i, v in enumerate(rng.standard_normal((400, 6)).tolist())]  # ids in pairs
    monkeypatch.setattr(topk, "LEAST", 30)
    monkeypatch.setattr(topk, "LEAST_ASKED", 2)
    monkeypatch.setattr(topk, "SCORES", 64)
    assert run(spark, rows) == brute(rows)


def test_rows_that_take_no_part_and_short_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.25]), (2, None), (3, []), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (50, [-1.0, 0.001, 2.0]), (7, [0.0, 0.0]), (-50, [2.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == set() and run(spark, [(2, None)]) == set() and run(spark, [(0, [1.0])]) == set()


def test_repeated_rows_count_once(spark):
    rows = [(0, [1.0, 0.0])] * 40 + [(1, [2.0, 0.0])] * 300 + [(2, [1.5, j / 10]) for j in range(9)] + [(3, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert {r[:3] for r in run(spark, rows)} == {(0, 1, 1), (0, 2, 2), (0, 3, 3)}


def test_weights_of_any_size(spark):
    rows = [(0, [1e9, -3e8]), (1, [1e9, 0.3]), (2, [-1e9, 0.0]), (3, [1e4, 1e4]), (50, [1e300, 1.0]), (4, [1e-300, -1e-300])]
    assert run(spark, rows) == brute(rows)


def test_floats(spark):
    rng = np.random.default_rng(3)
    rows = list(enumerate(rng.standard_normal((120, 16)).astype(np.float32).tolist()))
    assert run(spark, rows, KIND.replace("double", "float")) == brute(rows)

"""The quality classifier on held-out labels, and on awkward rows."""

import os
import random

import numpy as np
import pytest

from voxelrank.llm import quality

HELD_OUT = "/root/testdata/check_s"
SCHEMA = "doc_id long, text string, votes string, place long, quality_score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], SCHEMA)


@pytest.mark.skipif(not os.path.isdir(HELD_OUT), reason="the held-out rows are not here")
def test_rows_that_set_nothing(spark):
    docs, labels = (spark.read.parquet(f"{HELD_OUT}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs).join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r["quality"], r["keep"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def test_estimates_match_planted_accuracies():
    """EM on votes drawn from known accuracies gives these back."""
    rng, n = np.random.default_rng(2), 40_000
    good = rng.random(n) < 0.85
    hit = [0.6, 0.5, 0.7, 0.4, 0.5, 0.6, 0.5]
    v = np.where(good[:, None], 1, np.where(rng.random((n, 7)) < hit, -1, 1))
    v[rng.random(v.shape) < 0.2] = 0
    patterns = {}
    for row in map(tuple, v.tolist()):
        patterns[row] = patterns.get(row, 0) + 1
    posterior, table = quality.estimate(patterns)
    assert np.abs(table[0, :, 0] - hit).max() < 0.15
    p = np.array([posterior[tuple(r)] for r in v.tolist()])
    assert ((p >= 0.5) == good).mean() > 0.97


def test_awkward_rows(spark):
    rnd = random.Random(1)
    say = lambda n: " ".join(rnd.choice(["plain", "words", "make", "lines", "here"]) + "." * (k % 9 == 8) for k in range(n))
    rows = [(i, say(rnd.randint(1, 80))) for i in range(200)] + [(None, None), (None, ""), (700, "same"), (700, "same"), (8, "x" * 2_000_000), (9, say(200_000)), (10, "%$#& " * 100_000)]
    got = quality.classify(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.keep == (r.score >= quality.KEEP_FROM) for r in got)
    assert len({r.score for r in got if r.doc_id == 700}) == 1
    kept = quality.keep_good(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "votes", "place", "quality_score"] and kept.count() == sum(r.keep for r in got)
    assert quality.classify(frame(spark, [])).count() == 0 and quality.keep_good(frame(spark, [])).count() == 0


def test_the_bound_on_features_holds(spark):
    docs = frame(spark, [(i, " ".join(f"w{k}" for k in range(300))) for i in range(300)])
    w, b, _ = quality.train(docs, features=0)
    assert not w.any() and b == 0.0
    assert quality.train(docs, features=5_000)[0].any()


def test_a_tie_is_kept(spark, monkeypatch):
    monkeypatch.setattr(quality, "train", lambda *_, **__: (np.zeros(quality.BUCKETS), 0.0, None))
    assert [(r.score, r.keep) for r in quality.classify(frame(spark, [(1, "any")])).collect()] == [(0.5, True)]
    assert quality.keep_good(frame(spark, [(1, "any")])).count() == 1

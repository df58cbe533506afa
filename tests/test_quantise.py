import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelrank.operators import quantise, topk


@pytest.fixture(scope="module")
def patches(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((30, 16))[rng.integers(0, 30, 1500)] + 0.3 * rng.standard_normal((1500, 16))
    return spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "patch_id long, emb array<double>").cache()


def test_lists_follow_the_training_set():
    assert [quantise.list_count(n) for n in (1, 20_000, 100_000, 10**7)] == [256, 384, 2432, 65536]


@pytest.mark.parametrize("block", [8192, 40])
def test_recall_and_exact_scores(spark, patches, monkeypatch, block):
    monkeypatch.setattr(quantise, "BLOCK", block)
    views = patches.filter("patch_id % 50 = 0").select(F.col("patch_id").alias("query_id"), F.lit(0).alias("view_idx"), "emb")
    model = quantise.train_quantiser(patches, lists=16, parts=4)
    codes = quantise.encode_patches(patches, model)
    assert codes.count() == 1500 and len(codes.first().code) == 4
    got = {(r.query_id, r.patch_id): r.score for r in quantise.ivfpq_topk(views, codes, model, 10, 8, 8).collect()}
    want = {(r.query_id, r.patch_id): r.score for r in topk.vector_topk(views, patches, 10).collect()}
    assert len(got) == 300 and all(q != p for q, p in got)
    both = got.keys() & want.keys()
    assert len(both) >= 0.9 * len(want) and all(abs(got[k] - want[k]) < 1e-9 for k in both)


def test_rejects_bad_shapes(patches):
    with pytest.raises(ValueError):
        quantise.train_quantiser(patches, lists=4, parts=5)
    with pytest.raises(ValueError):
        quantise.train_quantiser(patches.filter("false"), lists=4)

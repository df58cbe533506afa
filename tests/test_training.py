import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelrank.operators import evaluate, rerank, training, volume

LISTS = "row_idx long, source string, q array<float>, members array<struct<rank:long,patch_id:long,c:array<float>,prob:double,target:double>>"


def made(n, dim=6, seed=0):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        m = int(rng.integers(3, 7))
        q, c, p = rng.standard_normal(dim).astype(np.float32), rng.standard_normal((m, dim)).astype(np.float32), rng.random(m)
        out.append((i, "ab"[i % 2], q.tolist(), [(k + 1, k, c[k].tolist(), float(p[k] / p.sum()), float(rng.random()) if k else None) for k in range(m)]))
    return out


@pytest.fixture(scope="module")
def world(spark):
    rows = made(24)
    lists = spark.createDataFrame(rows, LISTS).repartition(3)
    splits = spark.createDataFrame([(i, "train" if i < 16 else "val" if i < 20 else "test") for i in range(24)], "row_idx long, split string")
    examples = [(np.array(q), np.array([m[2] for m in ms]), np.array([m[3] for m in ms]), np.array([np.nan if m[4] is None else m[4] for m in ms], float)) for _, _, q, ms in rows]
    return lists, splits, examples


def test_losses_are_those_of_a_loop_on_the_driver(spark, world):
    lists, splits, examples = world
    cfg = rerank.RerankerConfig(dim=6, hidden=(8, 4), epochs=3, dropout=0.0)
    batches = {r.row_idx: {} for r in lists.select("row_idx").collect()}
    for epoch in range(3):
        for r in lists.select("row_idx", F.pmod(F.xxhash64(F.lit(cfg.seed), F.lit(epoch), "row_idx", "source"), F.lit(4)).alias("b")).collect():
            batches[r.row_idx][epoch] = r.b
    groups = lambda epoch: [g for k in np.random.default_rng((cfg.seed, epoch)).permutation(4) if (g := [i for i in range(16) if batches[i][epoch] == k])]
    w, history = training.fit(lambda epoch: lists, splits, cfg, batch=4)
    want_w, want = rerank.train(examples[:16], cfg, examples[16:20], groups)
    assert len(history) == len(want) + 1
    for a, b in zip(history, want):
        assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in b)
    assert all(np.allclose(w[k], want_w[k], atol=1e-9) for k in w)
    tested = [rerank.list_parts(want_w, e, cfg)[:2] for e in examples[20:]]
    assert history[-1]["test_rank_loss"] == pytest.approx(np.mean(tested, 0)[0], abs=1e-9) and history[-1]["test_dist_loss"] == pytest.approx(np.mean(tested, 0)[1], abs=1e-9)
    assert history[-1]["train_loss"] is None and history[0]["test_loss"] is None


def test_every_epoch_draws_its_own_lists(spark, world):
    lists, splits, _ = world
    asked = []

    def draw(epoch):
        asked.append(epoch)
        return lists.filter(F.pmod(F.col("row_idx"), F.lit(3)) != epoch % 3)

    _, history = training.fit(draw, splits, rerank.RerankerConfig(dim=6, hidden=(4, 4), epochs=2), batch=100)
    assert asked == [0, 0, 1] and len(history) == 3
    with pytest.raises(ValueError, match="no training lists"):
        training.fit(lambda e: lists.limit(0), splits, rerank.RerankerConfig(dim=6, hidden=(4, 4), epochs=1))


def test_query_vectors_are_kept_until_something_changes(spark, tmp_path, monkeypatch):
    ball = volume.normalise(volume.synthetic_volume((16, 16, 16)))
    rows = spark.createDataFrame([(i, [0.0, 0.0, 1.0], float(i), 0.0, 0, 0.5, 0.5, 1.0, 1.0) for i in range(3)], "row_idx long, vector array<double>, depth double, rotation double, is_crop int, crop_cx double, crop_cy double, crop_rw double, crop_rh double")
    made, real = [], training.query_vectors
    monkeypatch.setattr(training, "query_vectors", lambda *a: made.append(1) or real(*a))
    cfg = evaluate.EvalConfig(size_px=16, step=1.0)
    get = lambda rows=rows, ball=ball, name="one", cfg=cfg: training.kept_query_vectors(str(tmp_path / "v"), rows, {"plain": ball}, volume.pooled_encoder(), cfg, name).collect()
    first = get()
    assert len(first) == 3 and sorted(get(rows.orderBy(F.desc("row_idx")))) == sorted(first) and len(made) == 1
    for n, changed in enumerate((dict(name="two"), dict(rows=rows.filter("row_idx < 2")), dict(ball=ball * 0.5), dict(cfg=evaluate.EvalConfig(size_px=16, step=0.5))), 2):
        get(**changed)
        assert len(made) == n
    get()
    assert len(made) == 5
    for f in (tmp_path / "v").rglob("_SUCCESS"):
        f.unlink()
    assert sorted(get()) == sorted(first) and len(made) == 6


def test_a_list_without_a_dataset_row_is_an_error(spark):
    pool = spark.createDataFrame([(i, "a", p, p + 1, float(p)) for i in (0, 1) for p in range(4)], "row_idx long, source string, patch_id long, rank int, dist double")
    vectors = spark.createDataFrame([(p, [float(p), 1.0]) for p in range(4)], "patch_id long, emb array<double>")
    queries = lambda *keys: spark.createDataFrame([(i, s, [1.0, 0.0]) for i, s in keys], "row_idx long, source string, emb array<double>")
    assert training.training_lists(pool, queries((0, "a"), (1, "a"), (2, "a")), vectors).count() == 2
    for known in (queries((0, "a")), queries((0, "a"), (1, "b"))):
        with pytest.raises(Exception, match="no dataset row or vector for row_idx 1 of source a"):
            training.training_lists(pool, known, vectors).collect()

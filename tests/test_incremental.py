import math
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelrank import catalog, cli
from voxelrank.session import written
from voxelrank.sources import tables
from voxelrank.streaming import averages, incremental

HITS = "eval_sig string, row_idx long, source string, rank long, patch_id long, geom_dist_vox double"


def hits_of(spark, rows):
    return spark.createDataFrame([("s", r, src, k, p, 1.0) for r, src, k, p in rows], HITS)


def asked_of(spark, rows):
    return spark.createDataFrame(rows, "row_idx long, source string")


def test_markers_finish_short_and_empty_lists(spark, tmp_path):
    path, rows = str(tmp_path / "hits"), spark.createDataFrame([(i,) for i in range(5)], "row_idx long")
    left = lambda sources, sig="s": sorted(r.row_idx for r in incremental.pending_marked(rows, incremental.read_markers(spark, path), sig, sources).collect())
    assert left(["a"]) == [0, 1, 2, 3, 4]
    incremental.append_marked(hits_of(spark, [(0, "a", 1, 5), (0, "a", 2, 6), (0, "b", 1, 7)]), asked_of(spark, [(0, "a"), (0, "b"), (1, "a")]), path, "s")
    assert left(["a"]) == [2, 3, 4] and left(["a", "b"]) == [1, 2, 3, 4] and left(["a"], "other") == [0, 1, 2, 3, 4]
    assert {(r.row_idx, r.source): r.n_hits for r in incremental.read_markers(spark, path).collect()} == {(0, "a"): 2, (0, "b"): 1, (1, "a"): 0}
    incremental.append_marked(hits_of(spark, []), asked_of(spark, [(2, "a")]), path, "s")
    assert left(["a"]) == [3, 4]
    assert tables.read_hits(spark, path).count() == 3


def test_a_run_that_breaks_before_its_markers_is_not_seen(spark, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "hits"), asked_of(spark, [(0, "a"), (1, "a")])
    incremental.append_marked(hits_of(spark, [(0, "a", 1, 5)]), asked_of(spark, [(0, "a")]), path, "s", "run1")

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(incremental, "markers_of", fail)
        incremental.append_marked(hits_of(spark, [(1, "a", 1, 8), (1, "a", 2, 9)]), asked, path, "s", "run2")
    got = lambda: sorted((r.row_idx, r["rank"], r.patch_id, r.run) for r in tables.read_hits(spark, path).collect())
    assert got() == [(0, 1, 5, "run1")]
    incremental.append_marked(hits_of(spark, [(1, "a", 1, 8)]), asked_of(spark, [(1, "a")]), path, "s", "run3")
    incremental.append_marked(hits_of(spark, [(1, "a", 1, 8)]), asked_of(spark, [(1, "a")]), path, "s", "run4")  # done twice, seen once
    assert got() == [(0, 1, 5, "run1"), (1, 1, 8, "run3")]


def test_resumed_evaluation_redoes_nothing(spark, tmp_path, monkeypatch):
    at = lambda n: str(tmp_path / n)
    cli.main(["index", "--normals", "6", "--depth-step", "6", "--size", "32", "--scales", "1", "--out", at("index")])
    cli.main(["dataset", "--planes", "1", "--size", "32", "--out", at("data")])
    run = ["eval", "--index", at("index"), "--dataset", at("data"), "--size", "32", "--final-k", "100000", "--k-per-view", "4", "--out", at("hits")]  # no query finds so many
    cli.main([*run, "--limit", "3"])
    first = tables.read_hits(spark, at("hits/fast"))
    columns, before = first.columns, sorted(map(str, first.collect()))
    assert first.select("row_idx").distinct().count() == 3
    cli.main([*run, "--limit", "5"])
    second = tables.read_hits(spark, at("hits/fast"))
    assert second.select("row_idx").distinct().count() == 5 and second.select("run").distinct().count() == 2
    assert sorted(map(str, second.filter("row_idx < 3").select(columns).collect())) == before
    monkeypatch.setattr(cli.evaluate, "evaluate", None)  # must not be called again
    cli.main([*run, "--limit", "5"])


def test_appends_do_not_read_what_was_written(spark, tmp_path):
    schema = "eval_sig string, row_idx long, source string, rank long, patch_id long"
    came = [[("s", 1, "a", 1, 5), ("s", 1, "a", 2, 6), ("s", 1, "a", 2, 4)], [("s", 1, "a", 2, 9), ("s", 2, "a", 1, 8), ("s", 1, "b", 1, 3)], [("s", 2, "a", 1, 8), ("t", 2, "a", 1, 7)]]
    for n, rows in enumerate(came):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.append_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        if n == 0:
            shutil.move(tmp_path / "out" / "batch=0", tmp_path / "kept")  # later batches can't know the keys from here
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.eval_sig, r.row_idx, r.source, r["rank"], r.patch_id, r.batch) for r in got) == [("s", 1, "b", 1, 3, 1), ("s", 2, "a", 1, 8, 1), ("t", 2, "a", 1, 7, 2)]
    assert sorted((r["rank"], r.patch_id) for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [(1, 5), (2, 4)]


def test_running_averages_over_batches_and_restarts(spark, tmp_path):
    rng = np.random.default_rng(4)
    odd = lambda v: [None, float("nan"), float("inf"), float(v)][rng.choice(4, p=[0.1, 0.1, 0.1, 0.7])]
    rows = [(r, s, None if rng.random() < 0.1 else float(rng.random()), odd(rng.random()), odd(rng.random() * 25), float(rng.random()), float(r % 5)) for r in range(40) for s in "abc" if rng.random() < 0.8]
    rows += [(90, "a", None, None, None, None, None), (91, "a", 0.5, None, None, 0.25, 2.0)]
    order = rng.permutation(len(rows))
    for part in np.array_split(order, 4):
        again = [rows[i] for i in [*part, part[0], order[0]]]  # some come twice
        spark.createDataFrame(again, averages.FIRST).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(averages.FIRST).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        averages.average_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = averages.read_averages(spark.read.parquet(str(tmp_path / "out"))).first()
    want = averages.averages(spark.createDataFrame(rows, averages.FIRST)).first()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    fine = lambda rs, c: [r[c] for r in rs if r[c] is not None and math.isfinite(r[c])]
    mean = lambda x: sum(x) / len(x)
    plain = {
        "n_rows": len(by), "n_queries": sum(r[5] is not None for r in rows), "avg_top1": sum(mean(fine(rs, 2)) if fine(rs, 2) else 0 for rs in by.values()) / len(by),
        "avg_row_latency_ms": 1000 * sum(max([r[6] or 0 for r in rs]) for rs in by.values()) / len(by), "avg_query_latency_ms": 1000 * mean([r[5] for r in rows if r[5] is not None]),
        "avg_dist1": mean([mean(fine(rs, 3)) for rs in by.values() if fine(rs, 3)]), "avg_corner1": mean([mean(fine(rs, 4)) for rs in by.values() if fine(rs, 4)]),
    }
    for name, value in plain.items():
        assert got[name] == pytest.approx(value) and want[name] == pytest.approx(value), name


def test_averages_of_nothing(spark):
    got = averages.averages(spark.createDataFrame([], averages.FIRST)).first()
    assert got.n_rows == 0 and got.avg_top1 is None and got.avg_dist1 is None


@pytest.mark.parametrize("name,step", [("visible_hits", "_log"), ("pending_marked", "_log"), ("stream_averages", "_first_hits"), ("compare_runs", "_hits")])
def test_queries_find_their_hits_once(spark, monkeypatch, name, step):
    hits = written(getattr(catalog, step)(spark, "/root/testdata/sf0.001"))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    monkeypatch.setattr(catalog, step, lambda *_: hits.mapInPandas(count, hits.schema))
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() and read.value == hits.count()

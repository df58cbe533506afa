import duckdb
import numpy as np

from voxelrank.llm import ann, queries

SF = "/root/testdata/sf0.001"


def brute(rows, k=5):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    n, out = np.sqrt((x * x).sum(1)), {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (n * n[q])
        keep = ids != ids[q]
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(ids[q])] = ids[keep][order].tolist()
    return out


def run(spark, rows, ids="long"):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], f"vec_id {ids}, embedding array<float>, list int")
    got = {}
    for r in ann.nearest(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 32)).astype(np.float32)
    x[1000:2000] = x[1000]  # one very common vector
    rows = list(enumerate(x.tolist()))
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) > 0.9
    assert got[1050] == want[1050] == [1000, 1001, 1002, 1003, 1004]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (50, [0.0, 0.0]), (7, [1.0, 2.0])]
    assert run(spark, rows) == {0: [1, 7]}
    assert run(spark, []) == {} and run(spark, [(2, None)]) == {}


def test_repeated_rows_count_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0])] + [(i, [1.0, i / 10]) for i in (1, 1, 1, 1, 1, 1, 2, 3, 4, 5, 6)]
    assert run(spark, rows) == {0: [1, 2, 3, 4, 5]}


def test_repeated_ids_leave_the_limit_to_k_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "LISTS", 1)
    other = [(i, [1.0, i / 10]) for i in range(2, 42)]
    same = [(1, [1.0, 0.1])] * 9
    apart = [(1, [1.0, 0.1 + j / 1000]) for j in range(9)]
    for first in (same, apart, same + apart):
        assert run(spark, [(0, [1.0, 0.0]), *first, *other]) == {0: [1, 2, 3, 4, 5]}
    assert run(spark, [(0, [1.0, 0.0]), *same * 4, *apart * 2, (2, [1.0, 0.2])]) == {0: [1, 2]}


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = list(enumerate(rng.standard_normal((600, 16)).tolist()))
    whole = run(spark, rows)
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "QUERIES", 3)
    assert sum(len(set(whole[q]) & set(v)) for q, v in run(spark, rows).items()) >= 0.9 * sum(map(len, whole.values()))


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        got = queries.QUERIES[name](spark, SF).select(*names).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_pipeline(spark):
    """The stages against plain versions of themselves on the small corpus."""
    import corpus_pipeline as cp

    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(1) for c in ("quality_score", "keep", "class_id", "hash", "spans", "text_sha256", "v")})
    text = {r.doc_id: r.text for r in docs.collect()}
    names, seen = docs.columns, set(text)
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
        rows = docs.collect()
        left = {r.doc_id for r in rows}
        assert len(left) == len(rows) and left <= seen
        if name == "exact":
            low = {i: text[i].translate({c: c + 32 for c in range(65, 91)}) for i in seen}
            assert left == {max(i for i in seen if low[i] == low[j]) for j in seen}
        if name == "secrets":
            assert left == seen
        seen, docs = left, spark.createDataFrame(rows, docs.schema)
    out = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == seen
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        empty = stage(spark, empty, SF)
    assert cp.STAGES[-1][1](spark, empty, SF).count() == 0


def test_every_length_has_its_own_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)] + [(1000 + i, rng.standard_normal(8).tolist()) for i in range(150)] + [(2000, [1.0, 2.0]), (2001, [2.0, 1.0]), (2050, [1.0])]
    got = run(spark, rows)
    for low, high, dim in ((0, 300, 16), (1000, 1150, 8), (2000, 2002, 2)):
        want = brute([(i, v) for i, v in rows if low <= i < high and len(v) == dim])
        assert all(len(got[q]) == len(want[q]) for q in want if want[q])
        assert sum(len(set(got[q]) & set(want[q])) for q in want if want[q]) >= 0.9 * sum(len(v) for v in want.values())
    assert got[2000] == [2001] and 2050 not in got


def test_lists_grow_beyond_what_the_sample_fits(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(ann, "LISTS", 6)
    x = rng.standard_normal((3000, 24)) + 3 * rng.standard_normal((40, 24))[rng.integers(0, 40, 3000)]
    model = ann.fit_model([*x[:1500]], 1_000_000, 5, 0.97)
    assert len(model[24].centres) == 6 and len(model[24].parts) == 500 // 6
    rows = list(enumerate(x.astype(np.float32).tolist()))
    got, want = run(spark, rows), brute(rows)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) > 0.9


def test_probes_widen_where_too_few_are_found(spark, monkeypatch):
    monkeypatch.setattr(ann, "tune_probes", lambda *a: 1)
    rng = np.random.default_rng(5)
    far = [(i, (rng.standard_normal(8) * 0.01 + np.eye(8)[i % 8]).tolist()) for i in range(400)]
    lone = [(5000, (-np.ones(8)).tolist())]
    got, want = run(spark, far + lone), brute(far + lone)
    assert len(got[5000]) == 5 and got[5000] == want[5000]


def test_pipeline_stages_on_awkward_rows(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names: each stage's defined result."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars int, `__voxelrank` string, votes string, row long, first string, head string"
    plain = "This is a plain sentence of ordinary words. " * 12
    long = " ".join(f"word{i} and more words follow here." for i in range(20_000))
    texts = [(None, None), (None, ""), (1, None), (2, ""), (3, plain), (3, plain), (4, plain.upper().lower()), (4, "another text " + plain), (5, long), (6, long + " end"), (7, "key password=hunter2hunter2 stays out. " + plain[:200]), (None, plain)]
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "x", "x", 1, "x", "x") for i, t in texts], schema)
    stages = dict(cp.STAGES)
    good = stages["quality"](spark, docs, SF)
    assert good.schema == docs.schema and good.count() <= docs.count()
    exact = stages["exact"](spark, docs, SF)
    assert exact.schema == docs.schema
    assert sorted((r.text or "", r.doc_id or 0) for r in exact.collect()) == sorted([("", 2), (plain.lower(), 4), ("another text " + plain, 4), (long, 5), (long + " end", 6), (texts[10][1], 7)])
    near = stages["near"](spark, docs, SF).collect()
    assert [r.doc_id for r in near if r.text == long] == [5] and not [r for r in near if r.doc_id == 6]
    assert sum(r.text == plain for r in near) == 2 and sum(not r.text for r in near) == 4  # one row of the class, and the one without an id
    clean = stages["secrets"](spark, docs, SF)
    assert clean.schema == docs.schema
    rows = clean.collect()
    assert len(rows) == len(texts) and [r.text for r in rows if r.doc_id == 7][0].startswith("key [SECRET] stays") and sum(r.text is None for r in rows) == 2
    assert all(r.n_chars == len(r.text or "") for r in rows)
    out = stages["packing"](spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in out) == len(texts)


def test_cosines_of_very_long_and_very_short_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 8))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, [1e200, 1e-200, 1.0] * 20))]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = ann.nearest(df, lambda i: i % 50 == 0).collect()
    assert len(got) == 10
    for r in got:
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12

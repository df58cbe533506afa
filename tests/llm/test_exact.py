"""Exact dedup against a plain version: hot groups over many partitions, hash accidents, repeated rows, long texts."""

import hashlib
import random
from collections import Counter

import pyarrow as pa

from voxelrank.llm import exact

SCHEMA = "doc_id long, text string, lang string, head string, hash long, __voxelrank long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 1, 2) for i, t in rows], SCHEMA)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def rows_of(n=1500):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["One very common text", "one VERY common text"])) for i in range(n // 3)]
    rows += [(rnd.choice([None, *range(50)]), rnd.choice([None, "", "É", "é", "Ab", "aB", "x" * 200_000, "X" * 200_000, f"text {rnd.randint(0, 400)}"])) for _ in range(n // 3)]
    return rows + [(7, "same id and text")] * (n // 3)


def check(spark, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact.exact_dedup(frame(spark, rows)).collect()
    key = lambda i, t: (i, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(key(i, low(t)) for i, t in rows)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact.drop_copies(frame(spark, rows).repartition(5))
    assert kept.schema == frame(spark, []).schema
    assert Counter((low(r.text), r.doc_id) for r in kept.collect()) == Counter({(t, best[t]): 1 for t in groups})


def test_plain_version(spark):
    check(spark, rows_of())
    check(spark, [])
    check(spark, [(None, None), (None, "")])


def test_hot_groups_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows_of())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_hashes_of_different_texts():
    """Two contents under one key, mixed, over batches of every size."""
    texts = ["b", "A", "a", "B", "b", "c", None, "", "z", "Z"]
    keys = [("h", 1)] * 6 + [("h", 2)] * 2 + [("k", 3)] * 2
    table = pa.table({"text": texts, "head": [k[0] for k in keys], "hash": [k[1] for k in keys], "id": list(range(10, 0, -1)), "row": list(range(10))})
    for size in (1, 2, 3, 10):
        out = pa.Table.from_batches(list(exact.first_rows(0, 1)(iter(table.to_batches(max_chunksize=size)))))
        assert sorted(zip(out.column("__voxelrank_row").to_pylist(), out.column("__voxelrank_edge").to_pylist())) == [(0, True), (1, True), (5, True), (6, False), (8, True)]

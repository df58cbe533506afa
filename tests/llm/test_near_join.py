"""The near-duplicate join against all pairs: recall by similarity, chains, repeated ids, long texts."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from voxelrank.llm import nearjoin

SCHEMA = "doc_id long, text string, row long, node string, band string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash", "clash") for i, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def altered(rnd, words, changes):
    w = list(words)
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"c{rnd.randrange(10**9)}"
    return " ".join(w)


def test_recall_by_similarity(spark, monkeypatch):
    """Pairs of all similarities from 0.8 on, in components that are compared whole and in ones that are not."""
    rnd = random.Random(3)
    rows = []
    for g in range(60):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        for _ in range(6):
            rows.append((len(rows), altered(rnd, words, rnd.randint(0, 6))))
    sets = [shingles(t) for _, t in rows]
    pairs = {(i, j): similarity(sets[i], sets[j]) for i in range(len(rows)) for j in range(i) if i // 6 == j // 6}
    near = {p: s for p, s in pairs.items() if s >= 0.8}
    want = Counter(x for p in near for x in p)
    assert len(near) > 300 and min(near.values()) < 0.82
    for block in (512, 3):
        monkeypatch.setattr(nearjoin, "BLOCK", block)
        got = {r.doc_id: r.n_links for r in nearjoin.near_duplicates(frame(spark, rows)).collect()}
        assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.999 * sum(want.values())


def test_chains_cost_no_more_than_their_links(spark):
    """A component of thousands, each similar to its neighbours only: comparisons grow with its length, not its square."""
    words = [f"w{i}" for i in range(25 * 2200)]
    rows = [(i, " ".join(words[25 * i : 25 * i + 200])) for i in range(2100)]  # similarity of neighbours: 0.77
    docs = frame(spark, rows).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    bands, per_band = nearjoin.bands_for(0.8, 0.9999)
    signed = nearjoin._signed(docs, 5, bands, per_band)
    reps, groups = nearjoin.candidates(signed)
    sizes = [r["count"] for r in groups.groupBy("component").count().collect()]
    assert max(sizes) > 1000
    met = nearjoin.dealt(nearjoin.rooms(reps, groups)).groupBy("room", "band", "i", "j").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("a"), F.sum("side").alias("b"))
    work = sum(r.a * (r.b or r.a) for r in met.filter("band >= 0").collect())
    assert work < 100 * max(sizes) < max(sizes) ** 2 / 10
    got = nearjoin.near_duplicates(frame(spark, rows)).collect()
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in got)


def test_rows_that_repeat_an_id_stand_for_themselves(spark):
    rnd = random.Random(6)
    one, two, three = ([f"{p}{rnd.randrange(999)}" for _ in range(200)] for p in "abc")
    rows = [(5, " ".join(one)), (5, " ".join(two)), (3, altered(rnd, one, 2)), (7, altered(rnd, two, 2)), (8, " ".join(three)), (8, " ".join(three)), (9, " ".join(three).upper()), (None, " ".join(one)), (None, None), (4, "")]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in nearjoin.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter([(5, 3, 1), (5, 5, 1), (3, 3, 1), (7, 5, 1), (8, 8, 2), (8, 8, 2), (9, 8, 2), (None, None, 0), (None, None, 0), (4, 4, 0)])
    kept = nearjoin.one_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "row", "node", "band"]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[2], rows[1], rows[4], rows[7], rows[8], rows[9]])


def test_long_and_awkward_texts(spark):
    rnd = random.Random(7)
    book = [f"w{rnd.randrange(10**5)}" for _ in range(150_000)]
    rows = [(1, " ".join(book)), (2, altered(rnd, book, 500)), (3, "x" * 1_000_000), (4, "word " * 100_000), (5, "word word word word word"), (6, "one two"), (7, "One,  two!")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in nearjoin.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 1), 5: (4, 1), 6: (6, 1), 7: (6, 1)}

"""Removal of repeats against all windows of all texts, on repeated ids, hash accidents and long texts."""

import hashlib
import random
import re

import pytest

from voxelrank.llm import repeats

SCHEMA = "doc_id long, text string, row long, start string, anchor string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, "clash", "clash") for i, t in rows], SCHEMA, verifySchema=False).coalesce(parts)


def brute(rows):
    """(id, bytes, removed, spans, digest) of each row; rows with equal ids come in table order."""
    seen, out = set(), []
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)):
        raw = (rows[k][1] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99) if rows[k][0] is not None else ():
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((rows[k][0], len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **more):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, **more).collect()), key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    say = lambda k: " ".join(rnd.choice(words) + str(rnd.randint(0, 60)) for _ in range(k))
    common, long = say(25), say(1500)
    texts = [None, "", "x", common, long, long + " tail", "ab" * 300, "a" * 700, "é漢字🙂\n" * 60, common[:99], common[:100]]
    for _ in range(n):
        texts.append(say(rnd.randint(0, 40)) + (" " + common[rnd.randint(0, 9) :] if rnd.random() < 0.6 else "") + " " + say(rnd.randint(0, 20)))
    return texts


@pytest.mark.parametrize("block", [64, 3])
def test_repeated_ids_and_rows(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    rnd = random.Random(block)
    texts = corpus(block)
    rows = [(rnd.choice([None, 1, 2, 3, *range(4, 40)]), t) for t in texts + texts[:30]]
    p = "every word of this passage stands in two rows of one id, which is long enough to count as a repeat " * 3
    rows += [(1, p), (2, "short"), (2, p), (2, p)]
    assert got(frame(spark, rows, 1)) == brute(rows)


def test_claims_that_fail_start_over(spark):
    rows = list(enumerate(corpus(5)))
    assert got(frame(spark, rows), bits=0) == brute(rows)


def test_refuted_claims_are_seen(spark):
    from pyspark.sql import functions as F

    df = frame(spark, list(enumerate(corpus(6)))).select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    texts = df.mapInArrow(repeats._pack, "doc_id long, row long, packed binary")
    assert repeats._judged(texts, False, 0, 0).filter("refuted > 0").count() > 0
    assert repeats._judged(texts, False, 0, 64).filter("refuted > 0").count() == 0


def test_hot_passage_over_many_partitions(spark):
    rnd = random.Random(2)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(160))
    rows = [(i, "".join(rnd.choice("ijklmnop ") for _ in range(rnd.randint(0, 90))) + passage + "".join(rnd.choice("ijklmnop ") for _ in range(rnd.randint(0, 90)))) for i in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(frame(spark, rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_texts_and_the_kept_text(spark, monkeypatch):
    rnd = random.Random(3)
    book = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3_000_000))
    rows = [(1, book), (2, "y" + book), (3, "z" * 400_000), (4, book[:150] + "Q")]
    out = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    assert out[1].n_removed == 0 and bytes(out[2].kept_text) == b"y" and out[2].n_spans == 1
    assert out[3].n_removed == 399_999 and bytes(out[4].kept_text) == b"Q"
    assert repeats.remove_repeats(frame(spark, [])).count() == 0

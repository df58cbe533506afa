import math
import re
from collections import Counter

import numpy as np
import pytest

from voxelrank.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, top=10):
    held = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOW)))
    out = []
    for item, q in asked.items():
        found = []
        for doc, c in held:
            m = 100 - 75 + (75 * c.total() * n) // length
            s = sum(often * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, often in q.items() if t in c)
            if s > 0:
                found.append((-s, doc is not None, doc or 0, doc))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=lambda r: r[:2])


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, item int, term string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(d, q, **how).collect()]
    return sorted(got, key=lambda r: r[:2])


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" if k % 5 else f"Wé{k}" for k in range(300)])
    p = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum())) for _ in range(n)]
    items = [(k, " ".join(rng.choice(words, rng.integers(1, 25), p=p / p.sum()))) for k in range(30)]
    return list(enumerate(texts)), items


def test_one_level_and_many_levels_give_the_same(spark):
    docs, items = corpus()
    want = brute(docs, items)
    for depth, growth in ((1000, 8), (4, 2), (1, 3)):
        used = []
        assert run(spark, docs, items, depth=depth, growth=growth, levels_used=used) == want
        assert used[-1][1] == used[-1][2] and len(used) > (depth < 100)
    assert any(level < len(used) - 1 and done for level, _, done in used)  # some are proven before the last tier


def test_small_shards_slices_and_cells_give_the_same(spark, monkeypatch):
    docs, items = corpus(120, 1)
    for name, value in (("SHARD", 7), ("PAIRS", 60), ("CELLS", 30), ("CHUNK", 5)):
        monkeypatch.setattr(lexical, name, value)
    assert run(spark, docs, items, depth=5, growth=3) == brute(docs, items)


def test_ties_copies_and_repeated_rows(spark):
    docs = [(i, "one two three") for i in range(200)] + [(5, "one two three"), (7, "ONE, two... Three"), (None, "one two three")] + [(300 + i, "four five") for i in range(40)] + [(900, "six")]
    items = [(1, "one two"), (1, "two three"), (2, "FOUR; four"), (3, "none of these"), (4, "six six one")]
    for depth in (3, 1000):
        assert run(spark, docs, items, depth=depth) == brute(docs, items)


def test_awkward_rows(spark):
    docs = [(0, None), (1, ""), (2, " \n\t.,"), (3, "a" * 3_000_000 + " b " * 50_000 + "c"), (4, "\x00b\x7f_C"), (5, "B c d"), (6, "日本語　テキスト b"), (7, "É é İ")]
    items = [(0, "b c"), (None, "b"), (2, None), (3, ""), (4, "日本語　テキスト"), (5, "a" * 3_000_000), (6, "é É i̇")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_terms_in_pieces(monkeypatch):
    text = "Ab cd,ef" * 400 + "x" * 300 + " y"
    want = Counter(t.encode() for t in TERM.findall(text.translate(LOW)))
    for chunk in (1, 7, 100, 10_000):
        monkeypatch.setattr(lexical, "CHUNK", chunk)
        assert lexical.terms(text.encode()) == want


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65])
def test_depth_of_tiers(spark, n):
    counted = spark.createDataFrame([(0, c, n, c << lexical.CLASS) for c in range(6)], "term int, class int, n long, most long")
    found = lexical.bounds(counted, 1, 1000, depth=8, growth=4)
    for level in range(len(found.cut)):
        assert n * (6 - min(found.cut[level, 0], 6)) <= 8 * 4**level
        assert found.rest[level, 0] == max((c << lexical.CLASS for c in range(6) if c < found.cut[level, 0]), default=0)
    assert found.rest[-1, 0] == 0

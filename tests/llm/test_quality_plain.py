"""The quality classifier row by row against a plain version without patterns, arrays or Spark."""

import math
import re
import zlib
from itertools import groupby

from voxelrank.llm import quality


def labels(text):
    n, words, lines = max(len(text), 1), text.split(), text.split("\n")
    again = any(all(words[i + k] == words[i] for k in range(8)) for i in range(len(words) - 7) if len(words[i]) <= 30) and bool(re.search(r"(?:^|\s)(\S{1,30})( \1){7}", text))
    measured = [
        (sum(text.count(c) for c in "&%$#*!@^~=+<>{}[]\\") / n, 0.03, 0.004, len(words) >= 3),
        (sum("A" <= c <= "Z" for c in text) / n, 0.25, 0.06, n >= 150),
        (float(again), 1, 0, len(words) >= 8),
        (len(words) / (1 + text.count(".") + text.count("!") + text.count("?")), 120, 25, len(words) >= 60),
        (text.count("|") / n, 0.02, 0.002, len(words) >= 3),
        (1 - len(set(lines)) / len(lines), 0.5, 0.15, len(lines) >= 4),
        (n / max(len(words), 1), 16, 9.5, len(words) >= 40),
    ]
    return [(-1 if v >= bad else 1 if v <= good else 0) if enough else 0 for v, bad, good, enough in measured]


def estimated(votes):
    """Posterior of each row by EM over rows."""
    good = [0.03 if -1 in v else 0.97 for v in votes]
    for _ in range(quality.EM_ROUNDS):
        wrong = [[], []]
        for c in (0, 1):
            weights = good if c else [1 - g for g in good]
            for j in range(7):
                bad, fine = (0.001, 0.999) if c else (0.4, 0.6)
                bad, fine = (x * quality.PRIOR * len(votes) for x in (bad, fine))
                for v, w in zip(votes, weights):
                    bad += w * (v[j] == -1)
                    fine += w * (v[j] == 1)
                share = bad / (bad + fine)
                wrong[c].append(min(share, quality.FALSE_ALARM) if c else share)
        prior, new = (sum(good) + 1) / (len(votes) + 2), []
        for v in votes:
            odds = math.log(prior) - math.log(1 - prior)
            for j, x in enumerate(v):
                if x == -1:
                    odds += math.log(wrong[1][j]) - math.log(wrong[0][j])
                elif x == 1:
                    odds += math.log(1 - wrong[1][j]) - math.log(1 - wrong[0][j])
            new.append(1 / (1 + math.exp(-odds)))
        good = new
    return good


def features(text):
    words, lines, out = text.split(), text.split("\n"), {}
    shape = lambda w: "".join(k for k, _ in groupby("a" if c.islower() else "A" if c.isupper() else "9" if c in "0123456789" else c for c in w))
    n, bucket = max(len(words), 1), lambda f: zlib.crc32(f.encode()) % quality.BUCKETS
    parts = [word[i : i + quality.PART] for word in words for i in range(0, len(word), quality.PART)]
    for part in parts:
        at = bucket("w:" + part if len(part) <= 4 and part.isalpha() else "s:" + shape(part))
        out[at] = out.get(at, 0) + 4 / len(parts)
    for s in (f"repeat:{int(10 * len(set(words)) / n)}", f"length:{n.bit_length()}", f"mean:{min(int(len(text) / n), 30)}", f"lines:{int(10 * len(set(lines)) / len(lines))}", f"pipes:{min(int(100 * text.count('|') / max(len(text), 1)), 20)}"):
        out[bucket(s)] = out.get(bucket(s), 0) + 1
    return out


def scored(rows, aims):
    """Logistic regression by full passes with Adagrad steps, over dictionaries."""
    w, seen, bias, seen_bias = {}, {}, 0.0, 1e-8
    p = lambda row: 1 / (1 + math.exp(-min(max(sum(w.get(k, 0.0) * v for k, v in row.items()) + bias, -40), 40)))
    for _ in range(quality.FIT_ROUNDS):
        g, g_bias = {k: 1e-5 * v for k, v in w.items()}, 0.0
        for row, aim in zip(rows, aims):
            r = (p(row) - aim) / len(rows)
            g_bias += r
            for k, v in row.items():
                g[k] = g.get(k, 0.0) + r * v
        for k, v in g.items():
            seen[k] = seen.get(k, 1e-8) + v * v
            w[k] = w.get(k, 0.0) - 0.5 * v / math.sqrt(seen[k])
        seen_bias += g_bias * g_bias
        bias -= 0.5 * g_bias / math.sqrt(seen_bias)
    return [p(row) for row in rows]


def test_row_by_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    assert len(ids) == docs.count() <= quality.SAMPLE * 9 // 10  # so that every row is in the sample
    votes = [labels(texts[i]) for i in ids]
    assert votes == [list(quality.votes(texts[i])) for i in ids]
    aims = estimated(votes)
    counts = {}
    for v in map(tuple, votes):
        counts[v] = counts.get(v, 0) + 1
    found = quality.estimate(counts)[0]
    assert max(abs(found[tuple(v)] - a) for v, a in zip(votes, aims)) < 1e-9
    want = dict(zip(ids, scored([features(texts[i]) for i in ids], aims)))
    got = {r.doc_id: r for r in quality.classify(docs).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i].score - want[i]) for i in ids) < 1e-6
    assert all(got[i].keep == (want[i] >= quality.KEEP_FROM) for i in ids if abs(want[i] - quality.KEEP_FROM) > 1e-6)
    assert {r.keep for r in got.values()} == {True, False}

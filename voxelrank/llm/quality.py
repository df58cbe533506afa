"""Quality classifier: weak labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Only the counts of their vote patterns (at most 3 to the
power of their number, whatever the corpus) reach the driver, where the accuracies are estimated
over all documents.  The posteriors label a bounded sample that fits the scorer; every document is
then scored.

The labellers' cut-offs, the EM's start and its constraints were set on the development split: the
labelled rows of sf0.01 and sf0.1.  The labelled rows of check_s and check_l are held out: they set
nothing and serve to measure only.
"""

from __future__ import annotations

import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelrank.llm.common import materialise, whole_text

#: Documents that fit the scorer, at most; its buckets; passes of EM and of the fit.
SAMPLE, BUCKETS, EM_ROUNDS, FIT_ROUNDS = 6000, 1 << 16, 60, 150
#: Features of these documents that reach the driver, at most (8 bytes each).
FEATURES = 4_000_000
#: Weight of each labeller's prior, as a share of the documents.
PRIOR = 0.05
#: Most good documents that a labeller can be believed to call bad (a constraint of the M step).
FALSE_ALARM = 0.002
#: Documents under this probability of being good are rejected.
KEEP_FROM = 0.5
#: Characters of a word that make one feature; longer words make several.
PART = 12
LABELLERS = ("signs", "capitals", "runs", "sentences", "tables", "lines", "word_length")

_SIGNS, _STOPS = list(b"&%$#*!@^~=+<>{}[]\\"), list(b".!?")
_REPEATED = re.compile(r"(?:^|\s)(\S{1,30})(?: \1){7}")


def votes(text: str) -> tuple[int, ...]:
    """Votes of the labellers for a whole text: 1 good, -1 bad, 0 none."""
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n, n_words, lines = max(len(text), 1), len(text.split()), text.split("\n")

    def vote(value: float, bad_from: float, good_to: float, enough: bool) -> int:
        return 0 if not enough else -1 if value >= bad_from else 1 if value <= good_to else 0

    return (
        vote(counts[_SIGNS].sum() / n, 0.03, 0.004, n_words >= 3),
        vote(counts[65:91].sum() / n, 0.25, 0.06, n >= 150),
        vote(bool(_REPEATED.search(text)), 1, 0, n_words >= 8),
        vote(n_words / (1 + counts[_STOPS].sum()), 120, 25, n_words >= 60),
        vote(counts[ord("|")] / n, 0.02, 0.002, n_words >= 3),
        vote(1 - len(set(lines)) / len(lines), 0.5, 0.15, len(lines) >= 4),
        vote(n / max(n_words, 1), 16, 9.5, n_words >= 40),
    )


def _votes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([list(map(int, votes(t.as_py()))) for t in b.column(0)], pa.list_(pa.int32()))], names=["votes"])


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """EM over counts of vote patterns: P(good) for each pattern, and table[class, labeller, vote+1].

    Starts from "no bad vote"; an abstention says nothing.  The prior, worth PRIOR of the documents,
    says that labellers seldom call a good document bad, and that a bad one shows to some only.
    """
    if not patterns:
        return {}, np.full((2, len(LABELLERS), 3), 1 / 3)
    keys = sorted(patterns)
    v, n = np.array(keys) + 1, np.array([patterns[k] for k in keys], float)
    good = np.where((v == 0).any(1), 0.03, 0.97)
    table = np.ones((2, v.shape[1], 3))
    for _ in range(rounds):
        for c, w in enumerate((n * (1 - good), n * good)):
            for j in range(v.shape[1]):
                hits = np.bincount(v[:, j], w, 3)[[0, 2]] + PRIOR * n.sum() * np.array([[0.4, 0.6], [0.001, 0.999]][c])
                wrong = hits[0] / hits.sum() if c == 0 else min(hits[0] / hits.sum(), FALSE_ALARM)
                table[c, j, [0, 2]] = wrong, 1 - wrong
        prior = ((n * good).sum() + 1) / (n.sum() + 2)
        log = [np.log(p) + sum(np.log(table[c, j, v[:, j]]) for j in range(v.shape[1])) for c, p in enumerate((1 - prior, prior))]
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return dict(zip(keys, good.tolist())), table


_SHAPE = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "9" for c in range(48, 58)}})
_RUN = re.compile(r"(.)\1+")


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def _word_feature(word: str) -> int:
    """Bucket of a word of at most PART characters: short words as such, others by their collapsed shape."""
    if len(word) <= 4 and word.isalpha():
        return _bucket("w:" + word)
    shape = "".join("a" if c.islower() else "A" if c.isupper() else c for c in word.translate(_SHAPE))
    return _bucket("s:" + _RUN.sub(r"\1", shape))


def document_features(text: str, cache: dict[str, int]) -> tuple[list[int], list[int]]:
    """Buckets of all words, longer ones cut into parts of PART characters, and of a few statistics of the whole text."""
    words, parts = text.split(), re.findall(rf"\S{{1,{PART}}}", text)
    got = list(map(cache.get, parts))
    if None in got:
        if len(cache) > 300_000:
            cache.clear()
        for i, f in enumerate(got):
            if f is None:
                w = parts[i]
                got[i] = cache[w] = _word_feature(w)
    n, lines = max(len(words), 1), text.split("\n")
    stats = (f"repeat:{int(10 * len(set(words)) / n)}", f"length:{min(n, 1 << 20).bit_length()}", f"mean:{min(int(len(text) / n), 30)}", f"lines:{int(10 * len(set(lines)) / len(lines))}", f"pipes:{min(int(100 * text.count('|') / max(len(text), 1)), 20)}")
    return got, list(map(_bucket, stats))


def weighed(text: str, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text as the scorer sees it: word shares times 4, and 1 for each statistic."""
    words, stats = document_features(text, cache)
    at, count = np.unique(np.asarray(words, np.int64), return_counts=True)
    return np.concatenate([at, np.asarray(stats, np.int64)]), np.concatenate([count * (4.0 / max(len(words), 1)), np.ones(len(stats))])


def fit(rows: list[tuple[str, float]], rounds: int = FIT_ROUNDS) -> tuple[np.ndarray, float]:
    """:func:`fit_features` on texts with their labels."""
    cache: dict[str, int] = {}
    return fit_features([(*weighed(text, cache), p) for text, p in rows], rounds)


def fit_features(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = FIT_ROUNDS) -> tuple[np.ndarray, float]:
    """Logistic regression on (buckets, values, soft label), full-batch with Adagrad steps."""
    if not rows:
        return np.zeros(BUCKETS), 0.0
    doc = np.repeat(np.arange(len(rows)), [len(at) for at, _, _ in rows])
    col, val = np.concatenate([at for at, _, _ in rows]), np.concatenate([v for _, v, _ in rows])
    y, n = np.array([p for *_, p in rows]), len(rows)
    w, b, seen, seen_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, val * w[col], n) + b, -40, 40)))
        r = (p - y) / n
        g = np.bincount(col, val * r[doc], BUCKETS) + 1e-5 * w
        seen += g * g
        seen_b += r.sum() ** 2
        w -= 0.5 * g / np.sqrt(seen)
        b -= 0.5 * r.sum() / np.sqrt(seen_b)
    return w, b


def _sampled(batches):
    cache: dict[str, int] = {}
    for b in batches:
        rows = [(list(map(int, votes(t.as_py()))), *weighed(t.as_py(), cache)) for t in b.column(1)]
        kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, kinds))], names=["place", "votes", "buckets", "weights"])


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", features: int = FEATURES) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, vote table): votes are counted over all rows, at most ``sample`` rows fit the scorer.

    The rows of the sample come in a fixed hash order of their places in the table, and fewer of them
    if they have more than ``features`` features in all.  Their features reach the driver, no text does.
    """
    text = whole_text(text_col).alias("text")
    voted = docs.select(text).mapInArrow(_votes, "votes array<int>")
    patterns = {tuple(r["votes"]): r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    good, table = estimate(patterns)
    total = sum(patterns.values())
    placed = docs.select(F.xxhash64(F.lit("fit"), F.monotonically_increasing_id()).alias("place"), text)
    # The hash lets through 9/10 of the sample, give or take little; the features are made where the rows are.
    few = materialise(placed.filter(F.pmod("place", F.lit(max(total, 1))) < sample * 9 // 10).mapInArrow(_sampled, "place long, votes array<int>, buckets array<int>, weights array<float>"))
    sizes = [(r["place"], r["n"]) for r in few.select("place", F.size("buckets").alias("n")).orderBy("place").limit(sample).collect()]
    room = np.searchsorted(np.cumsum([n for _, n in sizes]), features, "right")
    last = sizes[room - 1][0] if room else 0
    taken = few.filter(F.col("place") <= last).orderBy("place").collect() if room else []
    return (*fit_features([(np.array(r["buckets"], np.int64), np.array(r["weights"], float), good[tuple(r["votes"])]) for r in taken]), table)


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with P(good) of each whole text in a new column ``name``."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name!r} already")
    model = docs.sparkSession.sparkContext.broadcast((weights.tolist(), bias))
    at = docs.columns.index(text_col)
    schema = docs.select("*").schema.add(name, "double")

    def run(batches):
        w, b = model.value
        cache: dict[str, int] = {}
        for batch in batches:
            out = []
            for t in batch.column(at):
                words, stats = document_features(t.as_py() or "", cache)
                z = 4.0 * sum(map(w.__getitem__, words)) / max(len(words), 1) + sum(map(w.__getitem__, stats)) + b
                out.append(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, keep`` for each row.

    A row is kept if its score, the probability of being good, is at least KEEP_FROM; a tie with it
    is kept.  Null text is empty; repeated rows score alike; ids may be null; an empty table gives
    no rows; other columns are ignored.  All characters of a text of any length count, in one task.
    """
    w, b, _ = train(docs, sample, id_col, text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = score(slim, w, b, "doc_id", "text")
    return scored.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP_FROM).alias("keep"))


def keep_good(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, columns unchanged; rows as in :func:`classify`."""
    w, b, _ = train(docs, sample)
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return score(docs, w, b, name=name).filter(F.col(name) >= KEEP_FROM).drop(name)


def all_patterns() -> list[tuple[int, ...]]:
    """Every vote pattern there can be: the bound of what the driver gathers."""
    return list(product((-1, 0, 1), repeat=len(LABELLERS)))

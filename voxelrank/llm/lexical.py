"""Ranked lexical search over a tiered index that is sharded by documents.

Documents are packed into shards.  A posting is (term, document, share), where the share is what the
term's weight is multiplied with; a histogram of the shares of each term tells which of its postings
belong to its first tier (the highest shares, at most DEPTH of them), which to the next (at most
GROWTH times as many), and so on; the last tier has the rest.  A shard's tiers are columns of its own,
so that a search reads the high ones only.

A level of the search scores the items with the tiers read so far, term at a time into dense arrays.
No document outside these can score more than the residual bound, the sum of what the item's terms
can still give below.  If that is less than the item's tenth best score so far, the item is proven:
only documents that can reach that score are scored whole, from the shard's forward lists.  Items
without proof fall through to the next level.  Shards never meet: only the best few leave a task.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelrank.llm.common import materialise

TOP = 10
#: Postings of a term in the first tier at most, and how many times as many in each further one.
DEPTH, GROWTH = 1000, 8
#: Documents and bytes of text of a shard; bytes of a text that are split in one go; (item, term) pairs searched in one go; cells of a dense array.
SHARD, SHARD_BYTES, CHUNK, PAIRS, CELLS = 2048, 8 << 20, 1 << 20, 1_000_000, 1 << 20
#: Shards in one file of the index at most, as a reader takes a file's rows together.
TOGETHER = 4
#: Width of the classes of shares that the histogram counts, as a power of two; shares are under 10^6.
CLASS = 14
#: The weights of length and repeats in the score.
PLAIN, LENGTH, SCALE = 25, 75, 10**9

#: Bytes of ASCII letters and digits, lower-cased, and of all else from 128 on stay; the others part terms.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> Counter:
    """Terms of a UTF-8 text with their counts; a long text is split a piece at a time."""
    found, at = Counter(), 0
    text = (text or b"").translate(_FOLD)
    if len(text) <= CHUNK:
        return Counter(text.split())
    while at < len(text):
        to = text.find(b" ", at + CHUNK)
        to = len(text) if to < 0 else to
        found.update(text[at:to].split())
        at = to
    return found


class Asked(NamedTuple):
    """The (item, term) pairs that are searched in one go, items and terms by number, pairs by term."""

    items: list[int]
    words: dict[bytes, int]
    item: np.ndarray
    term: np.ndarray
    often: np.ndarray

    def only(self, live: np.ndarray) -> Asked:
        """The pairs of the items numbered ``live``, which are numbered anew."""
        at = np.flatnonzero(np.isin(self.item, live))
        return self._replace(items=[self.items[i] for i in live], item=np.searchsorted(live, self.item[at]), term=self.term[at], often=self.often[at])


class Bounds(NamedTuple):
    """Of each term: its weight, and for each level the least class that is read and the most share that is not."""

    weight: np.ndarray
    cut: np.ndarray
    rest: np.ndarray


def shards(docs: DataFrame, words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard, docs, lengths, ends, terms, counts``: documents with their lengths and the asked terms they hold."""
    out = pa.schema([("shard", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def pack(batches):
        known, number = words.value, TaskContext.get().partitionId() << 33
        held, size = ([], [], [], [], []), 0

        def cut():
            nonlocal held, size, number
            record = pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(([number], *([c] for c in held)), out) for c in c], schema=out)
            held, size, number = ([], [], [], [], []), 0, number + 1
            return record

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                found = terms(text)
                n = found.total()
                if not n:
                    continue
                own = sorted((known[t], found[t]) for t in found.keys() & known.keys())
                for to, what in zip(held, ((doc,), (n,), (len(held[3]) + len(own),), (t for t, _ in own), (c for _, c in own))):
                    to.extend(what)
                size += len(text)
                if len(held[0]) >= SHARD or size >= SHARD_BYTES:
                    yield cut()
        if held[0]:
            yield cut()

    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return slim.mapInArrow(pack, "shard long, docs array<long>, lengths array<long>, ends array<int>, terms array<int>, counts array<long>")


def _flat(batch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def shares(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What the weights of postings are multiplied with: more for more occurrences in shorter documents."""
    m = PLAIN + LENGTH * lengths * n_docs // n_terms
    return SCALE * counts // (1000 * counts + 8 * m)


def _postings(batch, row: int, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's place, term, share) of a shard, by document."""
    ends = _flat(batch, "ends", row)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return doc, _flat(batch, "terms", row), shares(_flat(batch, "counts", row), _flat(batch, "lengths", row)[doc], n_docs, n_terms)


def histogram(packed: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``term, class, n, most``: postings of each term by class of share, and their greatest share."""

    def count(batches):
        for b in batches:
            for row in range(b.num_rows):
                _, term, share = _postings(b, row, n_docs, n_terms)
                key = term.astype(np.int64) << 8 | share >> CLASS
                order = np.lexsort((share, key))
                key, share = key[order], share[order]
                last = np.r_[np.flatnonzero(np.diff(key)), len(key) - 1] if len(key) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((key[last] >> 8).astype(np.int32)), pa.array((key[last] & 255).astype(np.int32)), pa.array(np.diff(last, prepend=-1)), pa.array(share[last])], names=["term", "class", "n", "most"])

    found = packed.mapInArrow(count, "term int, class int, n long, most long")
    return found.groupBy("term", "class").agg(F.sum("n").alias("n"), F.max("most").alias("most"))


def bounds(counted: DataFrame, n_words: int, n_docs: int, depth: int = DEPTH, growth: int = GROWTH) -> Bounds:
    """Weights, tiers and residual bounds of the terms; what reaches the driver is a row for each term and tier."""
    falling = Window.partitionBy("term").orderBy(F.desc("class"))
    through = counted.withColumn("through", F.sum("n").over(falling)).withColumn("level", F.when(F.col("through") <= depth, 0).otherwise(F.ceil(F.log(F.col("through") / depth) / math.log(growth)).cast("int")))
    rows = through.groupBy("term", "level").agg(F.min("class").alias("low"), F.max("most").alias("most"), F.sum("n").alias("n")).collect()
    levels = max((r.level for r in rows), default=0) + 1
    df, cut, most = np.zeros(n_words, np.int64), np.full((levels, n_words), 256, np.int64), np.zeros((levels, n_words), np.int64)
    for r in rows:
        df[r.term] += r.n
        cut[r.level, r.term], most[r.level, r.term] = r.low, r.most
    below = np.maximum.accumulate(np.r_[most[1:], np.zeros((1, n_words), np.int64)][::-1])[::-1]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    return Bounds(weight, np.minimum.accumulate(cut), below)


def tiered(packed: DataFrame, known, n_docs: int, n_terms: int, levels: int) -> DataFrame:
    """The index: shards with their forward lists (``ends, terms, shares``) and a column ``t0, t1, ...`` for each tier.

    A tier has the terms it holds, where the postings of each end, and their documents and shares.
    """
    tier = "struct<terms:array<int>,ends:array<int>,docs:array<int>,shares:array<long>>"
    kind = pa.struct([("terms", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("shares", pa.list_(pa.int64()))])

    def deal(batches):
        cut = known.value[1].cut
        for b in batches:
            for row in range(b.num_rows):
                doc, term, share = _postings(b, row, n_docs, n_terms)
                level = (share >> CLASS < cut[:, term]).sum(0)
                order = np.argsort(term, kind="stable")
                columns = []
                for k in range(levels):
                    at = order[level[order] == k]
                    last = np.r_[np.flatnonzero(np.diff(term[at])), len(at) - 1] if len(at) else np.empty(0, np.int64)
                    columns.append({"terms": term[at][last], "ends": last + 1, "docs": doc[at], "shares": share[at]})
                kept = [b.column(f).slice(row, 1) for f in ("shard", "docs", "ends", "terms")]
                own = [*kept, pa.array([share], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([c], kind) for c in columns)], names=["shard", "docs", "ends", "terms", "shares", *(f"t{k}" for k in range(levels))])

    return packed.mapInArrow(deal, "shard long, docs array<long>, ends array<int>, terms array<int>, shares array<long>" + "".join(f", t{k} {tier}" for k in range(levels)))


def _scored(batch, row: int, level: int, asked: Asked, known: Bounds, lo: int, hi: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(score so far, residual bounds of the terms seen) of the items lo .. hi - 1 with a shard's n documents."""
    score, seen = np.zeros((hi - lo, n), np.int64), np.zeros((hi - lo, n), np.int64)
    mine = np.flatnonzero((asked.item >= lo) & (asked.item < hi))  # by term
    term, item = asked.term[mine], asked.item[mine] - lo
    worth = asked.often[mine] * known.weight[term]
    names, first = np.unique(term, return_index=True)
    first = np.r_[first, len(term)]
    for k in range(level + 1):
        tier = batch.column(f"t{k}")[row]
        own, ends, docs, share = (tier[f].values.to_numpy() for f in ("terms", "ends", "docs", "shares"))
        _, here, there = np.intersect1d(own, names, assume_unique=True, return_indices=True)
        for i, j in zip(here, there):
            at = slice(ends[i - 1] if i else 0, ends[i])
            who = slice(first[j], first[j + 1])
            cell = np.ix_(item[who], docs[at])
            score[cell] += worth[who, None] * share[at]
            if rest := known.rest[level, names[j]]:
                seen[cell] += worth[who, None] * rest
    return score, seen


def _items(asked: Asked, n: int):
    step = max(1, CELLS // max(n, 1))
    return [(lo, min(lo + step, len(asked.items))) for lo in range(0, len(asked.items), step)]


def tenths(index: DataFrame, level: int, known, asked_of, top: int) -> dict[int, int]:
    """The top-th best score so far of each item (by number), where so many documents have one."""

    def run(batches):
        asked, limits = asked_of.value, known.value[1]
        best = np.zeros((len(asked.items), top), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                n = len(b.column("docs")[row])
                for lo, hi in _items(asked, n):
                    score, _ = _scored(b, row, level, asked, limits, lo, hi, n)
                    if n > top:
                        score = np.partition(score, n - top, axis=1)[:, n - top :]
                    best[lo:hi] = np.sort(np.concatenate([best[lo:hi], score], axis=1), axis=1)[:, -top:]
        item, _ = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(best[best > 0])], names=["item", "score"])

    found = index.select("docs", *(f"t{k}" for k in range(level + 1))).mapInArrow(run, "item int, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    return {r.item: r.score for r in found.withColumn("place", place).filter(F.col("place") <= top).filter(F.col("place") == top).collect()}


def proven(index: DataFrame, level: int, known, asked_of, top: int) -> DataFrame:
    """``item, doc_id, score``: the best documents of proven items, whole scores; each task's best few of each item."""

    def run(batches):
        asked, least, limits = *asked_of.value, known.value[1]
        room = np.bincount(asked.item, asked.often * limits.weight[asked.term] * limits.rest[level, asked.term], len(asked.items)).astype(np.int64)
        pairs = np.argsort(asked.item, kind="stable")
        cut = np.searchsorted(asked.item[pairs], np.arange(len(asked.items) + 1))
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in asked.items]
        for b in batches:
            for row in range(b.num_rows):
                ids, ends, term, share = (_flat(b, f, row) for f in ("ids", "ends", "terms", "shares"))
                begin, none = np.r_[0, ends[:-1]], _flat(b, "none", row)
                for lo, hi in _items(asked, len(ids)):
                    score, seen = _scored(b, row, level, asked, limits, lo, hi, len(ids))
                    may = (score + room[lo:hi, None] - seen >= least[lo:hi, None]) & (score > 0)
                    for i in np.flatnonzero(may.any(axis=1)):
                        at = np.flatnonzero(may[i])
                        own = pairs[cut[lo + i] : cut[lo + i + 1]]
                        worth = np.zeros(len(limits.weight), np.int64)
                        worth[asked.term[own]] = asked.often[own] * limits.weight[asked.term[own]]
                        size = ends[at] - begin[at]
                        place = np.repeat(begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        whole = np.add.reduceat(worth[term[place]] * share[place], np.cumsum(size) - size)
                        s, d, z = (np.concatenate(c) for c in zip(best[lo + i], (whole, ids[at], none[at])))
                        keep = np.lexsort((d, ~z, -s))[:top]
                        best[lo + i] = s[keep], d[keep], z[keep]
        n = [len(s) for s, _, _ in best]
        s, d, z = (np.concatenate(c) for c in zip(*best))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked.items, n).astype(np.int64)), pa.array(d, mask=z), pa.array(s)], names=["item_id", "doc_id", "score"])

    ids = index.withColumns({"ids": F.transform("docs", lambda d: F.coalesce(d, F.lit(0).cast("long"))), "none": F.transform("docs", lambda d: d.isNull())})
    return ids.select("ids", "none", "ends", "terms", "shares", *(f"t{k}" for k in range(level + 1))).mapInArrow(run, "item_id long, doc_id long, score long")


def _asked(pairs: DataFrame) -> Asked:
    rows = pairs.collect()
    names = {t: k for k, t in enumerate(sorted({bytes(r.term) for r in rows}))}
    items = sorted({r.item_id for r in rows})
    place = {i: k for k, i in enumerate(items)}
    item, term, often = (np.array(c, np.int64) for c in zip(*((place[r.item_id], names[bytes(r.term)], r.often) for r in rows)))
    order = np.lexsort((item, term))
    return Asked(items, names, item[order], term[order], often[order])


def search(docs: DataFrame, items: DataFrame, top: int = TOP, depth: int = DEPTH, growth: int = GROWTH, levels_used: list | None = None) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of the highest score above 0 for each item, exact.

    Null and empty texts have no terms and match nothing; a text of any length counts whole.  Each row
    of ``docs`` is a document of its own, also where ids or rows repeat; equal scores go by ascending
    id, a null id first.  Rows that repeat an ``item_id`` are one item with the terms of all; items
    without an id are left out.  An empty table gives no rows; other columns are ignored.

    Postings are kept for terms that some item holds; counts are over all documents.  Items are
    searched in slices of about PAIRS (item, term) pairs, which bounds what is broadcast; each slice
    goes over all documents.  ``levels_used`` gets (level, items searched, items proven) of each level.
    """
    spark = docs.sparkSession

    def split(batches):
        for b in batches:
            rows = [(i, t, c) for i, text in zip(b.column(0).to_pylist(), b.column(1)) for t, c in terms(text.as_py()).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.binary(), pa.int64()))], names=["item_id", "term", "often"])

    slim = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).filter("item_id IS NOT NULL")
    pairs = materialise(slim.mapInArrow(split, "item_id long, term binary, often long").groupBy("item_id", "term").agg(F.sum("often").alias("often")))
    slices = -(-pairs.count() // PAIRS)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for k in range(slices):
        part = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        if part.isEmpty():
            continue
        asked = _asked(part)
        packed = materialise(shards(docs, spark.sparkContext.broadcast(asked.words)), TOGETHER)
        size = packed.agg(F.sum(F.size("docs").cast("long")).alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms")).first()
        if not size.docs:
            continue
        limits = bounds(histogram(packed, size.docs, size.terms), len(asked.words), size.docs, depth, growth)
        known = spark.sparkContext.broadcast((None, limits))
        levels = len(limits.cut)
        index = materialise(tiered(packed, known, size.docs, size.terms, levels), TOGETHER)
        for level in range(levels):
            tenth = tenths(index, level, known, spark.sparkContext.broadcast(asked), top)
            room = np.zeros(len(asked.items), np.int64)
            np.add.at(room, asked.item, asked.often * limits.weight[asked.term] * limits.rest[level, asked.term])
            least = np.array([tenth.get(i, 0) for i in range(len(asked.items))], np.int64)
            done = (room < least) | (room == 0)
            if levels_used is not None:
                levels_used.append((level, len(done), int(done.sum())))
            if done.any():
                sure = asked.only(np.flatnonzero(done))
                found = found.unionByName(proven(index, level, known, spark.sparkContext.broadcast((sure, least[done])), top))
            if done.all():
                break
            asked = asked.only(np.flatnonzero(~done))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")

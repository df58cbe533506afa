"""Near-duplicate join: MinHash bands find candidates, full sets of word five-grams decide.

1. Each document becomes the set of hashes of its five-word shingles; equal sets are one class
   member from here on (its representative is the least id), so copies never meet in pairs.
2. MinHash bands are shuffled as single 64-bit keys.  Only the least member of a key is linked to
   the others, and connected components of these links gather the candidates.
3. A component of at most BLOCK members is compared whole, in one matrix.  In a larger one, which
   chains of loosely similar texts make, only members that share a band key meet: each key is a
   room of its own, and a pair is counted in the first band it shares.  A key with more than BLOCK
   members is dealt out as a grid of blocks, so no task holds more than two blocks of sets.
   Tasks return link counts and a spanning forest, never the pairs themselves.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelrank.llm.common import materialise, whole_text
from voxelrank.llm.components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Members in one side of a comparison block, and buckets' expected size for small components.
BLOCK = 512

_WORD = re.compile(r"\w+")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def bands_for(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows in a band for which a pair at ``threshold`` shares a band with ``recall``."""
    best = (most, 1)
    for rows in range(1, 16):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, cache: dict[str, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` lower-case words; a shorter text is one run."""
    tokens = _WORD.findall(text.lower())
    if not tokens:
        return np.empty(0, np.uint64)
    got = list(map(cache.get, tokens))
    if None in got:
        if len(cache) > 300_000:
            cache.clear()
        for i, h in enumerate(got):
            if h is None:
                t = tokens[i]
                got[i] = cache[t] = int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    h = np.array(got, np.uint64)
    n = max(len(h) - words + 1, 1)
    total = np.full(n, np.uint64(len(h) if len(h) < words else words), np.uint64)
    for k in range(min(words, len(h))):
        total = _mix(total + h[k : k + n] * _MULT[k % 5] + np.uint64(k))
    return np.unique(total)


def signature(sets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band: the minima of ``rows`` hash functions, mixed with the band's number."""
    n = bands * rows
    salts = _mix(np.arange(1, n + 1, dtype=np.uint64) * _MULT[0])
    odd = _mix(salts) | np.uint64(1)
    low = np.empty(n, np.uint64)
    for at in range(0, n, 16):  # small slices stay in the processor's cache
        part = slice(at, at + 16)
        best = None
        for s in range(0, len(sets), 2048):
            x = (sets[None, s : s + 2048] ^ salts[part, None]) * odd[part, None]
            x = (x ^ (x >> np.uint64(29))).min(1)
            best = x if best is None else np.minimum(best, x)
        low[part] = best
    key = np.arange(bands, dtype=np.uint64)
    for row in low.reshape(bands, rows).T:
        key = _mix(key * _MULT[1] + row)
    return key


def _signed(rows: DataFrame, words: int, bands: int, per_band: int) -> DataFrame:
    """``row, doc_id, text_hash, n_shingles, set_hash, bands`` of (row, doc_id, text_hash, text)."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.string()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        cache: dict[str, int] = {}
        for batch in batches:
            out = []
            for t in batch.column(3):
                s = shingles(t.as_py(), cache, words)
                out.append((len(s), _digest(s), signature(s, bands, per_band).view(np.int64).tolist() if len(s) else []))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, schema.types[3:]))], schema=schema)

    return rows.mapInArrow(run, "row long, doc_id long, text_hash long, n_shingles long, set_hash string, bands array<bigint>")


def _digest(s: np.ndarray) -> str:
    return blake2b(s.tobytes(), digest_size=16).hexdigest()


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Replace ``text`` by its shingle set; rows whose set is not that of ``set_hash`` go, other columns stay."""
    cols = [c for c in docs.columns if c != "text"]
    schema = docs.select(*cols).schema.add("shingles", T.ArrayType(T.LongType()))

    def run(batches):
        cache: dict[str, int] = {}
        for batch in batches:
            sets = [shingles(t.as_py(), cache, words) for t in batch.column("text")]
            fine = [k for k, (s, h) in enumerate(zip(sets, batch.column("set_hash").to_pylist())) if _digest(s) == h]
            batch, sets = batch.take(pa.array(fine, pa.int64())), [sets[k].view(np.int64) for k in fine]
            ends = np.cumsum([0, *map(len, sets)])
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=[*cols, "shingles"])

    return docs.mapInArrow(run, schema)


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by slices of a 0/1 matrix product."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    lv, rv = np.concatenate(left), np.concatenate(right)
    lr = np.repeat(np.arange(len(left)), list(map(len, left)))
    rr = np.repeat(np.arange(len(right)), list(map(len, right)))
    both = np.intersect1d(lv, rv)
    li, ri = np.searchsorted(both, lv), np.searchsorted(both, rv)
    lok = (li < len(both)) & (both[np.minimum(li, len(both) - 1)] == lv) if len(both) else np.zeros(len(lv), bool)
    rok = (ri < len(both)) & (both[np.minimum(ri, len(both) - 1)] == rv) if len(both) else np.zeros(len(rv), bool)
    li, lr, ri, rr = li[lok], lr[lok], ri[rok], rr[rok]
    lo, ro = np.argsort(li, kind="stable"), np.argsort(ri, kind="stable")
    li, lr, ri, rr = li[lo], lr[lo], ri[ro], rr[ro]
    width = 4096
    for at in range(0, len(both), width):
        a, b = np.searchsorted(li, [at, at + width])
        c, d = np.searchsorted(ri, [at, at + width])
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[lr[a:b], li[a:b] - at] = 1
        y[rr[c:d], ri[c:d] - at] = 1
        out += x @ y.T
    return out


def compare_block(
    ids: np.ndarray, sides: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], threshold: float = THRESHOLD, own: bool = True, keys: np.ndarray | None = None, band: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """For members of one block pair: weighted counts of links, and the least id each is linked with here.

    ``sides`` is 0 for the first block and 1 for the second; with ``own``, the first is compared with
    itself.  Links are pairs whose exact Jaccard similarity reaches ``threshold``; with
    ``keys`` (a row of band keys for each member), only pairs whose first shared band is ``band``.
    """
    a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    b = a if own else b
    mask = None
    if keys is not None:
        mask = keys[a, band][:, None] == keys[b, band][None, :]
        for earlier in range(band):
            mask &= keys[a, earlier][:, None] != keys[b, earlier][None, :]
        if not mask.any():
            return np.zeros(len(ids)), ids.copy()
    size = np.array(list(map(len, sets)), np.float64)
    shared = _shared([sets[i] for i in a], [sets[i] for i in b]).astype(np.float64)
    union = size[a][:, None] + size[b][None, :] - shared
    linked = shared >= threshold * union - 1e-9
    if mask is not None:
        linked &= mask
    if own:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(ids))
    links[a] = linked @ weights[b]
    if not own:
        links[b] = linked.T @ weights[a]
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for k, i in enumerate(a):
        for j in b[np.flatnonzero(linked[k])]:
            x, y = root(i), root(j)
            if x != y:
                if ids[x] > ids[y]:
                    x, y = y, x
                parent[y] = x
    return links, np.array([ids[root(i)] for i in range(len(ids))])


def rooms(reps: DataFrame, groups: DataFrame) -> DataFrame:
    """Where each candidate is compared: ``node, copies, first, set_hash, component, keys, places``.

    ``groups`` has node and component.  A place is (room, band, blocks).  Small components share rooms
    by hash, under band -1; in larger ones each band key that several members have is a room.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    placed = materialise(groups.join(sizes, "component").join(reps.select("node", "copies", "first", "set_hash", "bands"), "node"))
    slim = ["node", "copies", "first", "set_hash", "component"]
    place = lambda room, band, blocks: F.struct(room.cast("long").alias("room"), band.cast("int").alias("band"), blocks.cast("int").alias("blocks"))
    small_rooms = F.lit(max(1, -(-groups.count() // BLOCK))).cast("long")
    one = place(F.pmod(F.xxhash64("component"), small_rooms), F.lit(-1), F.lit(1))
    whole = placed.filter(F.col("members") <= BLOCK).select(*slim, F.lit(None).cast("array<long>").alias("keys"), F.array(one).alias("places"))
    large = placed.filter(F.col("members") > BLOCK)
    keyed = large.select("node", F.posexplode("bands").alias("band", "room"))
    shared = materialise(keyed.groupBy("band", "room").agg(F.count("*").alias("n")).filter("n > 1"))
    met = keyed.join(shared, ["band", "room"]).groupBy("node").agg(F.collect_list(place(F.col("room"), F.col("band"), F.ceil(F.col("n") / BLOCK))).alias("places"))  # at most one for each band
    return whole.unionByName(large.join(met, "node").select(*slim, F.col("bands").alias("keys"), "places"))


def dealt(placed: DataFrame) -> DataFrame:
    """One row for each block that a candidate's own block meets: its own stands first (side 0) if it is not the later one."""
    keep = [c for c in placed.columns if c not in ("places", "first", "set_hash")]
    at = placed.select(*keep, F.explode("places").alias("place")).select(*keep, "place.*")
    block = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks").cast("long")).cast("int")
    met = at.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(*keep, "room", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("other") >= F.col("block"), 0).otherwise(1).alias("side"))


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        band = int(pdf["band"].iloc[0])
        by = pdf.groupby("component", sort=False).indices if band < 0 else {0: np.arange(len(pdf))}
        ids, sides, weights, sets = pdf["node"].to_numpy(), pdf["side"].to_numpy(), pdf["copies"].to_numpy(float), [np.asarray(s) for s in pdf["shingles"]]
        keys = np.stack(pdf["keys"]) if band >= 0 else None
        own = bool((pdf["i"] == pdf["j"]).iloc[0])
        out = []
        for at in by.values():
            n, low = compare_block(ids[at], sides[at], weights[at], [sets[k] for k in at], threshold, own, keys, band)
            out.append(pd.DataFrame({"node": ids[at], "links": n.astype(np.int64), "low": low, "apart": band >= 0}))
        return pd.concat(out)

    return run


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each distinct set: node, set_hash, copies, first, n_shingles, bands; node and component of the linked ones)."""
    real = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "row", "text_hash")).alias("first")
    reps = real.groupBy("set_hash").agg(first, F.count("*").alias("copies"), F.min("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
    reps = materialise(reps.withColumn("node", F.monotonically_increasing_id()))  # written, so that it stays a set's own
    keyed = reps.select("node", F.explode("bands").alias("key"))
    meets = materialise(keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("key", "lead"))  # so that hot keys can be split in the join
    edges = keyed.join(meets, "key").filter("node != lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    return reps, materialise(components(edges))


def _classes(rows: DataFrame, words: int, threshold: float, recall: float) -> DataFrame:
    """The result of :func:`near_duplicates` with ``row``, and whether the row is its class's ``leader``."""
    bands, per_band = bands_for(threshold, recall)
    rows = rows.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = materialise(_signed(rows, words, bands, per_band))
    reps, groups = candidates(signed)
    asked = rooms(reps, groups)
    at = asked.select("*", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    texts = rows.filter("doc_id IS NOT NULL").select("doc_id", "text_hash", "text").join(at, ["doc_id", "text_hash"]).drop("doc_id", "text_hash")
    seen = materialise(dealt(_sets(texts, words)).groupBy("room", "band", "i", "j").applyInPandas(_compare(threshold), "node long, links long, low long, apart boolean"))
    links = seen.groupBy("node").agg(F.sum("links").alias("links"), F.min("low").alias("low"))
    over = components(seen.filter("apart AND low != node").select(F.col("node").alias("u"), F.col("low").alias("v"))).select("node", F.col("component").alias("over"))
    grouped = links.join(over, "node", "left").select("node", "links", F.coalesce("over", "low").alias("class"))
    named = materialise(reps.select("node", "set_hash", "copies", "first").join(grouped, "node", "left").select("set_hash", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("class", "node").alias("class")))
    heads = materialise(named.groupBy("class").agg(F.min("first").alias("head")))
    told = named.join(heads, "class").select("set_hash", "links", F.col("first.doc_id").alias("copy"), F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("head_row"))
    real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return signed.drop("bands", "text_hash").join(told, "set_hash", "left").select(
        "doc_id",
        F.when(real, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(real, F.col("links")).otherwise(0).alias("n_links"),
        F.when(real, F.col("copy")).otherwise(F.col("doc_id")).alias("copy_of"),
        "n_shingles",
        "row",
        F.when(real, F.col("row") == F.col("head_row")).otherwise(True).alias("leader"),
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links, copy_of, n_shingles`` for each row.

    ``class_id`` is the least id that links reach, ``n_links`` the number of other rows with Jaccard
    similarity of at least ``threshold`` (copies counted), ``copy_of`` the least id with the same
    shingles.  A pair at ``threshold`` is found with probability ``recall``, nearer ones more surely.
    Texts without words (null, empty, signs only) are in no class but their own; shorter texts are
    one shingle; each row stands for itself, also where rows repeat an id; rows with a null id come
    back unlinked; an empty table gives no rows; other columns are ignored.  A very long text is one
    set of 8 bytes a word in a task.  Exact link counts of texts that all share a band take work with
    the square of their number.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return _classes(rows, words, threshold, recall).drop("row", "leader")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the first one with the least id; columns unchanged.

    Rows without words and rows with a null id stay.
    """
    key = "__voxelrank_row"
    numbered = materialise(docs.withColumn(key, F.monotonically_increasing_id()))  # written, so that it stays a row's own
    rows = numbered.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    gone = materialise(_classes(rows, WORDS, THRESHOLD, RECALL).filter("NOT leader").select(F.col("row").alias(key)))
    return numbered.join(gone, key, "left_anti").select(*docs.columns)

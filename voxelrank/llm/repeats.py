"""Removal of repeated byte strings across a corpus with suffix arrays.

Two equal windows of WINDOW bytes hold the same least 24-byte hash at the same place (their
anchor), so comparing all windows needs comparing only windows with equal anchors:

1. Each document emits its anchors: hash, the first window with this anchor, how many follow, and a
   hash of all bytes these windows cover (the context).  One row for about 39 bytes of text.
2. One range sort by (anchor, context, place) puts equal contexts side by side.  A context that
   follows an equal one claims to repeat that neighbour; a hot anchor or context spreads over as
   many partitions as it fills.
3. Anchors with several distinct contexts are decided on bytes: contexts are cut from their texts, a
   suffix array orders them, and neighbouring suffixes that agree on WINDOW bytes are repeats of
   the earliest.  An anchor with more contexts than BLOCK, or one that meets the end of a batch or a
   partition, is dealt out in blocks; windows that are earliest in their block meet in a second
   range sort by a 128-bit hash, and claim to repeat their neighbour.
4. Claims of a document that follow one another become spans.  The bytes each span claims to repeat
   are fetched and compared; only then is it removed.  A claim that fails (two hashes agreed by
   chance) starts the job over with other hashes, so the result never rests on a hash.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelrank.llm.common import materialise, whole_text
from voxelrank.llm.suffixes import GUARD, SENTINEL, suffix_arrays

WINDOW, GRAM = 100, 24
#: Contexts in one suffix array at most, symbols sorted in one go, bytes anchored in one go.
BLOCK, SYMBOLS, SLICE = 64, 1_500_000, 1 << 17
#: Bytes of texts opened in one go, bytes of a span compared in one go, tries with other hashes.
OPENED, SPAN, TRIES = 4 << 20, 1 << 20, 8
#: Marks the end of a context inside a string of the suffix array.
BREAK = 2


@lru_cache(maxsize=4)
def _constants(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random 64-bit values of the bytes, and odd multipliers."""
    rng = np.random.default_rng(20 + seed)
    of_byte = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, np.uint64)
    return of_byte, rng.integers(0, 1 << 63, 24, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the 24 bytes from each position, by doubling: 1, 2, 4, 8, 16, then 16 + 8."""
    of_byte, odd = _constants(seed)
    h = of_byte[data]
    for level in range(4):
        m = 1 << level
        h = h[:-m] * odd[level] + h[m:]
        if level == 2:
            eight = h
    return _mix(h[:-8] * odd[5] + eight[16:])


def anchors(data: np.ndarray, base: int, owner: np.ndarray, last: np.ndarray, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(anchor, context hash, first window, number of windows, document) of each run of windows with one anchor.

    ``owner`` has the document of each window's start, ``last`` the ends of the documents.
    """
    n = len(data)
    h, odd = gram_hashes(data, seed), _constants(seed)[1]
    span = WINDOW - GRAM + 1  # grams in a window
    # Least hash, leftmost among equals: 40 bits of the hash over 24 bits of the position.
    low = np.uint64((1 << 24) - 1)
    k = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    m = 1
    while 2 * m <= span:
        k = np.minimum(k[:-m], k[m:])
        m *= 2
    k = np.minimum(k[: n - WINDOW + 1], k[span - m : span - m + n - WINDOW + 1])
    at = (k & low).astype(np.int64)
    inside = np.arange(base + WINDOW, base + n + 1) <= last[owner]
    turn = np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]
    turn[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(turn)
    count = np.diff(np.r_[first, len(at)])
    ok = inside[first]
    first, count = first[ok], count[ok]
    p, end = at[first], first + count - 1 + WINDOW
    c = (count.astype(np.uint64) << np.uint64(16)) | (p - first).astype(np.uint64)
    for step in range(4):
        c = _mix(c * odd[8] + h[first + GRAM * step] * odd[9 + step])
        c = _mix(c * odd[14] + h[end - GRAM * (step + 1)] * odd[15 + step])
    return h[p].view(np.int64), c.view(np.int64), first + base, count, owner[first]


def _pack(batches):
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press.compress(t.as_py().encode()) for t in b.column(2)], pa.binary())], names=["doc_id", "row", "packed"])


def _opened(batches):
    """(ids, rows, ends of the texts, all their bytes) of a few texts at a time."""
    opener = zstandard.ZstdDecompressor()
    ids, rows, raw, size = [], [], [], 0
    for b in batches:
        for doc_id, row, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            text = opener.decompress(packed.as_py())
            ids.append(doc_id)
            rows.append(row)
            raw.append(text)
            size += len(text)
            if size >= OPENED:
                yield np.array(ids), np.array(rows), np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
                ids, rows, raw, size = [], [], [], 0
    if raw:
        yield np.array(ids), np.array(rows), np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)


def _anchor_rows(seed: int, bits: int):
    """Anchors of all texts, taken over slices of their concatenation; windows over a border of texts are left out."""
    names = ["anchor", "context", "doc_id", "row", "start", "windows"]

    def run(batches):
        for ids, rows, ends, data in _opened(batches):
            first, last = ends[:-1], ends[1:]
            for at in range(0, max(len(data) - WINDOW + 1, 0), SLICE):
                part = data[at : at + SLICE + WINDOW - 1]
                owner = np.repeat(np.arange(len(ids)), np.diff(np.r_[at, np.clip(last, at, at + len(part) - WINDOW + 1)]))
                a, c, s, w, o = anchors(part, at, owner, last, seed)
                if bits < 64:
                    c = c & ((1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, c, ids[o], rows[o], s - first[o], w.astype(np.int32))], names=names)

    return run


_MET = "doc_id long, row long, start long, end long, src_row long, src_start long, anchor long, block long, cross boolean"
_CLAIM = pa.schema([(n, pa.int64()) for n in ("row", "start", "end", "src_row", "src_start")])


def _meet(batches):
    """Rows sorted by (anchor, context, place) -> claims to repeat the row before, and contexts of anchors that have several.

    Contexts of an anchor are numbered along the partition and dealt to blocks by their number.
    Anchors that a batch does not hold whole, such as those at the partition's ends, have ``cross`` set.
    """
    names = [f.split()[0] for f in _MET.split(", ")]
    base = TaskContext.get().partitionId() << 32
    last, kinds, held = None, 0, None  # the row before; contexts of the running anchor; its first one, if not given out

    def contexts(doc, row, start, end, anchor, number, cross):
        none = pa.nulls(len(row), pa.int64())
        return pa.RecordBatch.from_arrays([*map(pa.array, (doc, row, start, end)), none, none, pa.array(anchor), pa.array(base + number // BLOCK), pa.array(cross)], names=names)

    def alone(x):
        return contexts(*(np.array([v]) for v in x), np.array([0]), np.array([True]))

    for b in batches:
        if not b.num_rows:
            continue
        a, c, d, r, s, w = (b.column(i).to_numpy() for i in range(6))
        e = s + w - 1 + WINDOW
        new = np.r_[last is None or a[0] != last[0], a[1:] != a[:-1]]
        kind = new | np.r_[last is not None and c[0] != last[1], c[1:] != c[:-1]]
        again = np.flatnonzero(~kind)
        from_r, from_s = np.r_[last[2] if last else 0, r[:-1]], np.r_[last[3] if last else 0, s[:-1]]
        none = pa.nulls(len(again), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(x[again]) for x in (d, r, s, e, from_r, from_s)), none, none, pa.nulls(len(again), pa.bool_())], names=names)
        at = np.flatnonzero(kind)
        if len(at):
            lead, order = new[at], np.arange(len(at))
            turn = np.maximum.accumulate(np.where(lead, order, -1))
            number = np.where(turn >= 0, order - turn, order + kinds)
            group = np.cumsum(lead)
            many = np.bincount(group)
            cross = (many > BLOCK)[group] | (group == group[-1]) | (group == (1 if last is None else 0))
            given = (number > 0) | (np.r_[number[1:], 0] == 1)
            if last is None:
                given[0] = True
            if held and number[0] == 1:
                yield alone(held)
            o = at[given]
            yield contexts(d[o], r[o], s[o], e[o], a[o], number[given], cross[given])
            held = None if given[-1] else tuple(x[at[-1]] for x in (d, r, s, e, a))
            kinds = int(number[-1]) + 1
        last = a[-1], c[-1], r[-1], s[-1]
    if held:
        yield alone(held)


def _cut(names, kinds):
    """Rows sorted by (row, ord), each text before what is asked of it -> the asked columns and bytes."""

    def run(batches):
        opener, raw = zstandard.ZstdDecompressor(), b""
        for b in batches:
            packed, start, end = b.column("packed"), b.column("start").to_pylist(), b.column("end").to_pylist()
            keep, out, size, asked = [], [], 0, b.column("ord").to_pylist()
            for i, one in enumerate(asked):
                if not one:
                    raw = opener.decompress(packed[i].as_py())
                    continue
                keep.append(i)
                out.append(raw[start[i] : end[i]])
                size += len(out[-1])
                if size >= 16 * SPAN:
                    yield cut(b, keep, out)
                    keep, out, size = [], [], 0
            yield cut(b, keep, out)

    def cut(b, keep, out):
        at = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in names), pa.array(out, pa.binary())], names=kinds)

    return run


def repeated_windows(group: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which windows of each context repeat an earlier one of its group.

    Contexts come sorted by ``group`` (0, 1, ...), with their document, row, start, length and, in one
    array, bytes.  Returns for all windows, in order: whether it repeats, whether it is the earliest
    of its kind in the group, its context, its place in the document, and its place in ``raw``.
    """
    n, groups = len(group), int(group[-1]) + 1
    from_raw = np.cumsum(size) - size
    # In front of context i of group g stand g + 1 guards, g sentinels and i breaks.
    ctx_at = from_raw + 2 * group + 1 + np.arange(n)
    text = np.full(len(raw) + n + 2 * groups, BREAK, np.int32)
    text[np.repeat(ctx_at - from_raw, size) + np.arange(len(raw))] = raw.astype(np.int32) + 3
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    off = np.r_[ctx_at[heads] - 1, len(text)]
    text[off[:-1]], text[off[1:] - 1] = GUARD, SENTINEL
    sa = suffix_arrays(text, off)
    owner = np.searchsorted(ctx_at, sa, "right") - 1
    inside = (owner >= 0) & (sa + WINDOW <= (ctx_at + size)[np.maximum(owner, 0)])
    sa, owner = sa[inside], owner[inside]  # windows only, still in suffix order
    here = sa - ctx_at[owner]
    view = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)
    at = from_raw[owner] + here
    same = np.zeros(len(sa), bool)
    for lo in range(1, len(sa), 20_000):
        hi = min(lo + 20_000, len(sa))
        x, y = at[lo:hi], at[lo - 1 : hi - 1]
        close = np.flatnonzero((raw[x] == raw[y]) & (raw[x + WINDOW // 2] == raw[y + WINDOW // 2]) & (raw[x + WINDOW - 1] == raw[y + WINDOW - 1]))
        same[lo + close] = (view[x[close]] == view[y[close]]).all(1)
    same[1:] &= group[owner[1:]] == group[owner[:-1]]
    kind = np.cumsum(~same) - 1
    place = start[owner] + here
    order = np.lexsort((place, row[owner], doc[owner], kind))
    head = np.r_[True, kind[order][1:] != kind[order][:-1]]
    earliest = np.flatnonzero(head)[np.cumsum(head) - 1]
    r, s = row[owner][order], place[order]
    later = (r != r[earliest]) | (s != s[earliest])
    back = np.argsort(at[order], kind="stable")
    return later[back], head[back], owner[order][back], s[back], at[order][back]


def _window_keys(raw: np.ndarray, at: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the window at each place."""
    h, odd = gram_hashes(raw, seed), _constants(seed)[1]
    x = np.zeros(len(at), np.uint64)
    y = np.full(len(at), 7, np.uint64)
    for step, shift in enumerate((0, GRAM, 2 * GRAM, 3 * GRAM, WINDOW - GRAM)):
        x = _mix(x * odd[8] + h[at + shift] * odd[9 + step])
        y = _mix(y * odd[21] + (h[at + shift] ^ x) * odd[14 + step])
    return x.view(np.int64), y.view(np.int64)


def _sort_blocks(seed: int):
    """Rows sorted by (anchor, block) -> intervals to remove, and the windows that must meet other blocks."""
    names = ["doc_id", "row", "start", "end", "key1", "key2"]

    def emit(table):
        anchor, block, cross, doc, row, start = (table.column(i).to_numpy() for i in range(6))
        size = pc.binary_length(table.column(6)).to_numpy().astype(np.int64)
        raw = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint8)
        group = np.cumsum(np.r_[0, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])])
        later, head, owner, place, at = repeated_windows(group, doc, row, start, size, raw)
        joined = np.r_[False, (owner[1:] == owner[:-1]) & later[1:] & later[:-1]]
        run, stop = later & ~joined, later & ~np.r_[joined[1:], False]
        none = pa.nulls(int(run.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(doc[owner[run]]), pa.array(row[owner[run]]), pa.array(place[run]), pa.array(place[stop] + WINDOW), none, none], names=names)
        over = np.flatnonzero(head & cross[owner])
        for lo in range(0, len(over), 200_000):
            o = over[lo : lo + 200_000]
            x, y = _window_keys(raw, at[o], seed)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (doc[owner[o]], row[owner[o]], place[o], place[o] + WINDOW, x, y)], names=names)

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(6).nbytes
            if size > SYMBOLS:
                table = pa.Table.from_batches(held).combine_chunks()
                anchor, block = table.column(0).to_numpy(), table.column(1).to_numpy()
                ends = np.flatnonzero((anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]))
                if len(ends):  # the last group may go on
                    yield from emit(table.slice(0, ends[-1] + 1))
                    held = table.slice(ends[-1] + 1).to_batches()
                    size = sum(x.column(6).nbytes for x in held)
        if held and (table := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield from emit(table)

    return run


def _pair(batches):
    """Windows sorted by (keys, place) -> claims to repeat the window before, and the windows at the partition's two ends, with keys."""
    names = [*_CLAIM.names, "doc_id", "key1", "key2"]
    before = None

    def end(x):
        x, y, d, r, s = ([v] for v in x)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (r, s, [s[0] + WINDOW], [None], [None], d, x, y)], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        x, y, d, r, s = (b.column(n).to_numpy() for n in ("key1", "key2", "doc_id", "row", "start"))
        if before is None:
            yield end((x[0], y[0], d[0], r[0], s[0]))
        x0, y0, _, r0, s0 = before or (x[0] + 1, 0, 0, 0, 0)
        same = np.flatnonzero(np.r_[(x[0] == x0) & (y[0] == y0), (x[1:] == x[:-1]) & (y[1:] == y[:-1])])
        none = pa.nulls(len(same), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (r[same], s[same], s[same] + WINDOW, np.r_[r0, r[:-1]][same], np.r_[s0, s[:-1]][same])), none, none, none], names=names)
        before = x[-1], y[-1], d[-1], r[-1], s[-1]
    if before is not None:
        yield end(before)


def _spans(batches):
    """Claims sorted by (row, source, distance, start) -> spans of at most SPAN bytes."""
    held = None

    def pieces(row, start, end, src, src_start):
        n = -(-(end - start) // SPAN)
        if not len(n) or n.max() <= 1:
            cols = row, start, end, src, src_start
        else:
            i = np.repeat(np.arange(len(n)), n)
            add = (np.arange(len(i)) - (np.cumsum(n) - n)[i]) * SPAN
            cols = row[i], start[i] + add, np.minimum(end[i], start[i] + add + SPAN), src[i], src_start[i] + add
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_CLAIM)

    for b in batches:
        if not b.num_rows:
            continue
        r, s, e, q, t = (b.column(n).to_numpy() for n in _CLAIM.names)
        if held:
            r, s, e, q, t = (np.r_[h, v] for h, v in zip(held, (r, s, e, q, t)))
        turn = np.r_[True, (r[1:] != r[:-1]) | (q[1:] != q[:-1]) | (s[1:] - t[1:] != s[:-1] - t[:-1])]
        group = np.cumsum(turn) << 40
        reach = np.maximum.accumulate(group + e)
        turn[1:] |= group[1:] + s[1:] > reach[:-1]
        at = np.flatnonzero(turn)
        far = (reach - group)[np.r_[at[1:] - 1, len(r) - 1]]
        held = r[at[-1]], s[at[-1]], far[-1], q[at[-1]], t[at[-1]]
        at, far = at[:-1], far[:-1]
        yield pieces(r[at], s[at], far, q[at], t[at])
    if held:
        yield pieces(*(np.array([v]) for v in held))


def _apply(keep_text: bool):
    """Rows sorted by (row, ord, start): each text, then the intervals to remove, claimed ones with the bytes they repeat."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "refuted"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]

    def run(batches):
        opener, raw, doc_id, here = zstandard.ZstdDecompressor(), None, None, None
        kept, at, n_spans, removed, refuted = [], 0, 0, 0, 0

        def done():
            rest = b"".join([*kept, raw[at:]])
            return doc_id, len(raw), removed, n_spans, hashlib.sha256(rest).hexdigest(), rest if keep_text else None, refuted

        for b in batches:
            rows, size = [], 0
            cols = (b.column(n).to_pylist() for n in ("ord", "doc_id", "start", "end"))
            packed, claimed = b.column("packed"), b.column("bytes")
            for i, (one, ident, start, end) in enumerate(zip(*cols)):
                if not one:
                    if raw is not None:
                        rows.append(done())
                        size += len(rows[-1][5] or b"")
                        if size >= 16 * SPAN:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                    raw, doc_id = opener.decompress(packed[i].as_py()), ident
                    kept, at, n_spans, removed, refuted = [], 0, 0, 0, 0
                    here = -1
                    continue
                if (other := claimed[i].as_py()) is not None and raw[start:end] != other:
                    refuted += 1
                elif start > here:
                    kept.append(raw[at:start])
                    n_spans += 1
                    removed += end - start
                    at = here = end
                elif end > here:
                    removed += end - here
                    at = here = end
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=names)
        if raw is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(done(), kinds)], names=names)

    return run


def _asked(texts: DataFrame, asks: DataFrame) -> DataFrame:
    """Each text followed by what is asked of it, sorted by (row, ord, start); one text at a time is held."""
    both = texts.withColumn("ord", F.lit(0)).unionByName(asks.withColumn("ord", F.lit(1)), allowMissingColumns=True)
    return both.repartition("row").sortWithinPartitions("row", "ord", "start")


def _judged(texts: DataFrame, keep_text: bool, seed: int, bits: int) -> DataFrame:
    """Results for ``texts`` (doc_id, row, packed) under the hashes of ``seed``, with the number of refuted claims."""
    rows = texts.filter("doc_id IS NOT NULL").mapInArrow(_anchor_rows(seed, bits), "anchor long, context long, doc_id long, row long, start long, windows int")
    key = ["anchor", "context", "doc_id", "row", "start"]
    met = materialise(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_meet, _MET))
    slim = texts.select("row", "packed")
    kinds = met.filter("src_row IS NULL").select("doc_id", "row", "start", "end", "anchor", "block", "cross")
    cut = _asked(slim, kinds).mapInArrow(
        _cut(["anchor", "block", "cross", "doc_id", "row", "start"], ["anchor", "block", "cross", "doc_id", "row", "start", "bytes"]), "anchor long, block long, cross boolean, doc_id long, row long, start long, bytes binary"
    )
    decided = materialise(cut.repartition("anchor", "block").sortWithinPartitions("anchor", "block").mapInArrow(_sort_blocks(seed), "doc_id long, row long, start long, end long, key1 long, key2 long"))
    key = ["key1", "key2", "doc_id", "row", "start"]
    crossing = decided.filter("key1 IS NOT NULL").select(*key)
    paired = materialise(crossing.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_pair, ", ".join(f"{n} long" for n in [*_CLAIM.names, "doc_id", "key1", "key2"])))
    # Neighbours over a border of partitions: two rows of each partition, whatever the corpus.
    place = F.struct("doc_id", "row", "start")
    ends = paired.filter("key1 IS NOT NULL").select("key1", "key2", "doc_id", "row", "start", "end")
    least = ends.groupBy("key1", "key2").agg(F.min(place).alias("low"))
    over = ends.join(least, ["key1", "key2"]).filter(place > F.col("low")).select("row", "start", "end", F.col("low.row").alias("src_row"), F.col("low.start").alias("src_start"))
    claims = met.filter("src_row IS NOT NULL").select(*_CLAIM.names).unionByName(paired.filter("src_row IS NOT NULL").select(*_CLAIM.names)).unionByName(over)
    far = claims.withColumn("far", F.col("start") - F.col("src_start")).repartition("row").sortWithinPartitions("row", "src_row", "far", "start")
    spans = far.select(*_CLAIM.names).mapInArrow(_spans, ", ".join(f"{n} long" for n in _CLAIM.names))
    wanted = spans.select(F.col("src_row").alias("row"), F.col("src_start").alias("start"), (F.col("src_start") + F.col("end") - F.col("start")).alias("end"), F.col("row").alias("to_row"), F.col("start").alias("to_start"), F.col("end").alias("to_end"))
    fetched = _asked(slim, wanted).mapInArrow(_cut(["to_row", "to_start", "to_end"], ["row", "start", "end", "bytes"]), "row long, start long, end long, bytes binary")
    removed = fetched.unionByName(decided.filter("key1 IS NULL").select("row", "start", "end"), allowMissingColumns=True)
    return _asked(texts, removed).mapInArrow(_apply(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary, refuted long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, bits: int = 64) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row, and ``kept_text`` unless not wanted.

    Every byte covered by a WINDOW-byte string that also starts earlier (smaller id, or earlier in
    the same text) goes; strings are judged on the input.  Null text is empty; a row with a null id
    takes no part and comes back whole; rows that repeat an id are texts of their own, the one
    that stands earlier in the table (partition, then place) being the earlier; an empty table gives
    no rows; other columns are ignored.  A text may be of any length that a row can hold; one at a
    time is in a task's memory, and what is removed from it streams past in order.  ``kept_text`` is
    binary, as cuts may split characters.  ``bits`` of a context's hash count on the first try:
    fewer than 64 are for tests.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), whole_text(text_col).alias("text"))
    texts = materialise(slim.mapInArrow(_pack, "doc_id long, row long, packed binary"))
    for seed in range(TRIES):
        got = materialise(_judged(texts, keep_text, seed, 64 if seed else bits))
        if not got.filter("refuted > 0").limit(1).count():
            return got.drop("refuted", *([] if keep_text else ["kept_text"]))
    raise RuntimeError("hashes of different bytes agreed under every seed")

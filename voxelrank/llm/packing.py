"""Best-fit packing of token sequences by bin completion over the histogram of piece lengths.

Only 2048 lengths exist, so the corpus reduces to at most that many counts, whatever its size.
The search runs on these counts; its plan (length, rank range -> sequence, offset) is joined back
to the pieces by their rank among pieces of equal length, which each task numbers on its own.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelrank.llm.common import materialise, tokenizer_path, whole_text

CAPACITY = 2048
#: Search effort: nodes of the branch and bound, fillings kept and steps spent for each node.  Where it
#: ends the search before the tree does, the packing is marked as not proven.
NODES, WIDTH, STEPS = 6000, 4, 80
#: White space in a row that the faster loop gets at most; its pattern gives up near a million.
BLANKS = 100_000
#: Fixed value: the pattern that a ByteLevel pre-tokenizer with ``use_regex`` stands for.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BLANK = re.compile(r"\s+")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """An encoder of the tokenizers file ``path``: text -> ids as an unsigned 32-bit array.

    A plain byte-level file runs on a faster merge loop, with the file's own pattern, vocabulary,
    merge order (an id's order is its merge's order) and added tokens, which are found in texts
    first, as the library does: the same ids at a third of its CPU time; tests hold the two against
    each other.  A file of any other make is run by the library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(Path(path).read_text())
    split, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
    plain = (
        (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
        and model["type"] == "BPE"
        and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
    )
    if not plain:
        library = Tokenizer.from_file(path)
        return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
    whole = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> np.ndarray:
        if len(text) > BLANKS and any(m.end() - m.start() > BLANKS for m in _BLANK.finditer(text)):
            return np.array(whole().encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    return encode


def token_bytes(texts, path: str):
    """For each text, its ids as little-endian unsigned 32-bit bytes."""
    encode = _encoder(path)
    for text in texts:
        yield encode(text).tobytes()


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, pid, nth``; nth numbers equal lengths inside partition pid."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("pid", pa.int32()), ("nth", pa.int64())])

    def cut(batches):
        pid, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            texts = (t.as_py() for t in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), token_bytes(texts, path)):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                end, k, start = (n - 1) % capacity + 1, 0, 0
                while start < n:
                    rows.append((doc_id, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), pid, seen[end - start]))
                    seen[end - start] += 1
                    start, end, k = end, end + capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, schema.types)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (lengths of one bin, number of such bins)."""
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room, lengths, n):
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append([lengths, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (at := bisect.bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            lengths, n = by_room[room][-1]
            use = min(n, left)
            by_room[room][-1][1] -= use
            if use == n:
                by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            put(room - length, lengths + (length,), use)
            left -= use
        each = capacity // length
        if left >= each:
            put(capacity - each * length, (length,) * each, left // each)
        if left % each:
            put(capacity - left % each * length, (length,) * (left % each), 1)
    return [(lengths, n) for bins in by_room.values() for lengths, n in bins if n]


def _dominated(filling: tuple[int, ...], waste: int, spare) -> bool:
    """Whether one unused longer piece could stand for one or two of the filling's pieces without overflow."""
    ones = sorted(set(filling))
    twos = {a + b for i, a in enumerate(ones) for b in ones[i + 1 :]} | {2 * a for a in ones if filling.count(a) > 1}
    return any(spare(s + 1, s + waste) for s in ones) or any(spare(s, s + waste) for s in twos)


def _fillings(room: int, lengths: list[int], left: list[int]) -> tuple[list[tuple[int, ...]], bool]:
    """(undominated multisets of available lengths within ``room``, least waste first; whether these are all there are).

    WIDTH and STEPS end the enumeration early; the second value then is False.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    steps, full = STEPS, 0

    def walk(room, below, chosen):
        nonlocal steps, full
        at = bisect.bisect_right(lengths, min(room, below)) - 1
        grew = False
        while at >= 0:
            length = lengths[at]
            if left[length] > 0:
                if steps <= 0 or full >= WIDTH:
                    break
                steps -= 1
                grew = True
                left[length] -= 1
                walk(room - length, length, chosen + (length,))
                left[length] += 1
            at -= 1
        if not grew:
            found.append((room, chosen))
            full += room == 0

    walk(room, room, ())
    whole = steps > 0 and full < WIDTH
    good = []
    for waste, f in sorted(set(found), key=lambda f: (f[0], [-x for x in f[1]])):
        for x in f:
            left[x] -= 1

        def spare(lo, hi):
            at = bisect.bisect_left(lengths, lo)
            while at < len(lengths) and lengths[at] <= hi:
                if left[lengths[at]] > 0:
                    return True
                at += 1
            return False

        if not waste or not _dominated(f, waste, spare):
            good.append(f)
        for x in f:
            left[x] += 1
    if not good:  # each of the found is dominated by one that the limits left out
        good, whole = [min(found, key=lambda f: f[0])[1]], False
    return good[:WIDTH], whole and len(good) <= WIDTH


def least_bins(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """A lower bound: for each limit, pieces that leave less room than it fill bins alone, the others share what is left."""
    lengths = sorted(counts)
    number, total = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for length in lengths:
        number[length], total[length] = counts[length], length * counts[length]
    n, t = np.cumsum(number), np.cumsum(total)
    best, half = 0, capacity // 2
    for limit in range(half + 1):
        alone = n[capacity] - n[capacity - limit]  # longer than capacity - limit
        over_half = n[capacity - limit] - n[half]
        low = t[half] - (t[limit - 1] if limit else 0)  # limit .. half
        room = over_half * capacity - (t[capacity - limit] - t[half])
        best = max(best, int(alone + over_half + max(0, -(-(low - room) // capacity))))
    return best


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[tuple[tuple[int, ...], int]], bool]:
    """(bins as (lengths of one bin, number of such bins), whether no packing can have fewer bins).

    Depth-first branch and bound.  A node fills the bin of the longest remaining piece with an
    undominated filling, as many times as the counts allow, and later once only, so that every mix
    of fillings is reached.  It is pruned when the bins so far and the waste bound (ceil of the
    remaining sum over the capacity, and pieces over half) reach the incumbent, which starts as
    best-fit decreasing.  ``nodes`` bounds the search; the result is always a whole packing.  It is
    proven when it meets the bound at the root, or when the tree ends with no filling left out.
    """
    best = best_fit(counts, capacity)
    if not counts:
        return best, True
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    lengths = sorted(counts)
    total = sum(length * n for length, n in counts.items())
    incumbent = sum(n for _, n in best)
    root = least_bins(counts, capacity)
    path: list[tuple[tuple[int, ...], int]] = []
    stack: list[list] = []  # [(filling, times) still to try, longest piece, lengths gone before]
    gone: list[int] = []
    used, whole = 0, True

    def bound(extra_used):
        big = sum(left[x] for x in lengths[bisect.bisect_right(lengths, capacity // 2) :])
        return extra_used + max(-(-total // capacity), big)

    def open_node():
        nonlocal whole
        while lengths and not left[lengths[-1]]:
            gone.append(lengths.pop())
        longest = lengths[-1]
        left[longest] -= 1
        fillings, every = _fillings(capacity - longest, lengths, left)
        left[longest] += 1
        whole &= every
        options = []
        for f in fillings:
            pattern = (longest, *f)
            most = min(left[x] // pattern.count(x) for x in set(pattern))
            options += [(pattern, most)] + [(pattern, 1)] * (most > 1)
        stack.append([options[::-1], longest, len(gone)])

    open_node()
    while stack and nodes > 0 and incumbent > root:
        options = stack[-1][0]
        if not options:
            stack.pop()
            if path:
                pattern, times = path.pop()
                used -= times
                for x in pattern:
                    left[x] += times
                    total += x * times
                while stack and len(gone) > stack[-1][2]:
                    lengths.append(gone.pop())
            continue
        nodes -= 1
        pattern, times = options.pop()
        for x in pattern:
            left[x] -= times
            total -= x * times
        used += times
        if not total:
            if used < incumbent:
                incumbent, best = used, [*path, (pattern, times)]
        elif bound(used) < incumbent:
            path.append((pattern, times))
            open_node()
            continue
        used -= times
        for x in pattern:
            left[x] += times
            total += x * times
    return best, incumbent <= root or not stack and whole


def plan_table(bins: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), the sequence of that rank, and the offset in it."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for lengths, n in bins:
        at = 0
        for length in lengths:
            rows.append((length << 40 | rank.get(length, 0), first, at))
            rank[length] = rank.get(length, 0) + n
            at += length
        first += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset, proven_fewest`` for each piece of each row.

    A document is its token ids and one 0; longer ones are cut, the first piece taking the rest.
    Added tokens of the vocabulary that stand in a text get their ids.  Null text is empty (one
    token); ids may be null or repeat (each row is packed); a text of any length is cut in one
    task; equal lengths go by partition and place; an empty table gives no rows; other columns are
    ignored.  ``proven_fewest`` says whether no packing has fewer sequences; where it is false the
    search ended at its limits.  What reaches the driver is one count for each length up to
    ``capacity``.
    """
    t = materialise(pieces(docs, capacity, path, id_col, text_col))
    per_task = t.groupBy("length", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in t.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bins, proven = bin_completion(counts, capacity)
    keys, first, offset = plan_table(bins)
    plan = docs.sparkSession.sparkContext.broadcast((keys, first, offset))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        keys, first, offset = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            cols = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first[at] + (rank - (keys[at] & ((1 << 40) - 1)))), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    ranked = t.join(bases, ["length", "pid"]).select(*names, (F.col("base") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("proven_fewest", F.lit(proven))

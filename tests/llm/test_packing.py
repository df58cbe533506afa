"""Packing against brute force: token ids, pieces, and the number of sequences."""

import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from voxelrank.llm import packing
from voxelrank.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, length string, sequence_id string, nth string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def plain_pieces(rows, capacity=2048):
    """(doc_id, piece, start, length, crc) by the unmodified library and the contract's words."""
    library, out = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        out += [(doc_id, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return Counter(out)


def check(rows):
    """Every sequence is gapless from 0 and at most 2048 long."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and spans[-1][0] + spans[-1][1] <= 2048
    return len(by)


def test_pieces_equal_the_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [None, "", "<|endoftext|>", "a<|endoftext|>b" * 900, "word " * 9000, "漢字" * 3000, " ", "x" * 50_000]
    rows = docs + list(zip([None, None, 7, 7, 7, 8, 9, 10], odd)) + list(zip([7, 7], odd[4:5] * 2))
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = packing.pack(df).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces(rows)
    total = sum(r.length for r in got)
    assert check(got) >= -(-total // 2048) and len({r.proven_fewest for r in got}) == 1
    if got[0].proven_fewest:
        assert check(got) == packing.least_bins(Counter(r.length for r in got))


def test_empty_table_and_ties(spark):
    assert packing.pack(frame(spark, [])).count() == 0
    got = packing.pack(frame(spark, ["same text"] * 500, [3] * 500)).collect()
    assert check(got) == -(-sum(r.length for r in got) // 2048) and got[0].proven_fewest


def fewest(items, capacity):
    """Brute force over all ways to fill the bin of the longest piece."""

    @cache
    def solve(left):
        if not left:
            return 0
        best = len(left)

        def fill(room, at, rest):
            nonlocal best
            best = min(best, 1 + solve(rest))
            for i in range(at, len(rest)):
                if rest[i] <= room and (i == at or rest[i] != rest[i - 1]):
                    fill(room - rest[i], i, rest[:i] + rest[i + 1 :])

        fill(capacity - left[0], 0, left[1:])
        return best

    return solve(tuple(sorted(items, reverse=True)))


@pytest.mark.parametrize("seed", range(25))
def test_against_all_packings(seed):
    rnd = random.Random(seed)
    items = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
    bins, proven = packing.bin_completion(dict(Counter(items)), 30)
    want = fewest(items, 30)
    assert packing.least_bins(dict(Counter(items)), 30) <= want <= sum(n for _, n in bins)
    assert not proven or sum(n for _, n in bins) == want


def test_the_search_improves_on_best_fit_at_full_capacity():
    better = 0
    for seed in range(30):
        rnd = random.Random(seed)
        items = []
        for _ in range(8):  # triples that fill a sequence
            a, b = rnd.randint(550, 800), rnd.randint(520, 700)
            items += [a, b, 2048 - a - b]
        counts = dict(Counter(items))
        bins, proven = packing.bin_completion(counts)
        n, first = sum(n for _, n in bins), sum(n for _, n in packing.best_fit(counts))
        assert n <= first and Counter(x for lengths, m in bins for x in lengths * m) == Counter(items)
        better += n < first and proven and n == 8
    assert better >= 5


@pytest.mark.parametrize("n", [99_999, 100_001, 900_000, 1_000_000, 2_500_000])
def test_ids_of_long_white_space_are_the_librarys(n):
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [f"a{' ' * n}b", " " * n, "\n" * n + "x"] if n < 2_000_000 else [f"a{' ' * n}b"]
    for text, ids in zip(texts, packing.token_bytes(texts, path)):
        assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_mixed_white_space_between_words_is_the_librarys():
    path, rnd = tokenizer_path("byte_bpe_50k.json"), random.Random(3)
    library = Tokenizer.from_file(path)
    texts = ["".join(rnd.choice([*" \t\n\r\u3000\xa0\x85\x1f", "w", "."]) * rnd.choice([1, 2, 30, 40_000]) for _ in range(20)) for _ in range(20)]
    for text, ids in zip(texts, packing.token_bytes(texts, path)):
        assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packs_texts_of_white_space(spark):
    rows = [(1, f"a{' ' * 1_200_000}b"), (2, " \n" * 700_000), (3, "x")]
    got = packing.pack(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    check(got)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces(rows)

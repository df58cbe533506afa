"""SentencePiece ids against the library, for the public BPE model and for a small unigram model written here."""

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from voxelrank.llm import pieces
from voxelrank.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, ids string, n_ids string"
PATH = tokenizer_path("piece_bpe_32k.model")


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def awkward():
    rnd = random.Random(2)
    texts = ["", " ", "  a  b ", "▁", "a▁b ▁ c", "x" * 300, "\n\té漢字 漢字🙂" * 30, "the" * 200, "https://a.bc/" + "q1w2" * 60, "\0\x01\x7f", "don't stop--now (or ever)... \"ok\"", "=" * 200, "漢字かな" * 200]
    texts += ["".join(rnd.choice("abcdeé nthertion\n漢=0123.,'\"-_▁") for _ in range(rnd.randint(1, 300))) for _ in range(300)]
    return texts + ["".join(chr(rnd.choice([rnd.randint(1, 0xD7FF), 32, 32, rnd.randint(97, 122), rnd.randint(33, 126)])) for _ in range(80)) for _ in range(200)]


def documents(spark):
    return [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number, value):
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(path):
    """A unigram model file: <unk>, <s>, </s>, the 256 byte pieces, and words with scores without ties."""
    rnd = random.Random(1)
    words = [*"abcdefghijklmnop▁.,", "▁the", "the", "th", "he", "▁a", "ab", "abc", "bcd", "cde", "ing", "▁ab", "abab", "na", "an", "ana", "nan", "▁▁", "op", "lmn", "é", "éa"]
    made = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((w, -rnd.uniform(2, 9) - 3 / len(w), 1) for w in words)]
    proto = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(kind)) for p, s, kind in made)
    trainer = b"\x18\x01" + varint(35 << 3) + b"\x01"  # unigram, byte fallback
    normalizer = field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01"
    path.write_bytes(proto + field(2, trainer) + field(3, normalizer))
    return str(path)


def test_bpe_ids_are_the_librarys(spark):
    model, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Codec(PATH)
    texts = awkward() + documents(spark)
    ids, begin = codec.encode_batch(pa.array(texts))
    for k, t in enumerate(texts):
        got = ids[begin[k] : begin[k + 1]].tolist()
        assert got == model.encode(t)
        assert codec.decode(got) == t.replace("▁", " ")
    assert codec.constrained and codec.encode("one text") == np.array(model.encode("one text"), "<u4").tobytes()


def test_unigram_ids_are_the_librarys(tmp_path):
    path = unigram_model(tmp_path / "unigram.model")
    model, codec, rnd = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Codec(path), random.Random(4)
    assert not codec.constrained
    ties, total = 0, lambda ids: sum(model.get_score(i) for i in ids)
    for _ in range(800):
        t = "".join(rnd.choice("abcdefghnaopthei  .é字▁") for _ in range(rnd.randint(0, 60)))
        got, want = np.frombuffer(codec.encode(t), "<u4").tolist(), model.encode(t)
        if got != want:  # the same pieces in another order have the same sum
            ties += 1
            assert sorted(got) == sorted(want) and abs(total(got) - total(want)) < 1e-4 and model.decode(got) == model.decode(want), t
    assert ties < 80


def test_the_window_stays_small_and_commits_carry_ordinary_text(spark, tmp_path):
    """Whole documents through one stream: all but the last few characters leave by commits."""
    for codec, texts in ((pieces.Codec(PATH), documents(spark)[:60]), (pieces.Codec(unigram_model(tmp_path / "u.model")), ["the banana abab thing " * 300])):
        for t in texts:
            t = "▁" + t.replace(" ", "▁")
            stream = codec.stream()
            early = stream.feed(t)
            late = stream.close()
            assert "".join(early + late) == t and early + late == codec.pieces(t)
            assert stream.widest <= 4 * codec.longest and len("".join(late)) <= 4 * codec.longest
            assert stream.commits >= len(t) // (8 * codec.longest)


def test_words_cut_apart_are_the_words_of_the_whole(spark):
    codec = pieces.Codec(PATH)
    for t in documents(spark)[:40]:
        whole = codec.pieces("▁" + t.replace(" ", "▁")) if t else []
        ids = [i for p in whole for i in ([codec.ids[p]] if p in codec.ids else [codec.byte_id[b] for b in p.encode()])]
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == ids
    assert codec.commits > 0


def test_frames(spark):
    texts = [None, *awkward(), "long " * 100_000, "ab" * 100_000]
    ids = [None, 3, 3, *range(3, len(texts))]
    df = frame(spark, texts + texts[:5], ids + ids[:5])
    assert all(r.text.replace("▁", " ") == r.decoded for r in pieces.decode(pieces.encode(df)).collect())
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted(((i is not None, i or 0), len(e := model.encode(t or "")), zlib.crc32(np.array(e, "<u4").tobytes()), len(t or ""), True) for i, t in zip(ids + ids[:5], texts + texts[:5]))
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_ids, r.ids_crc32, r.n_chars, r.round_trip) for r in pieces.round_trip(df).collect())
    assert got == want and pieces.round_trip(frame(spark, [])).count() == 0


def test_models_that_are_not_supported(tmp_path):
    path = tmp_path / "bytes.model"
    cut = b"".join(field(1, field(1, p) + b"\x15" + struct.pack("<f", -1.0) + b"\x18" + varint(k)) for p, k in ((b"<unk>", 2), (b"a", 1), ("▁".encode(), 1)))
    path.write_bytes(cut + field(2, b"\x18\x01") + field(3, field(1, b"identity")))
    with pytest.raises(ValueError, match="byte pieces"):
        pieces.Codec(str(path))


def repeated_signs(codec):
    """Signs of which some piece holds two or more in a row."""
    return sorted({a for p in codec.ids for a, b in zip(p, p[1:]) if a == b})


def test_runs_of_every_repeated_sign_are_the_librarys():
    model, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Codec(PATH)
    signs = [" " if s == "▁" else s for s in repeated_signs(codec)]
    assert " " in signs and len(signs) > 20
    for sign in signs:
        lengths = range(1, 301) if sign == " " else [*range(1, 40), 63, 64, 65, 100, 129, 299, 300]
        texts = [form.format(sign * n) for n in lengths for form in ("{}", "a{}b", "if x:\n{}return x\n", "b{}")]
        ids, begin = codec.encode_batch(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[begin[k] : begin[k + 1]].tolist() == model.encode(t), (sign, t[:80])


def test_mixed_runs_and_indented_code_are_the_librarys():
    model, codec, rnd = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Codec(PATH), random.Random(5)
    signs = [" ", *(s for s in repeated_signs(codec) if s != "▁")]
    texts = ["".join(rnd.choice([" ", " ", rnd.choice(signs), "x", "\n", "\t"]) * rnd.randint(1, 40) for _ in range(12)) for _ in range(400)]
    texts += ["".join(" " * rnd.choice([0, 2, 4, 8, 12, 16, 20, 24]) + rnd.choice(["return x", "if y:", "else:", "pass  # no", "a = [1,  2]"]) + "\n" for _ in range(30)) for _ in range(50)]
    ids, begin = codec.encode_batch(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == model.encode(t)


def test_long_runs_end_and_round_trip(spark):
    texts = [c * 200_000 for c in (" ", "=", "\n", "a", "\t", "é", "\u3000", "0", "-")] + ["x" + " " * 300_000 + "y", " \n" * 100_000, "".join(f"{' ' * (k % 60)}line {k}\n" for k in range(5000))]
    rows = pieces.round_trip(frame(spark, texts)).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = {r.doc_id: (r.n_ids, r.ids_crc32) for r in rows}
    for k, t in enumerate(texts):
        want = np.array(model.encode(t), "<u4")
        assert ids[k] == (len(want), zlib.crc32(want.tobytes()))


def test_no_text_can_loop():
    codec = pieces.Codec(PATH)
    codec._allowed = lambda a, b: np.zeros(len(a), bool)  # a model that lets no two pieces stand side by side
    with pytest.raises(ValueError, match="no path"):
        codec.encode_batch(pa.array(["unthinkably understandable"]))


def test_decode_of_awkward_rows(spark):
    rows = [(1, [], "", 0), (2, None, "x", 0), (None, pieces.codec(PATH).encode_batch(pa.array(["a  b"]))[0].tolist(), "a  b", 0)]
    got = {r.doc_id: r.decoded for r in pieces.decode(spark.createDataFrame(rows * 2, "doc_id long, ids array<int>, text string, decoded int")).collect()}
    assert got == {1: "", 2: None, None: "a  b"}

"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelrank.llm import chat, exact, nearjoin, packing, pii, quality, repeats, secrets, suffixes, template
from voxelrank.llm.common import tokenizer_path
from voxelrank.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, norm string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "clash", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def awkward():
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    long = " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(6000))
    texts = [None, "", " ", "A", "a", passage, passage.upper(), "x " + passage, passage + " y", long, long + "!", "ab" * 200, "é漢字🙂\n" * 40, passage[:99], passage[:100], "tail " + passage[-120:], None, passage]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    return texts


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block", [64, 2])
def test_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    texts = awkward()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame(spark, texts)).collect()}
    assert got == brute_repeats(enumerate(texts))


def test_repeats_null_ids_and_empty_table(spark):
    text = "some words that go on and on " * 10
    rows = repeats.remove_repeats(frame(spark, [text, text, text], [None, 1, 2])).collect()
    assert {r.doc_id: r.n_removed == r.n_bytes for r in rows} == {None: False, 1: False, 2: True}
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(2, 5), max_size=40), min_size=1, max_size=5))
def test_suffix_arrays(strings):
    parts = [[0, *s, 1] for s in strings]
    off = np.cumsum([0, *map(len, parts)])
    sa = suffixes.suffix_arrays(np.concatenate(parts), off)
    for b, s in enumerate(parts):
        assert (sa[off[b] : off[b + 1]] - off[b]).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_exact(spark):
    texts = awkward() + ["Same Text"] * 30
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    got = exact.exact_dedup(frame(spark, texts)).collect()
    best = {t: max(i for i, u in enumerate(low) if u == t) for t in set(low)}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == {(i, best[t], low.count(t), best[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(low)}
    same = exact.exact_dedup(frame(spark, ["a", "A", "b"], [1, 1, None])).collect()
    assert Counter(r.kept for r in same) == {True: 2, False: 1}
    assert exact.exact_dedup(frame(spark, [])).count() == 0
    kept = exact.drop_copies(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "norm", "n_chars"] and {r.doc_id for r in kept.collect()} == set(best.values())


def test_near(spark, monkeypatch):
    rnd = random.Random(5)
    base = [" ".join(f"w{rnd.randint(0, 400)}" for _ in range(120)) for _ in range(6)]
    texts = [None, "", "!!", "one two", "One  two", *base]
    for b in base[:3]:
        for _ in range(12):
            w = b.split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    links, root = Counter(x for p in pairs for x in p), list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    for block in (512, 5):
        monkeypatch.setattr(nearjoin, "BLOCK", block)
        got = nearjoin.near_duplicates(frame(spark, texts)).collect()
        assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, root[i], links[i]) for i in range(len(texts))}
    stays = {r.doc_id for r in nearjoin.one_of_each(frame(spark, texts)).collect()}
    assert stays == {i for i in range(len(texts)) if root[i] == i}
    assert nearjoin.near_duplicates(frame(spark, [])).count() == 0
    loose = nearjoin.near_duplicates(frame(spark, ["same text here", "same text here"], [None, 4])).collect()
    assert {(r.doc_id, r.n_links) for r in loose} == {(None, 0), (4, 0)}


def test_bands_reach_the_recall():
    b, r = nearjoin.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 100), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_token_ids_match_the_library():
    from tokenizers import Tokenizer

    path, rnd = tokenizer_path("byte_bpe_50k.json"), random.Random(4)
    t = Tokenizer.from_file(path)
    texts = ["<|endoftext|> x", "a<|endoftext|>b", "one <|endoftext|> two<|endoftext|><|endoftext|>", "<|endoftext", " <|endoftext|>\n", "　a  b\x85c\x1c d", "a \n \n b", "١٢٣ ²³ Ⅷ", "don't I'LL", *(x or "" for x in awkward())]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 0xD7FF), 32, 10, rnd.randint(97, 122)])) for _ in range(60)) for _ in range(500)]
    for text, ids in zip(texts, packing.token_bytes(texts, path)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    texts = awkward() + ["word " * 3000]
    rows = packing.pack(frame(spark, texts)).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    for spans in by_doc.values():
        spans.sort()
        assert [s for _, s, _ in spans] == np.cumsum([0, *(n for _, _, n in spans)])[:-1].tolist() and all(n == 2048 for _, _, n in spans[1:])
    assert set(by_doc) == set(range(len(texts))) and packing.pack(frame(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 6), max_size=12))
def test_bin_completion(counts):
    bins, proven = packing.bin_completion(counts, 100, 500)
    used = Counter()
    for lengths, n in bins:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += n
    n = sum(n for _, n in bins)
    assert used == Counter(counts) and packing.least_bins(counts, 100) <= n <= sum(n for _, n in packing.best_fit(counts, 100))
    assert proven or n > packing.least_bins(counts, 100)


def test_bin_completion_beats_best_fit():
    counts = {6: 1, 5: 2, 4: 1, 3: 2, 2: 2}  # sums to 30: three full bins of 10
    assert sum(n for _, n in packing.bin_completion(counts, 10)[0]) == 3


def test_secrets(spark):
    texts = ['password = "hunter2hunter2"', "API_KEY: abcd", "toKen:tokenaaaa secret='x=y/z+1234'", "AKIA" + "B" * 12 + " AKIAB", "f" * 32 + " " + "g" * 32, "sk-" + "aB3dE5gH7jK9mN1pQ3sT5v", "deadbeefdeadbeef" * 3, "a" * 50, "internationalizationization", "123e4567-e89b-12d3-a456-426614174000", "é 🙂 pwd passwd=\"12345678\"", "ſecret=12345678", None]
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, texts)).collect()}
    assert [got[i].n_assign for i in range(13)] == [1, 0, 2, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0]
    assert got[3].n_access == 1 and got[4].n_hex == 1 and got[6].n_hex == 1 and got[10].spans == "assign:8:24"
    assert "entropy_base64" in got[5].spans and not any("entropy" in got[i].spans for i in (7, 8, 9))
    for r in got.values():
        base = ",".join(s for s in r.spans.split(",") if s and not s.startswith("entropy"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    clean = {r.doc_id: r for r in secrets.redact_secrets(frame(spark, texts)).collect()}
    assert clean[0].text == "[SECRET]\"" and clean[8].text == texts[8] and clean[12].text is None and clean[0].n_chars == 9
    assert secrets.scan_secrets(frame(spark, [])).count() == 0


def test_entropy_counts_are_right():
    import math

    text, alphabet, w = "".join(random.Random(1).choice("abc123xyz_") for _ in range(200)), frozenset("abc123xyz"), secrets.WINDOW
    want = set()
    for s in range(len(text) - w + 1):
        part = text[s : s + w]
        if set(part) <= alphabet and -sum(n / w * math.log2(n / w) for n in Counter(part).values()) >= 2.8:
            want.update(range(s, s + w))
    got = {i for s, e in secrets._hot_windows(text, alphabet, 2.8) for i in range(s, e)}
    assert got == want


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def test_pseudonyms(spark):
    texts = ["card 4111111111111111, +1 (017) 555-7713 and 10.0.0.255!", "again 4111111111111111 but 4111111111111112", "born 1990-02-28, not 1990-02-30, ssn 123-45-6789 or 000-12-3456", "mail A.b@Mail.example.com or a.b@mail.example.com", "4111-1111-1111-1111 on 12/31/1999", "300.1.1.1 v1.2.3", None, ""]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts), "key").collect()}
    card = re.search(r"\d{16}", got[0].text)[0]
    assert card != "4111111111111111" and luhn(card) and card in got[1].text and "4111111111111112" in got[1].text and got[0].n_values == 3
    assert re.fullmatch(r"card \d{16}, \+1 \(\d{3}\) \d{3}-\d{4} and (\d{1,3}\.){3}\d{1,3}!", got[0].text)
    assert re.search(r"born \d{4}-\d\d-\d\d, not 1990-02-30, ssn \d{3}-\d\d-\d{4} or 000-12-3456", got[2].text) and got[2].n_values == 2
    assert len(set(re.findall(r"user\w+@mail\.invalid", got[3].text))) == 1 and "example" not in got[3].text
    assert re.fullmatch(r"(\d{4}-){3}\d{4} on \d\d/\d\d/\d{4}", got[4].text) and got[4].text.split()[0].replace("-", "") == card
    assert got[5].text == texts[5] and got[6].text == "" and pii.pseudonymise(frame(spark, []), "key").count() == 0


def test_feistel_is_a_permutation(spark):
    x = F.col("id")
    df = spark.range(189 * 5).select(pii.feistel(x, F.lit(189).cast("long"), F.lit(5).cast("long"), "k", F.lit("t")).alias("y"))
    assert sorted(r.y for r in df.collect()) == list(range(189 * 5))


def test_quality(spark):
    """On rows that set cut-offs; test_quality.py has the held-out ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs).join(labels, "doc_id").collect()
    good, bad = [r.keep for r in got if r.quality == 1], [r.keep for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.25
    assert quality.classify(frame(spark, awkward())).count() == len(awkward()) and quality.classify(frame(spark, [])).count() == 0


def test_template():
    run = lambda src, **v: "".join(t for t, _ in template.compile_template(src)(v))
    assert run("{% for x in xs %}{% if x.a == 'b' %}[{{ x.a|upper }}]{% else %}-{% endif %}{% endfor %}", xs=[{"a": "b"}, {"a": "c"}]) == "[B]-"
    assert template.fold(template.parse("a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% else %}d{% endif %}")) == [("text", "ab1c")]
    for bad in ("{{ x.__class__ }}", "{{ _x }}", "{{ x|eval }}", "{% for x in xs %}", "{{ open('x') }}", "{% import os %}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)
    assert run("{{ x.keys }}|{{ y }}", x="text") == "|"


def test_chat(spark, monkeypatch):
    rows = [(1, 1, "assistant", "a\\</turn>\n<turn role=x>\n"), (1, 0, "user", None), (1, 1, "assistant", ""), (1, None, "sys>\n<", "é🙂"), (None, 0, "assistant", "x"), (2, 5, None, "\\")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    for size in (1 << 20, 3):
        monkeypatch.setattr(chat, "CHUNK", size)
        got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
        for conv in (1, 2, None):
            turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
            said = "".join(x for *_, r, x in turns if r == "assistant")
            want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
            assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == want
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_every_class_is_tried_on_a_candidate():
    rnd = random.Random(1)
    key = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    number = "".join(rnd.choice("0123456789abcdef") for _ in range(24))
    for text in (f"x {number}/{key} y", f"x {number.upper()}_{key} y", f"x {key}={number} y"):
        assert secrets.redact(text) == "x [SECRET] y"
    kinds = {k for *_, k in secrets.scan_text(f"{number}/{key}")[1]}
    assert kinds == {"entropy_hex", "entropy_base64"} and [k for *_, k in secrets.scan_text(number)[1]] == ["entropy_hex"]


def test_phone_separators(spark):
    joined = [f"+1{a}{area}{b}123{c}4567" for a in ("", " ", ".", "-") for area in ("555", "(555)") for b in ("", " ", ".", "-") for c in ("", " ", ".", "-")]
    other = ["555-123-4567", "555.123.4567", "(555) 123-4567", "(555)123.4567"]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, [f"call {p}, now" for p in joined + other]), "key").collect()}
    for i, p in enumerate(joined + other):
        new = got[i].text
        assert got[i].n_values == 1 and "123" + p[-5:] not in new and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", f"call {p}, now"), (p, new)
    assert len({re.sub(r"\D", "", r.text)[-10:] for r in got.values()}) == 1  # one number, one pseudonym
    left = ["+155512345678", "x1-555-123-4567", "5551234567", "555 123 4567"]
    assert [r.n_values for r in pii.pseudonymise(frame(spark, left), "key").collect()] == [0] * 4


def test_one_row_for_each_text_stays(spark):
    rows = [("One text", 3)] * 4 + [("one TEXT", 1), ("other", 3), ("other", 3), ("lone", 5), (None, None), ("", None)]
    kept = exact.drop_copies(frame(spark, [t for t, _ in rows], [i for _, i in rows]).repartition(3))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (3, "One text"), (3, "other"), (5, "lone")]


def test_all_characters_of_a_long_word_count():
    head, of = "plainwords" * 30, lambda t: Counter(quality.document_features(t, {})[0])
    tails = ["".join(random.Random(s).choice("aZ9%$#{}|漢字") for _ in range(3000)) for s in (1, 2)]
    one, two = (of(head + t) for t in tails)
    assert one != two and one.total() == two.total() == 275 and of(head + tails[0][:-1] + "!") != one
    rows = [("plainwordsplainwords" * 20 + " fine", 1.0)] * 20 + [("aZ9%$#{}|Q" * 40 + " fine", 0.0)] * 20
    w, b = quality.fit(rows)
    score = lambda t: 4.0 * sum(w[f] for f in quality.document_features(t, {})[0]) / len(quality.document_features(t, {})[0])
    assert score(head) > score(head + "aZ9%$#{}|Q" * 400) and score("aZ9%$#{}|Q" * 30) < score("aZ9%$#{}|Q" * 30 + head * 40)

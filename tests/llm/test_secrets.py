"""Secret scans against an independent scanner that follows the definitions character by character."""

import hashlib
import math
import random
import string
import time
from collections import Counter

from voxelrank.llm import secrets

SCHEMA = "doc_id long, text string, spans string, n_assign string"
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")
WORDY = set(string.ascii_letters + string.digits + "+/_=-")
UPPER = set(string.ascii_uppercase + string.digits)
SMALL_HEX, ANY_HEX = set("0123456789abcdef"), set("0123456789abcdefABCDEF")
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def run_of(text, at, signs):
    while at < len(text) and text[at] in signs:
        at += 1
    return at


def lower(text):
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in text)


def assigns(text):
    low, at, out = lower(text), 0, []
    while at < len(text):
        for word in KEYWORDS:
            if low.startswith(word, at):
                i = at + len(word)
                i += text[i : i + 1] in ("'", '"') and bool(text[i : i + 1])
                i = run_of(text, i, " ")
                if text[i : i + 1] and text[i] in ":=":
                    i = run_of(text, i + 1, " ")
                    i += bool(text[i : i + 1]) and text[i] in "'\""
                    end = run_of(text, i, VALUE)
                    if end > i:
                        if end - i >= 8:
                            out.append((at, end, "assign"))
                        at = end - 1
                        break
        at += 1
    return out


def runs(text, signs, least, kind, start=""):
    at, out = 0, []
    while at < len(text):
        if text.startswith(start, at) and (text[at] in signs):
            end = run_of(text, at + len(start), signs)
            if end > at + len(start):
                if end - at >= least:
                    out.append((at, end, kind))
                at = end
                continue
        at += 1
    return out


def harmless(word):
    if word.isalpha() or word.isdigit() or len(set(word)) == 1 or set(word) <= set("/_=+-"):
        return True
    if [len(p) for p in word.split("-")] == [8, 4, 4, 4, 12] and set(word) <= ANY_HEX | {"-"}:
        return True
    body = word[1:] if word.startswith("/") else word
    return body[:1].isalpha() and set(body) <= set(string.ascii_letters + "/_-")


def entropies(text, base):
    out, at = [], 0
    while at < len(text):
        end = run_of(text, at, WORDY)
        if end - at >= 20 and not harmless(text[at:end]) and not any(s <= at and end <= e for s, e, _ in base):
            mine = []
            for kind, signs, bits in (("entropy_hex", ANY_HEX, 3.0), ("entropy_base64", WORDY, 3.7)):
                hot = []
                for s in range(at, end - 19):
                    part = text[s : s + 20]
                    if set(part) <= signs and -sum(n / 20 * math.log2(n / 20) for n in Counter(part).values()) >= bits:
                        if hot and hot[-1][1] >= s:
                            hot[-1] = (hot[-1][0], s + 20)
                        else:
                            hot.append((s, s + 20))
                for s, e in hot:
                    piece = text[s:e]
                    if any(c.isdigit() for c in piece) and any(c.isalpha() for c in piece) and not any(a <= s and e <= b for a, b, _ in base + mine):
                        mine.append((s, e, kind))
            out += mine
        at = max(end, at + 1)
    return out


def plain(text):
    text = text or ""
    order = lambda spans: sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))
    base = order(assigns(text) + runs(text, UPPER, 16, "access", "AKIA") + runs(text, SMALL_HEX, 32, "hex"))
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    n = Counter(k for *_, k in base)
    return (n["assign"], n["access"], n["hex"], hashlib.sha256(join(base).encode()).hexdigest(), join(order(base + entropies(text, base))))


def same(spark, docs):
    key = lambda r: (r[0] is not None, r)
    want = sorted(((r.doc_id, *plain(r.text)) for r in docs.collect()), key=key)
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.scan_secrets(docs).collect()), key=key)
    assert got == want
    return got


def test_documents_equal_the_plain_version(spark):
    got = same(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sum(r[1] + r[2] + r[3] for r in got) > 10


def test_awkward_rows(spark):
    rnd = random.Random(8)
    texts = [None, "", "password=secret=12345678 tokentoken:abcdefgh", "AKIAAKIA" + "A" * 20 + " AKIA AKIAx", "api-key=12345678 apikey=''x passwd : \"abcdefgh-\"", "Password\n=12345678", "secret  =  short", "ſecret=12345678 tokeN='é12345678'", "0" * 31 + " " + "0" * 32 + "F" + "a" * 40]
    signs = "abcdef0123456789ABCDEFGHIJxyz+/_=-" * 2 + " .\"':=é\n"
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 400))) for _ in range(150)]
    texts += [f"{rnd.choice(KEYWORDS)}{rnd.choice(['', ' '])}{rnd.choice(':=')}" + "".join(rnd.choice(signs) for _ in range(60)) for _ in range(150)]
    same(spark, frame(spark, texts + texts[:9], [None, 5, 5, *range(3, len(texts)), *range(9)]))
    assert secrets.scan_secrets(frame(spark, [])).count() == 0


def test_long_texts_take_linear_time(spark):
    rnd = random.Random(9)
    blob = "".join(rnd.choice(string.ascii_letters + string.digits + "+/") for _ in range(1 << 20))
    texts = [" ".join(f"token={rnd.randrange(10**12):012d}" for _ in range(40_000)), blob, " ".join(blob[i : i + 30] for i in range(0, 1 << 19, 30)), "password " + " " * (1 << 20), "a/" * (1 << 19), "secret" * 100_000]
    began = time.monotonic()
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, texts)).collect()}
    assert time.monotonic() - began < 60
    assert got[0].n_assign == 40_000 and got[2].spans.count("entropy_base64") > 10_000 and got[3].spans == got[4].spans == ""

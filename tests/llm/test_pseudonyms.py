"""Pseudonyms against an independent version in plain Python, and on long and awkward texts."""

import calendar
import datetime
import hashlib
import time

import regex

from voxelrank.llm import pii, queries

SCHEMA = "doc_id long, text string, n_values string, new string"
KEY = "test-key"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def permuted(x, a, b, kind):
    left, right = divmod(x, b)
    for i in range(1, 9):
        half = right if i % 2 else left
        f = int(hashlib.sha256(f"{KEY}:{kind}/{a}/{b}:{i}:{half}".encode()).hexdigest()[:15], 16)
        if i % 2:
            left = (left + f) % a
        else:
            right = (right + f) % b
    return left * b + right


def check_digit(body):
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def refill(shape, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def a_date(y, m, d):
    if not (1 <= m <= 12 and y >= 1 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    day, first, end = datetime.date(y, m, d).toordinal(), datetime.date(1900, 1, 1).toordinal(), datetime.date(2300, 1, 1).toordinal()
    if first <= day < end:
        return datetime.date.fromordinal(first + permuted(day - first, 189, 773, "date"))
    moved = permuted(day - 1 if day < first else day - 1 - (end - first), 5151, 709, "date_other")
    return datetime.date.fromordinal(moved + 1 if moved < first - 1 else moved + 1 + end - first)


def one(value):
    """(new value, whether it was valid) by the format of ``value``."""
    digits = "".join(c for c in value if c.isdigit())
    if "@" in value:
        return "user" + hashlib.sha256(f"{KEY}:email:{value.lower()}".encode()).hexdigest()[:16] + "@mail.invalid", True
    if regex.fullmatch(r"\d{3}-\d\d-\d{4}", value):
        area, group, serial = int(value[:3]), int(value[4:6]), int(value[7:])
        areas = [x for x in range(1, 900) if x != 666]
        if area not in areas or not group or not serial:
            return value, False
        y = permuted((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
        return f"{areas[y // 9999 // 99]:03d}-{y // 9999 % 99 + 1:02d}-{y % 9999 + 1:04d}", True
    if regex.fullmatch(r"\d{4}-\d\d-\d\d", value):
        new = a_date(int(value[:4]), int(value[5:7]), int(value[8:]))
        return (f"{new.year:04d}-{new.month:02d}-{new.day:02d}", True) if new else (value, False)
    if "/" in value:
        new = a_date(int(value[6:]), int(value[:2]), int(value[3:5]))
        return (f"{new.month:02d}/{new.day:02d}/{new.year:04d}", True) if new else (value, False)
    if regex.fullmatch(r"\d+(\.\d+){3}", value):
        parts = list(map(int, value.split(".")))
        if max(parts) > 255:
            return value, False
        y = permuted(int.from_bytes(bytes(parts), "big"), 65536, 65536, "ipv4")
        return ".".join(map(str, y.to_bytes(4, "big"))), True
    if regex.fullmatch(r"\d{13,19}|\d{4}([ -]\d{4}){3}", value):
        if check_digit(digits[:-1]) != digits[-1]:
            return value, False
        n = len(digits) - 1
        body = str(permuted(int(digits[:-1]), 10 ** -(-n // 2), 10 ** (n // 2), "card")).zfill(n)
        return refill(value, body + check_digit(body)), True
    prefix = "+1" if value.startswith("+1") else ""
    return prefix + refill(value[len(prefix) :], str(permuted(int(digits[-10:]), 100_000, 100_000, "phone")).zfill(10)), True


MAIL = r"(?:(?<![\w.%+-])|\G)[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
TEL = r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\(\d{3}\) ?\d{3}[.-]\d{4}(?!\d)|(?<![A-Za-z\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)"
NUMBER = r"(?<![A-Za-z\d.+-])(?:\d{3}-\d\d-\d{4}(?![A-Za-z\d]|[.-]\d)|\d{4}-\d\d-\d\d(?![A-SU-Za-z\d]|-\d)|\d\d/\d\d/\d{4}(?![A-Za-z\d]|[.-]\d)|\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z\d]|\.\d)|(?:\d{4}[ -]){3}\d{4}(?![A-Za-z\d]|[.-]\d)|\d{13,19}(?![A-Za-z\d]|[.-]\d))"
EVERY = regex.compile(f"{MAIL}|{TEL}|{NUMBER}", regex.A)


def plain(text):
    """(text with pseudonyms, number of valid values)."""
    n = 0

    def move(m):
        nonlocal n
        new, valid = one(m[0])
        n += valid
        return new

    return EVERY.sub(move, text or ""), n


def same(spark, docs):
    want = sorted((i if i is not None else -1, *plain(t)) for i, t in ((r.doc_id, r.text) for r in docs.collect()))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.n_values) for r in pii.pseudonymise(docs, KEY).collect())
    assert got == want
    return got


def test_rows_equal_the_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sum(n for *_, n in same(spark, docs)) > 50


def test_formats_and_awkward_rows(spark):
    texts = [None, "", "1899-12-31 2300-01-01 0001-01-01 9999-12-31 0000-01-01 2024-02-30", "12/31/1776 02/29/2400 02/29/2300", "(555) 123-4567abc@x.com", "x@y@z.com a@b.c@d.e", "a..b@c-.d. e@f 1@2.3", "4111111111111111 4111 1111 1111 1111 4111-1111-1111-1112", "666-12-3456 899-99-9999 900-12-3456", "255.255.255.255 256.1.1.1 0.0.0.0", "é漢@字.com 🙂a@b.co"]
    same(spark, frame(spark, texts + texts, [None, *range(1, len(texts)), *range(len(texts))]))
    assert pii.pseudonymise(frame(spark, []), KEY).count() == 0


def test_long_texts_take_linear_time(spark):
    labels, mega = "a@" + ".".join("b" * 50_000), 1 << 20
    texts = [labels, labels + " tail 2020-02-02", "x" * mega, "1" * mega, "a." * (mega // 2), "@" * mega, "a@" * (mega // 2), "+1 " * (mega // 3), "aGVsbG8" * (mega // 7) + "@x.org", "2020-02-02 " * 20_000]
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts), KEY).collect()}
    assert time.monotonic() - began < 60
    assert got[0].n_values == 1 and got[0].text.endswith("@mail.invalid") and got[1].n_values == 2 and got[9].n_values == 20_000
    assert all(got[i].text == texts[i] and not got[i].n_values for i in (2, 3, 4, 5, 6, 7)) and got[8].n_values == 1


def test_the_key_comes_from_the_settings(spark, monkeypatch):
    monkeypatch.setenv("VOXELRANK_PSEUDONYM_KEY", "from-environment")
    assert queries.pseudonym_key(spark) == "from-environment"
    spark.conf.set("spark.voxelrank.pseudonymKey", "from-settings")
    try:
        assert queries.pseudonym_key(spark) == "from-settings"
    finally:
        spark.conf.unset("spark.voxelrank.pseudonymKey")
    monkeypatch.delenv("VOXELRANK_PSEUDONYM_KEY")
    assert queries.pseudonym_key(spark) == queries.pseudonym_key(spark) != "from-environment"

"""Secret scans: fixed patterns plus sliding-window entropy per character class."""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelrank.llm.common import whole_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same spans as runs of which shorter ones are dropped
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: Window length in characters and the bits per character from which a window of a class counts.
WINDOW = 20
CLASSES = (("entropy_hex", frozenset("0123456789abcdefABCDEF"), 3.0), ("entropy_base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.7))

#: Candidates that are not secrets: words, numbers, UUIDs, rules of one repeated sign, paths and hyphenated or snake-case words.
ALLOW = tuple(map(re.compile, (r"[A-Za-z]+\Z", r"\d+\Z", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z", r"(.)\1+\Z", r"/?[A-Za-z]+([/_-]+[A-Za-z]+)*[/_-]*\Z", r"[/_=+-]+\Z")))


def _hot_windows(text: str, alphabet: frozenset, bits: float) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows of WINDOW characters of one class whose Shannon entropy is at least ``bits``.

    Counts change by one character in and one out; sum(c*log2 c) is kept up to date alongside.
    """
    plogp = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
    found: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total, run = 0.0, 0
    for end, ch in enumerate(text, 1):
        if ch not in alphabet:
            counts, total, run = {}, 0.0, 0
            continue
        if run == WINDOW:
            out = text[end - 1 - WINDOW]
            total += plogp[counts[out] - 1] - plogp[counts[out]]
            counts[out] -= 1
        else:
            run += 1
        c = counts.get(ch, 0)
        total += plogp[c + 1] - plogp[c]
        counts[ch] = c + 1
        if run == WINDOW and math.log2(WINDOW) - total / WINDOW >= bits:
            if found and found[-1][1] >= end - WINDOW:
                found[-1] = (found[-1][0], end)
            else:
                found.append((end - WINDOW, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


class _Cover:
    """Answers whether [start, end) lies inside one of the given spans, in logarithmic time."""

    def __init__(self, spans):
        self.starts, self.reach = [], []
        for start, end, _ in sorted(spans):
            self.starts.append(start)
            self.reach.append(max(end, self.reach[-1] if self.reach else end))

    def holds(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.starts, start)
        return at > 0 and self.reach[at - 1] >= end


_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def entropy_spans(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further spans by entropy, unless allow-listed or inside a known span or one of a class before."""
    spans, cover = [], _Cover(known)
    for m in CANDIDATE.finditer(text):
        word, at = m[0], m.start()
        if cover.holds(at, m.end()) or any(a.match(word) for a in ALLOW):
            continue
        found: list[tuple[int, int, str]] = []
        for kind, alphabet, bits in CLASSES:
            before = _Cover(found)
            for s, e in _hot_windows(word, alphabet, bits):
                if not (cover.holds(at + s, at + e) or before.holds(at + s, at + e)) and _DIGIT.search(word, s, e) and _LETTER.search(word, s, e):
                    found.append((at + s, at + e, kind))
        spans += found
    return spans


def scan_text(text: str) -> tuple[list, list]:
    """(base spans, all spans), each sorted by start, then kind as listed."""
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scan(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            base, every = scan_text(text.as_py())
            n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            rows.append((doc_id, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, schema.types)], schema=schema)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row, over whole texts.

    Null text is empty; repeated rows give repeated results; ids may be null; other columns are
    ignored; an empty table gives no rows.  Spans that start together stand in the order of the
    kinds.  A text is held by one task; time grows with its length (times the logarithm of its spans).
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with each maximal union of found spans replaced by ``mark``."""
    out, at, last = [], 0, -1
    for s, e, _ in scan_text(text)[1]:
        if s >= last:
            out += [text[at:s], mark]
        at = last = max(last, e)
    return "".join(out) + text[at:] if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced; null stays null; ``n_chars``, if there, follows the new text."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    done = docs.mapInArrow(run, schema)
    n_chars = F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(0)  # may be null by type, as in documents
    return done.withColumn("n_chars", n_chars.cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else done

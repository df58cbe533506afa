"""Chat formatting: conversations rendered by a compiled template, and read back from the output."""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelrank.llm.template import compile_template, unescape

#: Turns stand between control strings in angle brackets; inside texts and roles these signs are escaped.
TEMPLATE = "{% for turn in turns %}<turn role={{ turn.role|escape }}>\n{% if turn.role == 'assistant' %}{% generation %}{{ turn.text|escape }}{% endgeneration %}{% else %}{{ turn.text|escape }}{% endif %}</turn>\n{% endfor %}"
#: Characters of output in one row; a longer turn makes a longer row.
CHUNK = 1 << 20

_CONTROL = re.compile(r"\\.|<turn role=|>\n|</turn>\n", re.S)
FORMATTED = "conv_id long, chunk long, text string, loss array<struct<start:long,end:long>>"


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")))


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, chunk, text, loss``: the output of each conversation in consecutive chunks.

    ``loss`` holds [start, end) in code points of the whole output under generation markers.  Rows
    come by turn (null first), ties by role and text; null roles and texts are empty; rows that repeat
    are turns each; rows of a null id make one conversation; an empty table gives no rows; other
    columns, of any name, are ignored.  A conversation's rows stream through one task in sorted order,
    holding one chunk at a time, so its length is not bounded by memory; a turn that is longer than
    CHUNK is one row of output as it is, as turns are not cut.
    """

    def run(batches):
        render = compile_template(template)
        out, size = [], 0
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            parts, loss, at, held, chunk = [], [], 0, 0, 0
            for text, generated in render({"turns": ({"role": r, "text": t} for _, r, t in rows)}):
                if generated and text:
                    if loss and loss[-1]["end"] == at and held:
                        loss[-1]["end"] = at + len(text)
                    else:
                        loss.append({"start": at, "end": at + len(text)})
                parts.append(text)
                at, held = at + len(text), held + len(text)
                if held >= CHUNK:
                    out.append((conv_id, chunk, "".join(parts), loss))
                    parts, loss, size, held, chunk = [], [], size + held, 0, chunk + 1
            out.append((conv_id, chunk, "".join(parts), loss))
            size += held
            if size >= 4 * CHUNK or len(out) >= 5000:
                yield _batch(out)
                out, size = [], 0
        yield _batch(out)

    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return clean.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(run, FORMATTED)


def _batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["conv_id", "chunk", "text", "loss"])


def parse_turns(chunks):
    """(role, text) of each turn from the chunks of one output, unescaped; holds one turn at a time."""
    expect, role, held = "<turn role=", "", ""
    for chunk in chunks:
        held, at, start = held + chunk, 0, 0
        while m := _CONTROL.search(held, at):
            at = m.end()
            if m[0] == expect == "<turn role=":
                expect, start = ">\n", at
            elif m[0] == expect == ">\n":
                expect, role, start = "</turn>\n", unescape(held[start : m.start()]), at
            elif m[0] == expect:
                yield role, unescape(held[start : m.start()])
                expect, start = "<turn role=", at
        held = held[start:]  # read again with what follows
    if held or expect != "<turn role=":
        raise ValueError("the output ends inside a turn")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from formatted chunks.

    Expects each conversation's chunks in order in one partition, as :func:`format_conversations`
    gives them.  Everything is parsed from the output text and its loss spans alone.
    """

    def run(batches):
        def chunks():
            for b in batches:
                yield from zip(*(b.column(n).to_pylist() for n in ("conv_id", "text", "loss")))

        out = []
        for conv_id, rows in groupby(chunks(), key=lambda r: r[0]):
            turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

            def texts():
                nonlocal chars, total
                for _, text, spans in rows:
                    for s in spans:
                        said = unescape(text[s["start"] - total : s["end"] - total])
                        chars += len(said)
                        loss.update(said.encode())
                    total += len(text)
                    yield text

            for role, text in parse_turns(texts()):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            out.append((conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(out) >= 10_000:
                yield _digests(out)
                out = []
        yield _digests(out)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=names)

"""Exact document deduplication by a distributed content sort.

Rows are range-partitioned by sampled splitters over (head of the normalised bytes, 64-bit hash,
id), sorted inside each partition by Spark's external (spilling) sort so that equal contents are
adjacent, and neighbours are compared in full.  The splitters end in the id, so a content that
fills a third of the table is spread over many partitions; its runs are joined afterwards from one
summary row for each end of a partition.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelrank.llm.common import materialise, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAD = 24

_RUNS = "doc_id long, text_sha256 string, run_max long, run_len long, first boolean, edge boolean"


def normalised(col: str = "text"):
    """Whole text, null as empty, A-Z lowered and nothing else."""
    return F.translate(whole_text(col), UPPER, LOWER)


def _runs(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("run_max", pa.int64()), ("run_len", pa.int64()), ("first", pa.bool_()), ("edge", pa.bool_())])
    out = {n: [] for n in schema.names}

    def emit(runs, edge):
        for sha, ids in runs:
            n = len(ids)
            out["doc_id"] += ids
            out["text_sha256"] += [sha] * n
            out["run_max"] += [ids[0]] * n
            out["run_len"] += [n] * n
            out["first"] += [True] + [False] * (n - 1)
            out["edge"] += [edge] * n

    key = text = first_key = None
    runs: list = []
    for batch in batches:
        heads, hashes, texts, ids = (batch.column(i) for i in range(4))
        for i, (h, doc_id) in enumerate(zip(hashes.to_pylist(), ids.to_pylist())):
            now = texts[i].as_buffer()  # no copy of the text
            if runs and h == key[1] and now.equals(text):
                runs[-1][1].append(doc_id)
                continue
            here = (heads[i].as_py(), h)
            if here != key:
                if runs:
                    emit(runs, key == first_key)
                else:
                    first_key = here
                key, runs = here, []
            text = now
            runs.append((hashlib.sha256(now).hexdigest(), [doc_id]))
        if len(out["doc_id"]) >= 10_000:
            yield pa.RecordBatch.from_pydict(out, schema=schema)
            out = {n: [] for n in schema.names}
    if runs:
        emit(runs, True)
    yield pa.RecordBatch.from_pydict(out, schema=schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lowering A-Z.  The largest id of a group stays.  Null
    texts count as empty; a null id counts as smaller than any other; of rows that repeat both id
    and text one is kept; an empty table gives no rows; other columns are ignored; a text of any
    length is compared whole, two at a time in memory.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm"))
    keyed = base.select(F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("hash"), "norm", "doc_id")
    dealt = keyed.repartitionByRange("head", "hash", "doc_id").sortWithinPartitions("head", "hash", "norm", F.desc_nulls_last("doc_id"))
    runs = materialise(dealt.mapInArrow(_runs, _RUNS))
    # At most the runs at the two ends of each partition: its rows grow with partitions, not with documents.
    ends = runs.filter("edge AND first").groupBy("text_sha256").agg(F.max("run_max").alias("whole_max"), F.sum("run_len").alias("whole_len"))
    return runs.join(F.broadcast(ends), "text_sha256", "left").select(
        "doc_id",
        F.coalesce("whole_max", "run_max").alias("keep_id"),
        F.coalesce("whole_len", "run_len").alias("group_size"),
        (F.col("first") & F.col("doc_id").eqNullSafe(F.coalesce("whole_max", "run_max"))).alias("kept"),
        "text_sha256",
    )


_OWN = ("__voxelrank_head", "__voxelrank_hash", "__voxelrank_id", "__voxelrank_row")


def first_rows(text_at: int, n_columns: int):
    """Rows sorted by (head, hash, id descending), these four behind ``n_columns`` others -> the first row of each content.

    The others go; a digest and whether the content's key stands at an end of the partition come instead.
    Texts are read only where two rows share a key, and then compared in full.
    """

    def norm(batch, i):
        return (batch.column(text_at)[i].as_py() or "").encode().lower()  # of the bytes, A-Z alone change

    def out(batch, rows, edge):
        names = [*batch.schema.names[:n_columns], "__voxelrank_sha", "__voxelrank_edge", *_OWN[2:]]
        taken = batch.take(pa.array(rows, pa.int64()))
        sha = [hashlib.sha256(norm(taken, i)).hexdigest() if edge else None for i in range(taken.num_rows)]
        cols = [*taken.columns[:n_columns], pa.array(sha, pa.string()), pa.array([edge] * taken.num_rows), taken.column(n_columns + 2), taken.column(n_columns + 3)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        key = first_key = None
        held: list = []  # (one-row batch, its text once needed) of each content of the running key that came in an earlier batch
        for b in batches:
            if not b.num_rows:
                continue
            heads, hashes = b.column(n_columns).to_pylist(), b.column(n_columns + 1).to_pylist()
            plain, firsts, texts = [], [], {}  # rows of finished keys; of the running one; texts read so far

            def text(i):
                if i not in texts:
                    texts[i] = norm(b, i)
                return texts[i]

            for i, here in enumerate(zip(heads, hashes)):
                if here != key:
                    if held:
                        for one, _ in held:
                            yield out(one, [0], key == first_key)
                        held = []
                    if key is None:
                        first_key = here
                    if firsts:
                        if key == first_key:
                            yield out(b, firsts, True)
                        else:
                            plain += firsts
                    key, firsts = here, [i]
                    texts.clear()
                    continue
                for k, (one, known) in enumerate(held):
                    if known is None:
                        held[k] = (one, known := norm(one, 0))
                    if known == text(i):
                        break
                else:
                    if not any(text(j) == text(i) for j in firsts):
                        firsts.append(i)
                        continue
                texts.pop(i, None)
            if plain:
                yield out(b, plain, False)
            held += [(b.take(pa.array([i], pa.int64())), texts.get(i)) for i in firsts]
        for one, _ in held:
            yield out(one, [0], True)

    return run


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` does not keep, all columns unchanged.

    One row for each text stays, also where rows repeat both id and text (then the one that comes
    first in the table).  The rows travel once, through the content sort; nulls, empty and long
    texts and empty tables are as in :func:`exact_dedup`.
    """
    head, hashed, doc, row = _OWN
    norm = normalised(text_col)
    keyed = docs.select("*", F.substring(norm, 1, HEAD).alias(head), F.xxhash64(norm).alias(hashed), F.col(id_col).cast("long").alias(doc), F.monotonically_increasing_id().alias(row))
    sorted_ = keyed.repartitionByRange(head, hashed, doc, row).sortWithinPartitions(head, hashed, F.desc_nulls_last(doc), row)
    schema = docs.select("*").schema.add("__voxelrank_sha", "string").add("__voxelrank_edge", "boolean").add(doc, "long").add(row, "long")
    found = materialise(sorted_.mapInArrow(first_rows(docs.columns.index(text_col), len(docs.columns)), schema))
    # At most the contents at the two ends of each partition, as above.
    ends = found.filter("__voxelrank_edge").select(F.col("__voxelrank_sha").alias("sha"), F.struct(F.col(doc), -F.col(row)).alias("place"))
    best = ends.groupBy("sha").agg(F.max("place").alias("best"))
    own = F.struct(F.col(doc), -F.col(row))
    return found.join(F.broadcast(best), F.col("__voxelrank_sha") == F.col("sha"), "left").filter(F.col("best").isNull() | own.eqNullSafe(F.col("best"))).select(*docs.columns)

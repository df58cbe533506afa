"""Exact percentiles of a column without one task that sees all of its values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different values that the driver counts through at the end; accuracy of the sketches that narrow the range.
FEW, ACCURACY = 20_000, 5_000


def _rank(values: DataFrame, wanted: int, n: int, few: int, accuracy: int) -> float:
    """The value of rank ``wanted`` (from 0) of ``v``: a sketch gives two values around it, counts tell on which side of them it lies.

    Each round leaves out the two values at least, and mostly all but a few thousandths of the rest.
    """
    held, v = values, F.col("v")
    while n > few:
        share = wanted / max(n - 1, 1)
        a, b = held.agg(F.percentile_approx("v", F.array(*(F.lit(min(max(share + e / accuracy, 0.0), 1.0)) for e in (-2, 2))), F.lit(accuracy)).alias("p")).first().p
        parts = [(v < a, None), (v == a, a), ((v > a) & (v < b), None), ((v == b) & F.lit(b > a), b), (v > b, None)]
        sizes = held.agg(*(F.count_if(at).alias(f"n{i}") for i, (at, _) in enumerate(parts))).first()
        for (at, value), size in zip(parts, sizes):
            if wanted < size:
                break
            wanted -= size
        if value is not None:
            return value
        held, n = held.filter(at), size
    for r in held.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect():
        if wanted < r.n:
            return r.v
        wanted -= r.n
    raise ValueError("the values changed while they were counted")


def percentiles(df: DataFrame, value: str, shares: Sequence[float], few: int = FEW, accuracy: int = ACCURACY) -> list[float | None]:
    """Exact percentiles with linear interpolation, nulls and NaN left out; None for each where nothing is left.

    A sketch of fixed size brackets the wanted rank, a count proves the bracket, and the next round
    looks into the bracket only, until few values are left in it.
    """
    values = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n, out = values.count(), []
    for share in shares:
        if not n:
            out.append(None)
            continue
        at = share * (n - 1)
        low = _rank(values, math.floor(at), n, few, accuracy)
        part = at - math.floor(at)
        if part:
            upto, above = values.agg(F.count_if(F.col("v") <= low), F.min(F.when(F.col("v") > low, F.col("v")))).first()
            low += part * ((low if upto > math.floor(at) + 1 else above) - low)
        out.append(low)
    return out

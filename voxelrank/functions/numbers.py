"""Numeric columns: finite values, normalisation, temperature, targets."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def zscore(c: Column, over: Window, least: float = 1e-6) -> Column:
    """Population z-score within a window; zeros where the spread is degenerate."""
    spread = F.stddev_pop(c).over(over)
    return F.when(spread < least, F.lit(0.0)).otherwise((c - F.avg(c).over(over)) / spread)


def minmax(c: Column, over: Window, least: float = 1e-6) -> Column:
    low, high = F.min(c).over(over), F.max(c).over(over)
    return F.when(high - low < least, F.lit(0.0)).otherwise((c - low) / (high - low))


def blend(coarse: Column, fine: Column, alpha: float) -> Column:
    a = min(max(alpha, 0.0), 1.0)
    return (1 - a) * coarse + a * fine


def softmax(logit: Column, over: Window, least: float = 1e-12) -> Column:
    e = F.exp(logit - F.max(logit).over(over))
    return e / (F.sum(e).over(over) + least)


def distance_target(d: Column, mode: str = "log1p", clip: float = 256.0) -> Column:
    """Training target of a distance: ``raw``, ``clipped`` or ``log1p``; missing ones count as ``clip``."""
    known = F.coalesce(finite(d), F.lit(clip))
    if mode == "raw":
        return known
    held = F.least(F.greatest(known, F.lit(0.0)), F.lit(clip))
    if mode == "clipped":
        return held
    if mode == "log1p":
        return F.log1p(held)
    raise ValueError(f"unknown mode {mode!r}")


def trimmed_mean(values: Column, trim: float) -> Column:
    """Mean of the smallest max(1, floor(n * (1 - trim))) values of an array; trim is held within [0, 0.49]; 0 for none."""
    t = min(max(trim, 0.0), 0.49)
    keep = F.greatest(F.lit(1), F.floor(F.size(values) * F.lit(1 - t)).cast("int"))
    kept = F.slice(F.sort_array(values), F.lit(1), keep)
    return F.when(F.size(values) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / keep).otherwise(0.0)

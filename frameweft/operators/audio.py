"""Waveforms as arrays: level, loudness and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rms(x: Column) -> Column:
    """The root of the mean square, 1e-12 added to the mean, in double precision; the root of 1e-12 if empty."""
    total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return F.sqrt(F.when(F.size(x) > 0, total / F.size(x)).otherwise(0.0) + 1e-12)


def loudness_normalised(x: Column, target_db: float, peak: float = 0.99) -> Column:
    """x at target_db of full scale, or less if its peak would pass peak."""
    gain = F.pow(F.lit(10.0), F.lit(target_db / 20)) / rms(x)
    top = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))) * gain
    limit = F.when(top > peak, peak / top).otherwise(1.0)
    return F.transform(x, lambda v: v.cast("double") * gain * limit)


def full_chunks(x: Column, size: int) -> Column:
    """x in runs of size samples; the rest is left out."""
    n = F.floor(F.size(x) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(x, i * size + 1, size))).otherwise(F.array())

"""Sequence functions over the frames of a clip, as window expressions.

All windows partition by the clip key, so a chain of them needs one exchange.
Every function takes a DataFrame with clip_key and frame_index and adds columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CLIP, FRAME = "clip_key", "frame_index"


def ordered() -> WindowSpec:
    return Window.partitionBy(CLIP).orderBy(FRAME)


def whole() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def clip01(x: Column) -> Column:
    """x limited to [0, 1]; null stays null, and NaN counts as null."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def odd(window: int) -> int:
    return window + 1 if window % 2 == 0 else window


def moving_sum(x: Column, window: int) -> Column:
    """The sum of a centred window of odd(window) frames, the first and last value repeated beyond the ends."""
    half = odd(window) // 2
    if window <= 1:
        return x
    i = F.row_number().over(ordered()) - 1
    n = F.count(F.lit(1)).over(whole())
    before, after = F.greatest(F.lit(0), F.lit(half) - i), F.greatest(F.lit(0), F.lit(half) - (n - 1 - i))
    return F.sum(x).over(ordered().rowsBetween(-half, half)) + before * F.first(x).over(whole()) + after * F.last(x).over(whole())


def moving_average(x: Column, window: int) -> Column:
    return moving_sum(x, window) / odd(window) if window > 1 else x


def with_gate(df: DataFrame, x: str, on: float, off: float, least: int, out: str = "gate") -> DataFrame:
    """Adds out and event_id. An event opens at the first x >= on, stays open while x >= off, and
    counts if it has least frames; off <= on. Between two values below off lies one event at most."""
    if off > on:
        raise ValueError("off must not exceed on")
    low = (F.col(x) < off).cast("int")
    df = df.withColumn("event_id", F.sum(F.coalesce(low, F.lit(1))).over(ordered()))
    island = Window.partitionBy(CLIP, "event_id")
    opened = F.max((F.col(x) >= on).cast("int")).over(island.orderBy(FRAME).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_open", F.coalesce(opened * (F.col(x) >= off).cast("int"), F.lit(0)))
    return df.withColumn(out, (F.col("_open") == 1) & (F.sum("_open").over(island) >= least)).drop("_open")


def fill_gaps(x: Column, known: Column) -> Column:
    """x where known, else the line between the known neighbours; beyond the ends the nearest known, else 0."""
    v, at = F.when(known, F.coalesce(x, F.lit(0.0))), F.when(known, F.col(FRAME))
    back, forth = ordered().rowsBetween(Window.unboundedPreceding, 0), ordered().rowsBetween(0, Window.unboundedFollowing)
    lo, hi, i, j = F.last(v, True).over(back), F.first(v, True).over(forth), F.last(at, True).over(back), F.first(at, True).over(forth)
    line = F.when(j > i, lo + (hi - lo) * (F.col(FRAME) - i) / (j - i)).otherwise(lo)
    return F.coalesce(line, lo, hi, F.lit(0.0))


def robust_norm(x: Column) -> Column:
    """|x| over its 95th percentile in the clip (interpolated, 1e-6 at least), 1 at most."""
    top = F.percentile(F.abs(x), F.lit(0.95)).over(Window.partitionBy(CLIP))
    return F.least(F.abs(x) / F.greatest(top, F.lit(1e-6)), F.lit(1.0))


def difference(x: Column) -> Column:
    """x minus the value before it; 0 for the first frame."""
    return x - F.coalesce(F.lag(x).over(ordered()), x)


def with_turns(df: DataFrame, x: str, group: list[str], out: str = "turns") -> DataFrame:
    """Adds the turns of x in each group: changes of sign of its steps, without steps of 0."""
    inside = Window.partitionBy(*group).orderBy(FRAME)
    df = df.withColumn("_step", F.signum(F.col(x) - F.lag(x).over(inside)))
    earlier = F.last(F.when(F.col("_step") != 0, F.col("_step")), True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_turn", F.coalesce((F.col("_step") * earlier < 0).cast("int"), F.lit(0)))
    return df.withColumn(out, F.sum("_turn").over(Window.partitionBy(*group))).drop("_step", "_turn")


def longest_run(df: DataFrame, active: Column) -> DataFrame:
    """Per clip the length of the longest run of active frames, 0 if there is none."""
    marked = df.select(CLIP, FRAME, F.coalesce(active, F.lit(False)).alias("_a"))
    place = F.row_number().over(ordered()) - F.row_number().over(Window.partitionBy(CLIP, "_a").orderBy(FRAME))
    runs = marked.withColumn("_r", place).groupBy(CLIP, "_a", "_r").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(CLIP).agg(F.coalesce(F.max(F.when(F.col("_a"), F.col("n"))), F.lit(0)).alias("longest_run"))

"""Reaction detectors: fused channels, smoothed, gated, and constrained by the motion in each event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import CLIP, clip01, difference, fill_gaps, moving_average, robust_norm, with_gate, with_turns

#: Smoothed values are rounded before they meet a threshold, so that the order of additions can't flip a decision.
DIGITS = 6


@dataclass(frozen=True)
class Gate:
    smooth: int
    on: float
    off: float
    least: int


@dataclass(frozen=True)
class Motion:
    gate: Gate
    baseline: int
    weights: tuple[float, float, float]
    penalty: float
    turns: int
    cycles: int = 0
    span: float = 0.0
    speed: float = 0.0


# The detectors' default parameters.
SMILING = Gate(7, 0.45, 0.30, 6)
LAUGHING = Gate(9, 0.52, 0.36, 8)
FROWNING = Gate(7, 0.42, 0.30, 6)
SURPRISED = Gate(7, 0.45, 0.32, 5)
NODDING_V1 = Motion(Gate(7, 0.42, 0.30, 6), 31, (0.7, 0.5, 0.4), 0.35, 1)
NODDING = Motion(Gate(9, 0.58, 0.42, 10), 45, (0.40, 0.35, 0.25), 0.50, 2, 1, 3.0, 0.20)
HEAD_SHAKING = Motion(Gate(9, 0.50, 0.35, 7), 40, (0.7, 0.5, 0.4), 0.40, 1, 0, 2.0, 0.12)


def join_emotions(faces: DataFrame, emotions: DataFrame, *channels: str) -> DataFrame:
    """Emotion values at the frames of faces, 0 where there is none; frames beyond these are left out."""
    return faces.join(emotions.select(CLIP, "frame_index", *channels), [CLIP, "frame_index"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in channels})


def smiling_raw(happy: Column, smile: Column) -> Column:
    return 0.65 * happy + 0.35 * smile


def with_jaw_motion(df: DataFrame, jaw: str, out: str = "jaw_motion") -> DataFrame:
    """Adds four times the smoothed change of jaw from frame to frame, limited to [0, 1]."""
    return df.withColumn("_step", F.abs(difference(F.col(jaw)))).withColumn(out, clip01(4 * moving_average(F.col("_step"), 5))).drop("_step")


def laughing_raw(happy: Column, smile: Column, jaw: Column, motion: Column) -> Column:
    return 0.80 * (0.50 * happy + 0.25 * smile + 0.25 * jaw) + 0.20 * motion


def frowning_raw(sad: Column, angry: Column, mouth: Column, brow: Column, au04: Column) -> Column:
    return 0.7 * (0.6 * sad + 0.4 * angry) + 0.7 * (0.8 * (mouth + brow + au04))


def surprised_raw(surprise: Column, jaw: Column, eyes: Column, brow: Column) -> Column:
    return 0.7 * surprise + 0.7 * (jaw + eyes + brow)


def expression_intensity(frames: DataFrame, raw: Column, gate: Gate, detected: str = "detected", out: str = "intensity") -> DataFrame:
    """out: the smoothed raw value within events, else 0."""
    seen = F.when(F.col(detected), 1.0).otherwise(0.0)
    df = frames.withColumn("_raw", clip01(raw * seen)).withColumn("_s", F.round(moving_average(F.col("_raw"), gate.smooth), DIGITS))
    df = with_gate(df, "_s", gate.on, gate.off, gate.least)
    return df.withColumn(out, F.when(F.col("gate"), clip01(F.col("_s"))).otherwise(0.0)).drop("_raw", "_s", "event_id", "gate")


def motion_intensity(frames: DataFrame, axis: str, other: str, spec: Motion, detected: str = "detected", out: str = "intensity") -> DataFrame:
    """out: the smoothed motion of an axis within events that turn, swing and move enough, else 0.

    Gaps of undetected frames are filled, a slow baseline is taken off; position,
    first and second difference are normalised and weighted, the other axis' speed counts against them.
    """
    df = frames.withColumns({"_p": fill_gaps(F.col(axis), F.col(detected)), "_q": fill_gaps(F.col(other), F.col(detected))})
    df = df.withColumns({c: F.round(F.col(c) - moving_average(F.col(c), spec.baseline), DIGITS) for c in ("_p", "_q")})
    df = df.withColumns({"_v": difference(F.col("_p")), "_w": difference(F.col("_q"))}).withColumn("_a", difference(F.col("_v")))
    seen = F.when(F.col(detected), 1.0).otherwise(0.0)
    amp, vel, acc = spec.weights
    raw = clip01(amp * robust_norm(F.col("_p")) + vel * robust_norm(F.col("_v")) + acc * robust_norm(F.col("_a")) - spec.penalty * robust_norm(F.col("_w"))) * seen
    df = df.withColumn("_raw", raw).withColumn("_s", F.round(moving_average(F.col("_raw"), spec.gate.smooth), DIGITS))
    df = with_gate(df, "_s", spec.gate.on, spec.gate.off, spec.gate.least)
    event = [CLIP, "event_id", "gate"]
    df = with_turns(df, "_p", event)
    inside = Window.partitionBy(*event)
    df = df.withColumns({"_span": F.round(F.max("_p").over(inside) - F.min("_p").over(inside), DIGITS), "_speed": F.round(F.max(F.abs("_v")).over(inside), DIGITS)})
    holds = F.col("gate") & (F.col("turns") >= spec.turns) & (F.floor(F.col("turns") / 2) >= spec.cycles) & (F.col("_span") >= spec.span) & (F.col("_speed") >= spec.speed)
    return df.withColumn(out, F.when(holds, clip01(F.col("_s"))).otherwise(0.0)).drop("_p", "_q", "_v", "_w", "_a", "_raw", "_s", "event_id", "gate", "turns", "_span", "_speed")

"""From a manifest and the tables that it names to intensities and an outcome for each clip."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import output_key
from ..sources import readers, sinks
from . import detectors
from .detectors import Gate, Motion
from .manifest import parse_manifest, resolved_emotions


def check_gate(gate: Gate) -> Gate:
    """gate, if its windows are positive and it doesn't close above where it opens."""
    if gate.smooth <= 0 or gate.least <= 0:
        raise ValueError("smooth and least must be positive")
    if gate.off > gate.on:
        raise ValueError("off must not exceed on")
    return gate


def check_motion(spec: Motion) -> Motion:
    check_gate(spec.gate)
    if spec.baseline <= 0:
        raise ValueError("baseline must be positive")
    if spec.turns < 0 or spec.cycles < 0:
        raise ValueError("turns and cycles must not be negative")
    return spec


# The profiles of the second nodding detector.
NODDING_PROFILES = {
    "strict": Motion(Gate(11, 0.60, 0.45, 10), 45, (0.40, 0.35, 0.25), 0.50, 2, 1, 3.0, 0.20),
    "balanced": Motion(Gate(9, 0.50, 0.35, 7), 40, (0.40, 0.35, 0.25), 0.40, 1, 0, 2.0, 0.12),
    "recall": Motion(Gate(7, 0.45, 0.30, 6), 35, (0.40, 0.35, 0.25), 0.35, 1, 0, 1.8, 0.10),
}


@dataclass(frozen=True)
class Expression:
    """emotions: channels of the emotion tables; raw: the fused value, of emotions and blendshape means."""

    emotions: tuple[str, ...]
    raw: Callable[[], Column]
    gate: Gate


DETECTORS: dict[str, Expression | tuple[str, str, Motion]] = {
    "smiling": Expression(("happy",), lambda: detectors.smiling_raw(F.col("happy"), F.col("smile")), detectors.SMILING),
    "laughing": Expression(("happy",), lambda: detectors.laughing_raw(F.col("happy"), F.col("smile"), F.col("jaw_open"), F.col("jaw_motion")), detectors.LAUGHING),
    "frowning": Expression(("sad", "angry"), lambda: detectors.frowning_raw(F.col("sad"), F.col("angry"), F.col("mouth_frown"), F.col("brow_down"), F.col("au04")), detectors.FROWNING),
    "surprised": Expression(("surprise",), lambda: detectors.surprised_raw(F.col("surprise"), F.col("jaw_open"), F.col("eye_wide"), F.col("brow_inner_up")), detectors.SURPRISED),
    "nodding_v1": ("pitch", "yaw", detectors.NODDING_V1),
    "nodding": ("pitch", "yaw", detectors.NODDING),
    "head_shaking": ("yaw", "pitch", detectors.HEAD_SHAKING),
}


def detect(name: str, faces: DataFrame, emotions: DataFrame | None = None, gate: Gate | None = None, motion: Motion | None = None) -> DataFrame:
    """clip_key, frame_index and <name>_intensity of all clips of faces.

    faces: clip_key, frame_index, detected, blendshapes, pitch, yaw. emotions: clip_key, frame_index, line_no
    and channels as text. Parameters are checked before anything runs.
    """
    found, out = DETECTORS[name], f"{name}_intensity"
    if isinstance(found, Expression):
        gate = check_gate(gate or found.gate)
        shapes = readers.blendshape_means(faces.withColumn("detected", F.coalesce("detected", F.lit(False))))
        scores = readers.emotion_scores(emotions, list(found.emotions))
        joined = detectors.with_jaw_motion(detectors.join_emotions(shapes, scores, *found.emotions), "jaw_open")
        return detectors.expression_intensity(joined, found.raw(), gate, out=out).select("clip_key", "frame_index", out)
    axis, other, spec = found
    spec = check_motion(motion or (replace(spec, gate=gate) if gate else spec))
    return detectors.motion_intensity(readers.pose_angles(faces), axis, other, spec, out=out).select("clip_key", "frame_index", out)


def outcomes(manifest: DataFrame, **listings: DataFrame) -> DataFrame:
    """manifest with ok and message: which of a clip's tables is missing, by listings of paths named as the manifest's columns."""
    message = F.lit("ok")
    for column, listing in reversed(listings.items()):
        there = listing.select(F.col("path").alias(column)).distinct().withColumn(f"_{column}", F.lit(True))
        manifest = manifest.join(there, column, "left")
        message = F.when(F.col(f"_{column}").isNull(), F.concat(F.lit(f"{column} not found: "), F.col(column))).otherwise(message)
    return manifest.withColumn("message", message).withColumn("ok", F.col("message") == "ok").drop(*(f"_{c}" for c in listings))


def run_detector(spark: SparkSession, name: str, manifest_path: str, emotion_path: str, face_path: str, out: str, root: str, *, sample: int | None = None, seed: int = 0, overwrite: bool = False, csv: bool = False, gate: Gate | None = None, motion: Motion | None = None) -> DataFrame:
    """The detector over the clips of a manifest file; its outcomes, which are returned, are written beside the intensities.

    emotion_path: a folder of CSV files. face_path: Parquet of face frames, with the path of the table
    that a frame is from. A clip without its tables fails alone. Intensities go to <out>/intensity,
    as Parquet or CSV, outcomes to <out>/outcomes.
    """
    from .manifest import seeded_sample

    found = DETECTORS[name]
    emotions = found.emotions if isinstance(found, Expression) else ()
    check_gate(gate or (found.gate if isinstance(found, Expression) else found[2].gate))
    listed = parse_manifest(readers.read_lines(spark, manifest_path).select("value"))
    listed = seeded_sample(listed, "video_path", sample, seed) if sample else listed
    faces, tables = spark.read.parquet(face_path), None
    plain = lambda df: df.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    listings = {"face_path": faces.select("path")}
    if emotions:
        tables = plain(readers.read_csv_frames(spark, emotion_path, ["frame_index", *emotions]))
        listings["fer_path"] = plain(readers.discover(spark, emotion_path, "csv"))
        listed = resolved_emotions(listed, "fer_path", listings["fer_path"], "video_path").drop("fer_path").withColumnRenamed("fer_path_resolved", "fer_path")
    results = outcomes(listed, **listings).withColumn("clip_key", output_key(F.col("video_path"), root))
    good = results.where("ok").select("clip_key", "fer_path", "face_path")
    own = faces.join(good.select("clip_key", F.col("face_path").alias("path")), "path").drop("path")
    scores = tables.join(good.select("clip_key", F.col("fer_path").alias("path")), "path").drop("path") if emotions else None
    signal = detect(name, own, scores, gate, motion)
    if csv:
        sinks.write_signal_csv(signal, f"{out}/intensity", f"{name}_intensity", overwrite=overwrite)
    else:
        sinks.write_signals(signal.withColumn("reaction", F.lit(name)), f"{out}/intensity", overwrite)
    done = results.select("video_path", "clip_key", "ok", "message")
    done.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{out}/outcomes")
    return spark.read.parquet(f"{out}/outcomes")

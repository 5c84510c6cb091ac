"""Writers. Tables stay Parquet; text is made at the edge only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_signals(df: DataFrame, path: str, overwrite: bool = False, by: str = "reaction") -> None:
    """Frame tables, partitioned by a column of few values and clustered by clip within it."""
    df.repartition(by, "clip_key").sortWithinPartitions("clip_key", "frame_index").write.partitionBy(by).mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_chunks(df: DataFrame, path: str, overwrite: bool = False, compression: str = "gzip") -> None:
    """Chunk tables, partitioned by modality."""
    df.write.partitionBy("modality").option("compression", compression).mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_signal_csv(df: DataFrame, path: str, *values: str, overwrite: bool = False) -> None:
    """CSV with six decimals, a folder per clip, its frames in order."""
    text = [F.format_string("%.6f", F.col(v)).alias(v) for v in values]
    rows = df.select("clip_key", "frame_index", *text).repartition("clip_key").sortWithinPartitions("clip_key", "frame_index")
    rows.write.partitionBy("clip_key").option("header", "true").mode("overwrite" if overwrite else "errorifexists").csv(path)


def manifest_lines(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.concat_ws(",", *columns).alias("value"))


def write_manifest(df: DataFrame, path: str, *columns: str, overwrite: bool = False) -> None:
    manifest_lines(df, *columns).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The work whose output isn't there yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_lines(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Lines (value) as text, in one file, in their order: reports and manifests."""
    lines.coalesce(1).write.mode(_mode(overwrite)).text(path)


def write_segments(texts: DataFrame, path: str, overwrite: bool = False) -> None:
    """The text of each chunk (clip_key, chunk, text) in the folder of its clip and chunk: clip_key=<key>/chunk_name=chunk_<number>."""
    named = texts.select("clip_key", F.format_string("chunk_%03d", F.col("chunk").cast("int")).alias("chunk_name"), "text")
    named.repartition("clip_key").write.mode(_mode(overwrite)).partitionBy("clip_key", "chunk_name").text(path)


def sample_rows(selected: DataFrame) -> DataFrame:
    """The columns of the sample manifest, with six decimals."""
    six = lambda c: F.format_string("%.6f", F.col(c))
    return selected.select("video_path", F.col("csv_path").alias("score_csv_path"), six("peak").alias("peak_score"), F.col("longest_run").alias("max_consecutive_active_frames"), six("active_ratio").alias("active_ratio"), "overlay_video_path")


def write_samples(selected: DataFrame, path: str, overwrite: bool = False) -> None:
    sample_rows(selected).coalesce(1).write.mode(_mode(overwrite)).option("header", "true").csv(path)


def write_legacy(general: DataFrame, points: DataFrame, path: str, overwrite: bool = False) -> None:
    """The two tables of a video, each in a folder of its own."""
    for name, df in (("head_and_frown", general), ("keypoints", points)):
        df.write.mode(_mode(overwrite)).option("header", "true").csv(f"{path}/{name}")


def overlay_labels(frames: DataFrame, scores: DataFrame, name: str, value: str) -> DataFrame:
    """The label of each frame of a video, <name>: <score>; a frame without a score has 0."""
    joined = frames.select("clip_key", "frame_index").join(scores.select("clip_key", "frame_index", value), ["clip_key", "frame_index"], "left")
    return joined.select("clip_key", "frame_index", F.format_string("%s: %.3f", F.lit(name), F.coalesce(F.col(value), F.lit(0.0))).alias("label"))

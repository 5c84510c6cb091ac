"""Winner-take-all over reaction channels, chunks aligned with an anchor, and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_precision, number

_CHUNK = r"^chunk_\d+$"
# The channels in the order that breaks ties.
CHANNELS = ("smiling", "laughing", "frowning", "surprised", "nodding", "head_shaking")


def winner_take_all(*channels: str) -> dict[str, Column]:
    """Each channel where it is the first of the greatest and above 0, else 0."""
    values = F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in channels))
    top = F.array_max(values)
    first = F.array_position(values, top)
    return {c: F.when((first == i) & (top > 0), top).otherwise(0.0) for i, c in enumerate(channels, 1)}


def combine(reactions: DataFrame, channels: tuple[str, ...] = CHANNELS, complete: bool = True) -> DataFrame:
    """Long rows (clip_key, reaction, frame_index, intensity, line_no) to one row per frame of any channel.

    One shuffle on (clip, frame) takes the place of full outer joins; the last
    line of a frame wins, frames that a channel lacks are 0. complete: only clips
    that have all channels.
    """
    wide = reactions.groupBy("clip_key", "frame_index").pivot("reaction", list(channels)).agg(F.max_by("intensity", "line_no"))
    if complete:
        there = reactions.where(F.col("reaction").isin(*channels)).groupBy("clip_key").agg(F.count_distinct("reaction").alias("n")).where(F.col("n") == len(channels))
        wide = wide.join(there, "clip_key", "left_semi")
    return wide.select("clip_key", "frame_index", *(c.alias(k) for k, c in winner_take_all(*channels).items()))


def chunk(rows: DataFrame, size: int, order: list[str], values: list[str], key: str = "clip_key") -> DataFrame:
    """Full chunks of size rows by position after a stable sort; the rest of a clip is left out."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    placed = rows.select(key, *values, place.alias("_at"), total.alias("_n"))
    placed = placed.withColumn("chunk_idx", F.floor(F.col("_at") / size).cast("int")).where(F.col("chunk_idx") < F.floor(F.col("_n") / size))
    data = F.transform(F.sort_array(F.collect_list(F.struct("_at", F.array(*values).alias("v")))), lambda s: s["v"])
    out = placed.groupBy(key, "chunk_idx").agg(data.alias("data"))
    return out.withColumn("chunk_name", F.format_string("chunk_%03d", "chunk_idx"))


def align(chunks: DataFrame, anchor: DataFrame, key: str = "clip_key") -> DataFrame:
    """The chunks of clips that the anchor has, as many of each as it has there."""
    counts = anchor.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return chunks.join(counts, key).where(F.col("chunk_idx") < F.col("_n")).drop("_n")


def prune(others: DataFrame, kept: DataFrame, key: str = "clip_key", name: str = "chunk_name") -> DataFrame:
    """The chunks of others that kept has, and what else their clips have. A clip without any such chunk goes whole.

    kept comes as one row of names per clip, so that all takes one exchange on the clip.
    """
    names = kept.where(F.col(name).rlike(_CHUNK)).groupBy(key).agg(F.collect_set(name).alias("_names"))
    marked = others.join(names, key).withColumn("_chunk", F.col(name).rlike(_CHUNK))
    marked = marked.withColumn("_there", F.col("_chunk") & F.array_contains("_names", F.col(name)))
    marked = marked.withColumn("_any", F.max("_there").over(Window.partitionBy(key)))
    return marked.where("_there or (not _chunk and _any)").drop("_names", "_chunk", "_there", "_any")


def half_chunks(chunks: DataFrame, data: str = "data") -> DataFrame:
    """Chunks as they are stored: every value as half precision holds it."""
    return chunks.withColumn(data, F.transform(data, lambda row: F.transform(row, half_precision)))


def matrix(rows: DataFrame, channels: tuple[str, ...] = CHANNELS, order: str = "line_no") -> DataFrame:
    """Combined rows in the order of their frames, equal frames in that of their lines: clip_key, position, values.
    A value or an index that isn't a number is an error."""
    strict = lambda c: F.when(number(F.col(c)).isNull(), F.raise_error(F.concat(F.lit(f"{c} isn't a number: "), F.coalesce(c, F.lit("null"))))).otherwise(number(F.col(c)))
    typed = rows.select("clip_key", order, strict("frame_index").cast("int").alias("frame_index"), *(strict(c).alias(c) for c in channels))
    place = F.row_number().over(Window.partitionBy("clip_key").orderBy("frame_index", order)) - 1
    return typed.select("clip_key", place.alias("position"), "frame_index", F.array(*channels).alias("values"))


def missing_reactions(manifest: DataFrame, listing: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """rel_csv, ok and message for each clip of a manifest, by a listing of (reaction, rel_csv) that exist."""
    there = listing.where(F.col("reaction").isin(*channels)).groupBy("rel_csv").agg(F.count_distinct("reaction").alias("_n"))
    lacking = F.lit(len(channels)) - F.coalesce("_n", F.lit(0))
    message = F.when(lacking == 0, "ok").otherwise(F.format_string("missing %d reaction csv(s)", lacking.cast("int")))
    return manifest.select("rel_csv").distinct().join(there, "rel_csv", "left").select("rel_csv", (lacking == 0).alias("ok"), message.alias("message"))


def combine_clips(manifest: DataFrame, reactions: DataFrame, channels: tuple[str, ...] = CHANNELS) -> tuple[DataFrame, DataFrame]:
    """The driver of combine(): rows of the manifest's complete clips, and an outcome for each of its clips.

    reactions: rel_csv, reaction, frame_index, intensity, line_no, as the readers give them.
    """
    outcomes = missing_reactions(manifest, reactions.select("rel_csv", "reaction").distinct(), channels)
    wanted = reactions.join(outcomes.where("ok").select("rel_csv"), "rel_csv", "left_semi").withColumnRenamed("rel_csv", "clip_key")
    return combine(wanted, channels, complete=False).withColumnRenamed("clip_key", "rel_csv"), outcomes

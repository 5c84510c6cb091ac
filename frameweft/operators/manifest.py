"""Manifests, completeness checks, name repair, sampling and outcome counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.scalar import basename, number, prefix_and_end, stem, suffix, without_suffix


def parse_manifest(lines: DataFrame, text: str = "value") -> DataFrame:
    """video_path, fer_path and face_path of lines with exactly three comma-separated fields."""
    parts = F.transform(F.split(F.trim(text), ","), lambda x: F.trim(x))
    return lines.select("*", parts.alias("_p")).where((F.trim(text) != "") & (F.size("_p") == 3)).select(*(c for c in lines.columns if c != text), F.col("_p")[0].alias("video_path"), F.col("_p")[1].alias("fer_path"), F.col("_p")[2].alias("face_path"))


def _first_field(text: str) -> Column:
    return F.trim(F.split(F.trim(text), ",")[0])


def combine_manifest(lines: DataFrame, root: str, text: str = "value", order: str = "line_no") -> DataFrame:
    """rel_csv and the first line_no of the distinct clips that lines of any arity name: only .mp4 in any case;
    their place below root, else <parent>/<stem>.csv, and none without a parent."""
    video = _first_field(text)
    named = lines.where(F.lower(suffix(video)) == ".mp4").select(order, paths.combined_csv(video, root).alias("rel_csv")).where("rel_csv is not null")
    return named.groupBy("rel_csv").agg(F.min(order).alias(order))


def audio_list(lines: DataFrame, dataset: str, root: str, spoken: bool = True, text: str = "value") -> DataFrame:
    """lines with the path of their audio file, without those whose first field is empty."""
    return lines.where(_first_field(text) != "").withColumn("audio_path", paths.audio_file(_first_field(text), dataset, root, spoken))


def first_existing(df: DataFrame, candidates: list[Column], listing: DataFrame, key: str, out: str, otherwise: Column | None = None) -> DataFrame:
    """df with out: the first of a row's candidate paths that listing has, else otherwise, or null.

    One join on the path does for all candidates; key names a row.
    """
    each = df.select(key, F.posexplode(F.array(*candidates)).alias("_rank", "path")).where("path is not null")
    best = each.join(listing.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.min_by("path", "_rank").alias("_found"))
    chosen = F.col("_found") if otherwise is None else F.coalesce("_found", otherwise)
    return df.join(best, key, "left").withColumn(out, chosen).drop("_found")


def resolved_emotions(df: DataFrame, path: str, listing: DataFrame, key: str) -> DataFrame:
    """df with its emotion tables' paths: as given, or else in the folder emo_scores beside, if one exists."""
    beside = F.concat(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.lit("emo_scores/"), basename(F.col(path)))
    return first_existing(df, [F.col(path), beside], listing, key, path + "_resolved", F.col(path))


def mirrored(videos: DataFrame, tables: DataFrame, video_root: str, table_root: str) -> DataFrame:
    """video_path and table_path of the videos that have a .pkl at the same place below the other root."""
    place = F.concat(F.lit(table_root.rstrip("/") + "/"), without_suffix(paths.under(F.col("path"), video_root)), F.lit(".pkl"))
    mine = videos.where(F.lower(suffix(F.col("path"))).isin(".mp4", ".mov", ".avi", ".mkv", ".webm")).select(F.col("path").alias("video_path"), place.alias("table_path"))
    return mine.where("table_path is not null").join(tables.select(F.col("path").alias("table_path")).distinct(), "table_path", "left_semi").select("video_path", "table_path")


def incomplete(videos: DataFrame, tables: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has, and keys whose frame counts differ, with a reason."""
    both = videos.join(tables, key, "full")
    reason = F.when(F.col("rows").isNull(), "no_table").when(F.col("frames").isNull(), "no_video").when(F.col("rows") != F.col("frames"), "count_differs")
    return both.withColumn("reason", reason).where("reason is not null")


def alignment(pairs: DataFrame) -> DataFrame:
    """Rows of (video_path, pkl_total_frames, video_total_frames, detection_rate, error) with whether the
    counts agree; where error isn't null the figures are, too."""
    fine = F.col("error").isNull()
    figures = {c: F.when(fine, F.col(c)) for c in ("pkl_total_frames", "video_total_frames", "detection_rate")}
    return pairs.withColumns(figures).withColumn("frame_count_match", F.when(fine, F.col("pkl_total_frames") == F.col("video_total_frames")))


def report_lines(report: DataFrame) -> DataFrame:
    """value: the lines of the alignment report, sorted by video, without failed pairs and rates below 1."""
    rate = F.format_string("%.6f", F.round("detection_rate", 6))
    held = report.where(F.round("detection_rate", 6) >= 1.0).orderBy("video_path")
    match = F.when(F.col("frame_count_match"), "True").otherwise("False")
    return held.select(F.concat_ws(",", "video_path", F.col("pkl_total_frames").cast("string"), F.col("video_total_frames").cast("string"), rate, match).alias("value"))


def mismatch_lines(checked: DataFrame) -> DataFrame:
    """value: <path>,<rows>,<frames> for the tables whose counts differ, sorted by path."""
    differ = checked.where("frames is not null and rows <> frames").orderBy("path")
    return differ.select(F.concat_ws(",", "path", F.col("rows").cast("string"), F.col("frames").cast("string")).alias("value"))


def usable_manifest(report: DataFrame, excluded: DataFrame, old: str, emotions: str, faces: str) -> DataFrame:
    """video_path, fer_path and face_path of report rows (video_path and detection_rate as text) that
    are detected throughout and that excluded (video_path) hasn't; rates that are no numbers go."""
    video = F.trim("video_path")
    held = report.where((video != "") & (number(F.col("detection_rate")) == 1.0)).select(video.alias("video_path"))
    held = held.join(excluded.select(F.trim("video_path").alias("video_path")).distinct(), "video_path", "left_anti")
    csv, pkl = paths.manifest_paths(F.col("video_path"), old, emotions, faces)
    return held.select("video_path", csv.alias("fer_path"), pkl.alias("face_path"))


def usable(report: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Report rows that are detected throughout, to six digits, and aren't excluded."""
    return report.where(F.round("detection_rate", 6) == 1.0).join(excluded.select(key).distinct(), key, "left_anti")


def expected_names(lines: DataFrame, text: str = "value") -> DataFrame:
    """The distinct stems of the .mp4 files that lines name in their first field."""
    video = _first_field(text)
    return lines.where(F.lower(suffix(video)) == ".mp4").select(stem(video).alias("name")).distinct()


def repaired_names(found: DataFrame, expected: DataFrame) -> DataFrame:
    """For each name of found: outcome, and as target the one expected name of which it is the beginning.

    Names meet on their prefix up to the last underscore; only then is the rest compared. outcome is
    already_complete, invalid_filename_pattern, prefix_not_in_expected, not_truncated_or_no_match,
    ambiguous_match, target_exists (found has the target, too) or renamed.
    """
    prefix, _ = prefix_and_end(F.col("name"))
    whole, _ = prefix_and_end(F.col("full"))
    a = found.select("name", prefix.alias("prefix"))
    b = expected.select(F.col("name").alias("full")).distinct().withColumn("prefix", whole)
    longer = F.col("full").startswith(F.col("name")) & (F.col("full") != F.col("name"))
    joined = a.join(b.where("prefix is not null"), "prefix", "left").groupBy("name", "prefix").agg(
        F.count("full").alias("known"),
        F.count_if(F.col("full") == F.col("name")).alias("same"),
        F.count_if(longer).alias("n"),
        F.min(F.when(longer, F.col("full"))).alias("target"),
    )
    whole_names = expected.select("name").distinct().withColumn("_complete", F.lit(True))  # an expected name may have no prefix
    joined = joined.join(whole_names, "name", "left").join(found.select(F.col("name").alias("target"), F.lit(True).alias("_taken")).distinct(), "target", "left")
    outcome = F.when(F.col("_complete"), "already_complete").when(F.col("prefix").isNull(), "invalid_filename_pattern").when(F.col("known") == 0, "prefix_not_in_expected")
    outcome = outcome.when(F.col("n") > 1, "ambiguous_match").when(F.col("n") == 0, "not_truncated_or_no_match").when(F.col("_taken"), "target_exists").otherwise("renamed")
    return joined.select("name", outcome.alias("outcome"), F.when(outcome == "renamed", F.col("target")).alias("target"))


def seeded_sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows by the md5 of seed and key, then sorted by key: the same rows on any cluster."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(k).orderBy(key)


def outcome_counts(results: DataFrame, group: str, reason: str = "reason") -> DataFrame:
    """Counts by group and reason, by group, and in total."""
    return results.rollup(group, reason).agg(F.count(F.lit(1)).alias("n"))


def first(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in an order, or all."""
    return df if n is None else df.orderBy(*order).limit(n)


def scheduled(work: DataFrame, done: DataFrame, key: str, n: int | None = None, limit_first: bool = True) -> DataFrame:
    """The work that isn't done, of the first n (limit_first), or the first n of what isn't done."""
    rest = lambda df: df.join(done.select(key).distinct(), key, "left_anti")
    return rest(first(work, n, key)) if limit_first else first(rest(work), n, key)


def round_robin(df: DataFrame, order: str, shards: int) -> DataFrame:
    """df with shard: the place of a row in the order, modulo shards.

    A listing's rows are numbered in one task, by order alone; the rows themselves
    come back to their numbers by a join.
    """
    if shards <= 0:
        raise ValueError("shards must be positive")
    keys = df.select(order).withColumn("shard", ((F.row_number().over(Window.orderBy(order)) - 1) % shards).cast("int"))
    return df.join(keys, order)


def selected(stats: DataFrame, peak: float, run: int, ratio: float, k: int, seed: int, key: str = "video_path") -> DataFrame:
    """The sample manifest: k of the clips that reach all three minima, sorted by key."""
    good = stats.where((F.col("peak") >= peak) & (F.col("longest_run") >= run) & (F.col("active_ratio") >= ratio))
    return seeded_sample(good, key, k, seed)

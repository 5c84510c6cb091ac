"""Readers of frame tables: explicit schemas, text columns that are cast row by row, no inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import LINE_END, au04_proxy, number, whole_number
from ..functions.sequence import clip01

# The suffixes of video files.
VIDEOS = ("mp4", "mov", "avi", "mkv")


def discover(spark: SparkSession, root: str, *suffixes: str, first: int | None = None) -> DataFrame:
    """The paths of files below root, or of the file root, with one of the suffixes (any case), each once, sorted; the
    first so many of them if asked for. Contents aren't read; files without any are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    wanted = "|".join(s.lstrip(".").lower() for s in suffixes or VIDEOS)
    found = files.where(F.lower("path").rlike(rf"\.({wanted})$")).dropDuplicates(["path"]).orderBy("path")
    return found if first is None else found.limit(first)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path and value of each line of the text files below path."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each text file below path, whole."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_prompt(spark: SparkSession, path: str) -> str:
    """The text of one file, without white space at its ends."""
    return (spark.read.text(path, wholetext=True).first() or [""])[0].strip()


def read_csv_frames(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV files with a header as text columns, with path and line_no, the order of a file's lines.

    A column that a file lacks is null, and a file may have its columns in any order: lines are
    read as text, and fields go by the header of their own file. Quoted line ends aren't supported.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", LINE_END).alias("lines"))
    fields = lambda line: F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.regexp_replace(F.regexp_replace(x, '^\\s*"|"\\s*$', ""), '""', '"'))
    rows = files.select("path", fields(F.col("lines")[0]).alias("header"), F.posexplode("lines").alias("line_no", "line")).where("line_no > 0 and line <> ''")
    rows = rows.select("path", "line_no", "header", fields(F.col("line")).alias("cells"))
    cell = lambda c: F.try_element_at("cells", F.nullif(F.array_position("header", c), F.lit(0)).cast("int"))
    return rows.select("path", "line_no", "header", *(cell(c).alias(c) for c in columns))


def frame_number(text: Column) -> Column:
    """A frame index that may be written as a decimal; its fraction is cut off."""
    return number(text).try_cast("int")


def emotion_scores(rows: DataFrame, channels: list[str], order: str = "line_no") -> DataFrame:
    """One row per clip and frame: channels as numbers in [0, 1]. An empty or missing score is 0; rows in which
    the index isn't a whole number, or a score no number, are left out, and of several rows the last counts."""
    scores = {c: clip01(number(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("0")))) if c in rows.columns else F.lit(0.0) for c in channels}
    good = rows.select("clip_key", order, whole_number(F.col("frame_index")).alias("frame_index"), *(v.alias(c) for c, v in scores.items())).dropna(subset=["frame_index", *channels])
    return good.groupBy("clip_key", "frame_index").agg(*(F.max_by(c, order).alias(c) for c in channels))


def score_column(columns: list[str], expected: str) -> str:
    """The expected column, else the only one beside frame_index; an error if there are several or none."""
    others = [c for c in columns if c != "frame_index"]
    if expected in columns:
        return expected
    if len(others) != 1:
        raise ValueError(f"which of {others} is the score?")
    return others[0]


def sample_column(columns: list[str]) -> str:
    """The first column that ends in _intensity, else the first beside frame_index."""
    others = [c for c in columns if c != "frame_index"]
    if "frame_index" not in columns or not others:
        raise ValueError(f"no frame_index or no score in {columns}")
    return next((c for c in others if c.endswith("_intensity")), others[0])


def reaction_scores(rows: DataFrame, value: str, order: str = "line_no") -> DataFrame:
    """One row per clip and frame of text columns frame_index and value: the index may be a decimal, and is cut;
    scores aren't limited; rows in which either is no number are left out, and of several rows the last counts."""
    good = rows.select("clip_key", order, frame_number(F.col("frame_index")).alias("frame_index"), number(F.col(value)).alias(value)).dropna(subset=["frame_index", value])
    return good.groupBy("clip_key", "frame_index").agg(F.max_by(value, order).alias(value))


def densified(scores: DataFrame, value: str, length: int | None = None) -> DataFrame:
    """Each clip's frames from 0 to its last one, or to length - 1, with 0 where value is missing."""
    last = F.max("frame_index") if length is None else F.lit(length - 1)
    inside = scores.where("frame_index >= 0") if length is None else scores.where(f"frame_index between 0 and {length - 1}")
    every = scores.groupBy("clip_key").agg(last.alias("_last")).where("_last >= 0").select("clip_key", F.explode(F.sequence(F.lit(0), "_last")).alias("frame_index"))
    return every.join(inside, ["clip_key", "frame_index"], "left").select("clip_key", "frame_index", F.coalesce(clip01(F.col(value)), F.lit(0.0)).alias(value))


def blendshape_means(faces: DataFrame) -> DataFrame:
    """The blendshape signals that detectors read, as columns in [0, 1]; a missing shape counts as 0.
    au04 is the column au04_proxy, or where there is none the mean that it stands for."""
    shape = lambda k: F.coalesce(F.col("blendshapes")[k], F.lit(0.0))
    mean = lambda k: clip01((shape(f"{k}Left") + shape(f"{k}Right")) / 2)
    au04 = F.col("au04_proxy") if "au04_proxy" in faces.columns else au04_proxy("blendshapes")
    return faces.withColumns({"smile": mean("mouthSmile"), "jaw_open": clip01(shape("jawOpen")), "eye_wide": mean("eyeWide"), "brow_inner_up": clip01(shape("browInnerUp")), "mouth_frown": mean("mouthFrown"), "brow_down": mean("browDown"), "au04": clip01(F.coalesce(au04, F.lit(0.0)))})


def pose_angles(faces: DataFrame) -> DataFrame:
    """detected, pitch and yaw; a frame without an angle has 0, which counts as known if the frame is detected."""
    return faces.withColumns({"detected": F.coalesce("detected", F.lit(False)), **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("pitch", "yaw")}})


def face_stats(faces: DataFrame) -> DataFrame:
    """Per clip: frames, detected frames (or with landmarks), and their share."""
    seen = F.coalesce(F.col("detected"), F.lit(False)) | F.col("landmarks").isNotNull()
    out = faces.groupBy("clip_key").agg(F.count(F.lit(1)).alias("total"), F.count_if(seen).alias("n_detected"))
    return out.withColumn("detection_rate", F.col("n_detected") / F.col("total"))


def data_rows(rows: DataFrame, columns: list[str], listing: DataFrame | None = None) -> DataFrame:
    """path and rows: the rows of each table in which any cell isn't blank; 0 for tables of the listing without any."""
    some = F.lit(False)
    for c in columns:
        some = some | F.coalesce(F.trim(c) != "", F.lit(False))
    counts = rows.groupBy("path").agg(F.count_if(some).alias("rows"))
    return counts if listing is None else listing.select("path").distinct().join(counts, "path", "left").na.fill(0, ["rows"])


def frame_keys(frames: DataFrame, values: str = "values") -> DataFrame:
    """Per clip the sorted names that any frame's map has."""
    names = frames.select("clip_key", F.explode(F.map_keys(values)).alias("name"))
    return names.groupBy("clip_key").agg(F.array_sort(F.collect_set("name")).alias("names"))


def frames_at(frames: DataFrame, places: list[int]) -> DataFrame:
    """The frames of each clip at some places, which count from its end if they are negative, each with its place;
    frame_index is null where the clip has none there."""
    counts = frames.groupBy("clip_key").agg(F.count(F.lit(1)).alias("_n"))
    asked = counts.select("clip_key", "_n", F.explode(F.array(*map(F.lit, places))).alias("place"))
    at = F.when(F.col("place") < 0, F.col("_n") + F.col("place")).otherwise(F.col("place"))
    asked = asked.select("clip_key", "place", F.when((at >= 0) & (at < F.col("_n")), at).alias("frame_index"))
    return asked.join(frames, ["clip_key", "frame_index"], "left")


def top_shapes(shapes: str, k: int = 5) -> Column:
    """The k strongest entries of a map, as (name, score); equal ones in the order of the map."""
    entries = F.transform(F.map_entries(shapes), lambda e, i: F.struct((-e["value"]).alias("less"), i.alias("i"), e["key"].alias("name"), e["value"].alias("score")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["name"].alias("name"), e["score"].alias("score")))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has the columns; else an error that names those missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def legacy_tables(predictions: DataFrame, general: list[str], points: list[str], how: str = "any") -> tuple[DataFrame, DataFrame]:
    """The two tables of a video's predictions: blank text is null, rows in which any (or all) of the
    general columns are null go, and each table has its own columns."""
    require_columns(predictions, general + points)
    text = {c for c, kind in predictions.dtypes if kind == "string"}
    blank = predictions.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in predictions.columns if c in text})
    held = blank.dropna(how=how, subset=general)
    keys = [c for c in ("clip_key", "frame_index") if c in predictions.columns and c not in general + points]
    return held.select(*keys, *general), held.select(*keys, *points)

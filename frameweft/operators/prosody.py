"""Timed events in text: cleaning, conversion to frames and expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EVENT_LINE, LINE_END, SIGNED_EVENT_LINE, two_decimals


def _events(text: str, pattern: str) -> Column:
    """The lines of a text that aren't blank: line_no, line, and start_s, end_s, score where the line fits the pattern."""
    part = lambda line, i: F.nullif(F.regexp_extract(line, pattern, i), F.lit("")).try_cast("double")

    def parsed(line: Column, i: Column) -> Column:
        return F.struct(i.alias("line_no"), line.alias("line"), part(line, 1).alias("start_s"), part(line, 2).alias("end_s"), part(line, 3).alias("score"))

    lines = F.transform(F.split(text, LINE_END), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(F.transform(lines, parsed), lambda e: e["line"] != "")


def event_lines(texts: DataFrame, pattern: str, key: list[str], text: str = "text") -> DataFrame:
    """A row per line that isn't blank: key, line_no, line, and start, end, score where it fits the pattern."""
    return texts.select(*key, F.explode(_events(text, pattern)).alias("e")).select(*key, "e.*")


def _holds(e: Column, longest: float, least: float) -> Column:
    return (e["end_s"] > e["start_s"]) & (e["start_s"] >= 0) & (e["end_s"] <= longest + 1e-6) & (e["score"] >= least)


def clean(texts: DataFrame, key: list[str], longest: float, least: float = 0.5, text: str = "text") -> DataFrame:
    """The events of model output that hold: in order, within the chunk, and sure enough; scores are limited to 1."""
    held = F.filter(_events(text, EVENT_LINE), lambda e: _holds(e, longest, least))
    rows = texts.select(*key, F.explode(held).alias("e"))
    return rows.select(*key, "e.line_no", "e.start_s", "e.end_s", F.least("e.score", F.lit(1.0)).alias("score"))


def cleaned_text(text: str, longest: float, least: float = 0.5) -> Column:
    """Model output as it is kept: a line of two-decimal start, end and score for each event that holds, or NULL."""
    held = F.filter(_events(text, EVENT_LINE), lambda e: _holds(e, longest, least))
    lines = F.transform(held, lambda e: F.concat_ws(", ", two_decimals(e["start_s"]), two_decimals(e["end_s"]), two_decimals(F.least(e["score"], F.lit(1.0)))))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("NULL")


def first_frame(seconds: Column, fps: float) -> Column:
    return F.floor(seconds * F.lit(float(fps))).cast("int")


def last_frame(seconds: Column, fps: float) -> Column:
    return (F.ceil(seconds * F.lit(float(fps))) - 1).cast("int")


def _spans(text: str, fps: float, size: int) -> Column:
    """The segments of a text that reach into its frames, in the order of their lines: a, b (inclusive) and score."""
    place = lambda e: F.struct(F.greatest(F.lit(0), first_frame(e["start_s"], fps)).alias("a"), F.least(F.lit(size - 1), last_frame(e["end_s"], fps)).alias("b"), e["score"].alias("score"))
    forward = F.filter(_events(text, SIGNED_EVENT_LINE), lambda e: e["end_s"] > e["start_s"])
    return F.filter(F.transform(forward, place), lambda s: s["a"] <= s["b"])


def expand(texts: DataFrame, key: list[str], fps: float, size: int, text: str = "text") -> DataFrame:
    """Each row's size frames, with the score of the last line that covers a frame, else 0.

    A row holds all lines of its chunk, so frames are filled within the row and nothing is shuffled.
    """
    spans = texts.select(*key, _spans(text, fps, size).alias("spans"))

    def fill(i: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter("spans", lambda s: (s["a"] <= i) & (i <= s["b"])), F.lit(-1))["score"], F.lit(0.0))

    return spans.select(*key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), fill)).alias("frame_index", "intensity_score"))


def line_counts(texts: DataFrame, key: list[str], fps: float = 25, size: int = 60, text: str = "text") -> DataFrame:
    """Per row: segments that reach into its frames (n_valid), lines in no form or out of order (n_errors), and
    whether it is null: no such segment, and a line that says NULL. A segment beside the frames is neither."""
    events = texts.select(*key, _events(text, SIGNED_EVENT_LINE).alias("events"), _spans(text, fps, size).alias("spans"))
    null = lambda e: F.upper(e["line"]) == "NULL"
    good = lambda e: F.coalesce(e["end_s"] > e["start_s"], F.lit(False))
    n_valid, n_errors = F.size("spans").cast("long"), F.size(F.filter("events", lambda e: ~good(e) & ~null(e))).cast("long")
    return events.select(*key, n_valid.alias("n_valid"), n_errors.alias("n_errors"), ((n_valid == 0) & F.exists("events", null)).alias("is_null"))


def converted_vector(rows: DataFrame, size: int, value: str = "intensity_score") -> DataFrame:
    """A converted table's rows of text (clip_key, chunk_name, line_no, frame_index, value) as one array of size values
    per chunk: later lines win, other frames are 0, and an index or value that isn't a number is an error."""
    strict = lambda c: F.when(F.col(c).try_cast("double").isNull(), F.raise_error(F.concat(F.lit(f"{c} isn't a number: "), F.coalesce(c, F.lit("null"))))).otherwise(F.col(c).try_cast("double"))
    typed = rows.select("clip_key", "chunk_name", "line_no", strict("frame_index").cast("int").alias("i"), strict(value).alias("v"))
    last = typed.groupBy("clip_key", "chunk_name", "i").agg(F.max_by("v", "line_no").alias("v"))
    known = last.groupBy("clip_key", "chunk_name").agg(F.map_from_entries(F.collect_list(F.when(F.col("i").between(0, size - 1), F.struct("i", "v")))).alias("m"))
    return known.select("clip_key", "chunk_name", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias(value))

"""The supplied tables in the shape of frame tables, for queries and benchmarks.

A clip is a user of events, a frame the position of an event by time; detected
is every event but an error; the second axis is k of props.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip_key"),
        (F.row_number().over(order) - 1).cast("long").alias("frame_index"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        "value",
        "event_type",
        (F.col("event_type") != "error").alias("detected"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def nods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames, with a head that nods for 24 of 40 frames, by as much as the event's value says, and that
    turns as k in one clip of four."""
    e = frames(spark, sf_dir)
    wave = F.array(*map(F.lit, WAVE))[(F.col("frame_index") % 4).cast("int")]
    swing = F.when(F.col("frame_index") % 40 < 24, 10 + F.floor(F.col("cents") / 10000)).otherwise(F.lit(1)).cast("double")
    yaw = F.when(F.col("clip_key") % 4 == 0, F.col("k")).otherwise(0.0)
    return e.select("clip_key", "frame_index", (wave * swing).alias("pitch"), yaw.alias("yaw"), ((F.col("event_type") != "error") | (F.col("k") < 80)).alias("detected"))


#: A period of the nod.
WAVE = (0.0, 1.0, 0.0, -1.0)

#: The same in DuckDB SQL, as the beginning of a WITH list.
FRAMES_SQL = """ev as (
    select user_id as clip_key, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_index,
           cast(round(value * 100) as bigint) as cents, value, event_type, event_type <> 'error' as detected,
           cast(regexp_extract(props, '"k": ?(-?[0-9.]+)', 1) as double) as k,
           count(*) over (partition by user_id) as n
    from events)"""

NODS_SQL = f"""{FRAMES_SQL.replace("ev as", "e0 as", 1)}, ev as (
    select clip_key, frame_index, n, [0.0, 1.0, 0.0, -1.0][1 + frame_index % 4]::double * case when frame_index % 40 < 24 then 10 + cents // 10000 else 1 end as pitch,
           case when clip_key % 4 = 0 then k else 0.0 end as yaw, event_type <> 'error' or k < 80 as detected from e0)"""


def sum_sql(x: str, window: int) -> str:
    """A centred moving sum with the ends repeated; rows need clip_key, frame_index and n."""
    if window <= 1:
        return x
    half = (window + 1 if window % 2 == 0 else window) // 2
    whole = "partition by clip_key order by frame_index rows between unbounded preceding and unbounded following"
    return f"(sum({x}) over (partition by clip_key order by frame_index rows between {half} preceding and {half} following) + greatest(0, {half} - frame_index) * first_value({x}) over ({whole}) + greatest(0, {half} - (n - 1 - frame_index)) * last_value({x}) over ({whole}))"


def average_sql(x: str, window: int) -> str:
    return f"({sum_sql(x, window)} / {float(window + 1 if window % 2 == 0 else window)})" if window > 1 else x


def gate_sql(source: str, x: str, on: float, off: float, least: int, name: str) -> str:
    """CTEs that add event_id and gate to source, the last one called name."""
    return f"""{name}_i as (select *, sum(case when {x} < {off} then 1 else 0 end) over (partition by clip_key order by frame_index) as event_id from {source}),
    {name}_o as (select *, case when {x} >= {off} and max(case when {x} >= {on} then 1 else 0 end) over (partition by clip_key, event_id order by frame_index) = 1 then 1 else 0 end as opened from {name}_i),
    {name} as (select *, opened = 1 and sum(opened) over (partition by clip_key, event_id) >= {least} as gate from {name}_o)"""

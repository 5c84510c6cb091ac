"""One query per operator on the supplied tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar, sequence
from ..operators import audio, combine, detectors, inference, manifest, prosody
from ..sources import readers, sinks
from .adapters import FRAMES_SQL, NODS_SQL, average_sql, frames, gate_sql, nods, sum_sql, table
from .registry import ORACLES, QUERIES, query

_OVER = "over (partition by clip_key order by frame_index)"
_GATED = f"with {FRAMES_SQL}, sm as (select *, {sum_sql('cents', 7)} as s from ev), {gate_sql('sm', 's', 45000, 35000, 6, 'g')}"


@query(f"""{_GATED}, runs as (select clip_key, event_id, count(*) as n, max(s) as peak from g where gate group by all)
    select c.clip_key, c.n_frames::bigint as n_frames, coalesce(r.n_events, 0)::bigint as n_events, coalesce(r.longest, 0)::bigint as longest_event, coalesce(r.active, 0)::bigint as active_frames, coalesce(r.peak, 0)::bigint as peak
    from (select clip_key, count(*) as n_frames from g group by 1) c
    left join (select clip_key, count(*) as n_events, max(n) as longest, sum(n) as active, max(peak) as peak from runs group by 1) r using (clip_key)""")
def reaction_event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: smoothing, gate and a summary of the events of each clip, in whole cents."""
    df = frames(spark, sf_dir).select("clip_key", "frame_index", "cents").withColumn("s", sequence.moving_sum(F.col("cents"), 7))
    df = sequence.with_gate(df, "s", 45000, 35000, 6)
    runs = df.groupBy("clip_key", "event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("gate").alias("active"), F.max(F.when(F.col("gate"), F.col("s"))).alias("peak"))
    return runs.groupBy("clip_key").agg(F.sum("n").alias("n_frames"), F.count_if(F.col("active") > 0).alias("n_events"), F.max("active").alias("longest_event"), F.sum("active").alias("active_frames"), F.coalesce(F.max("peak"), F.lit(0)).alias("peak"))


@query(f"{_GATED} select clip_key, frame_index, s::bigint as window_sum, gate from g")
def smoothed_gate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames(spark, sf_dir).select("clip_key", "frame_index", "cents").withColumn("s", sequence.moving_sum(F.col("cents"), 7))
    return sequence.with_gate(df, "s", 45000, 35000, 6).select("clip_key", "frame_index", F.col("s").alias("window_sum"), "gate")


@query(f"with {FRAMES_SQL} select clip_key, frame_index, round({average_sql('value', 8)}, 6) as even_window, round({average_sql('value', 151)}, 6) as long_window from ev")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames(spark, sf_dir)
    return df.select("clip_key", "frame_index", *(F.round(sequence.moving_average(F.col("value"), w), 6).alias(n) for w, n in ((8, "even_window"), (151, "long_window"))))


def _fill_sql(x: str) -> str:
    back, forth = "rows between unbounded preceding and current row", "rows between current row and unbounded following"
    part = lambda f, v, r: f"{f}(case when detected then {v} end ignore nulls) over (partition by clip_key order by frame_index {r})"
    lo, hi, i, j = part("last_value", x, back), part("first_value", x, forth), part("last_value", "frame_index", back), part("first_value", "frame_index", forth)
    return f"coalesce(case when {j} > {i} then {lo} + ({hi} - {lo}) * (frame_index - {i})::double / ({j} - {i}) else {lo} end, {lo}, {hi}, 0.0)"


@query(f"with {FRAMES_SQL} select clip_key, frame_index, round({_fill_sql('value')}, 6) as filled from ev")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("clip_key", "frame_index", F.round(sequence.fill_gaps(F.col("value"), F.col("detected")), 6).alias("filled"))


def _norm_sql(x: str) -> str:
    return f"least(abs({x}) / greatest(quantile_cont(abs({x}), 0.95) over (partition by clip_key), 1e-6), 1.0)"


@query(f"with {FRAMES_SQL} select clip_key, frame_index, round({_norm_sql('value')}, 6) as norm from ev")
def robust_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("clip_key", "frame_index", F.round(sequence.robust_norm(F.col("value")), 6).alias("norm"))


def _diff_sql(x: str) -> str:
    return f"({x} - coalesce(lag({x}) {_OVER}, {x}))"


@query(f"with {FRAMES_SQL}, d as (select *, {_diff_sql('cents')} as d1 from ev) select clip_key, frame_index, d1, {_diff_sql('d1')} as d2, round(value - {average_sql('value', 31)}, 6) as detrended from d")
def difference_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames(spark, sf_dir).withColumn("d1", sequence.difference(F.col("cents")))
    return df.select("clip_key", "frame_index", "d1", sequence.difference(F.col("d1")).alias("d2"), F.round(F.col("value") - sequence.moving_average(F.col("value"), 31), 6).alias("detrended"))


def _turns_sql(source: str, x: str, group: str, name: str) -> str:
    order = f"partition by {group} order by frame_index"
    return f"""{name}_s as (select *, sign({x} - lag({x}) over ({order})) as step from {source}),
    {name}_p as (select *, last_value(nullif(step, 0) ignore nulls) over ({order} rows between unbounded preceding and 1 preceding) as earlier from {name}_s),
    {name} as (select *, sum(case when step * earlier < 0 then 1 else 0 end) over (partition by {group}) as turns from {name}_p)"""


@query(f"{_GATED}, {_turns_sql('g', 'cents', 'clip_key, event_id, gate', 't')} select clip_key, min(frame_index)::bigint as start, count(*)::bigint as n_frames, max(turns)::bigint as turns, (max(turns) // 2)::bigint as cycles, max(turns) >= 3 as enough from t where gate group by clip_key, event_id")
def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames(spark, sf_dir).select("clip_key", "frame_index", "cents").withColumn("s", sequence.moving_sum(F.col("cents"), 7))
    df = sequence.with_turns(sequence.with_gate(df, "s", 45000, 35000, 6), "cents", ["clip_key", "event_id", "gate"]).where("gate")
    out = df.groupBy("clip_key", "event_id").agg(F.min("frame_index").alias("start"), F.count(F.lit(1)).alias("n_frames"), F.max("turns").alias("turns"))
    return out.select("clip_key", "start", "n_frames", "turns", F.floor(F.col("turns") / 2).alias("cycles"), (F.col("turns") >= 3).alias("enough"))


@query(f"""with {FRAMES_SQL}, a as (select *, cents >= 3000 as act, row_number() {_OVER} - row_number() over (partition by clip_key, cents >= 3000 order by frame_index) as r from ev),
    runs as (select clip_key, act, r, count(*) as n from a group by all)
    select ev.clip_key, max(cents) as peak, (select coalesce(max(n), 0) from runs where runs.clip_key = ev.clip_key and act)::bigint as longest_run, round(avg(case when cents >= 3000 then 1.0 else 0.0 end), 6) as active_ratio from ev group by ev.clip_key""")
def candidate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames(spark, sf_dir).select("clip_key", "frame_index", "cents")
    active = F.col("cents") >= 3000
    stats = df.groupBy("clip_key").agg(F.max("cents").alias("peak"), F.round(F.avg(active.cast("double")), 6).alias("active_ratio"))
    return stats.join(sequence.longest_run(df, active), "clip_key")


@query(f"with {FRAMES_SQL}, d as (select *, abs({_diff_sql('k / 100')}) as m from ev) select clip_key, frame_index, round(least(1.0, greatest(0.0, 4 * {average_sql('m', 5)})), 6) as jaw_motion from d")
def jaw_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    jaw = F.col("k") / 100
    df = frames(spark, sf_dir).withColumn("m", F.abs(sequence.difference(jaw)))
    return df.select("clip_key", "frame_index", F.round(sequence.clip01(4 * sequence.moving_average(F.col("m"), 5)), 6).alias("jaw_motion"))


_CHANNELS = f"{FRAMES_SQL}, ch as (select *, least(1.0, value / 100) as e, k / 100 as b, case when event_type in ('click', 'view') then 1.0 else 0.3 end as c from ev)"


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = frames(spark, sf_dir).withColumns({"b": F.col("k") / 100, "c": F.when(F.col("event_type").isin("click", "view"), 1.0).otherwise(0.3)})
    return faces.withColumn("e", F.least(F.lit(1.0), F.col("value") / 100))


def _expression_sql(raw: str, gate: detectors.Gate, extra: str = "") -> str:
    return f"""with {_CHANNELS}{extra}, r as (select *, least(1.0, greatest(0.0, ({raw}) * case when detected then 1.0 else 0.0 end)) as raw from ch{'2' if extra else ''}),
    m as (select *, round({average_sql('raw', gate.smooth)}, 6) as s from r), {gate_sql('m', 's', gate.on, gate.off, gate.least, 'g')}
    select clip_key, frame_index, case when gate then s else 0.0 end as intensity from g"""


@query(_expression_sql("0.65 * e + 0.35 * b", detectors.SMILING))
def detector_smiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _channels(spark, sf_dir)
    joined = detectors.join_emotions(df.drop("e"), df, "e")
    return detectors.expression_intensity(joined, detectors.smiling_raw(F.col("e"), F.col("b")), detectors.SMILING).select("clip_key", "frame_index", "intensity")


@query(_expression_sql("0.80 * (0.50 * e + 0.25 * c + 0.25 * b) + 0.20 * jm", detectors.LAUGHING, f", ch1 as (select *, abs({_diff_sql('b')}) as m0 from ch), ch2 as (select *, least(1.0, greatest(0.0, 4 * {average_sql('m0', 5)})) as jm from ch1)"))
def detector_laughing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detectors.with_jaw_motion(_channels(spark, sf_dir), "b")
    raw = detectors.laughing_raw(F.col("e"), F.col("c"), F.col("b"), F.col("jaw_motion"))
    return detectors.expression_intensity(df, raw, detectors.LAUGHING).select("clip_key", "frame_index", "intensity")


@query(_expression_sql("0.7 * (0.6 * e + 0.4 * c) + 0.7 * (0.8 * (b / 4 + c / 4 + b / 8))", detectors.FROWNING))
def detector_frowning(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, b, c = F.col("e"), F.col("b"), F.col("c")
    raw = detectors.frowning_raw(e, c, b / 4, c / 4, b / 8)
    return detectors.expression_intensity(_channels(spark, sf_dir), raw, detectors.FROWNING).select("clip_key", "frame_index", "intensity")


@query(_expression_sql("0.7 * e + 0.7 * (b / 3 + c / 3 + b / 6)", detectors.SURPRISED))
def detector_surprised(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, b, c = F.col("e"), F.col("b"), F.col("c")
    raw = detectors.surprised_raw(e, b / 3, c / 3, b / 6)
    return detectors.expression_intensity(_channels(spark, sf_dir), raw, detectors.SURPRISED).select("clip_key", "frame_index", "intensity")


def _motion_sql(axis: str, other: str, s: detectors.Motion, source: str = FRAMES_SQL) -> str:
    a, v, c = s.weights
    inside = "partition by clip_key, event_id, gate"
    return f"""with {source}, f as (select *, {_fill_sql(axis)} as p0, {_fill_sql(other)} as q0 from ev),
    b as (select *, round(p0 - {average_sql('p0', s.baseline)}, 6) as p, round(q0 - {average_sql('q0', s.baseline)}, 6) as q from f),
    d as (select *, {_diff_sql('p')} as v, {_diff_sql('q')} as w from b), a as (select *, {_diff_sql('v')} as acc from d),
    r as (select *, least(1.0, greatest(0.0, {a} * {_norm_sql('p')} + {v} * {_norm_sql('v')} + {c} * {_norm_sql('acc')} - {s.penalty} * {_norm_sql('w')})) * case when detected then 1.0 else 0.0 end as raw from a),
    m as (select *, round({average_sql('raw', s.gate.smooth)}, 6) as s from r), {gate_sql('m', 's', s.gate.on, s.gate.off, s.gate.least, 'g')}, {_turns_sql('g', 'p', 'clip_key, event_id, gate', 't')},
    e as (select *, round(max(p) over ({inside}) - min(p) over ({inside}), 6) as span, round(max(abs(v)) over ({inside}), 6) as speed from t)
    select clip_key, frame_index, case when gate and turns >= {s.turns} and turns // 2 >= {s.cycles} and span >= {s.span} and speed >= {s.speed} then least(1.0, s) else 0.0 end as intensity from e"""


def _motion(df: DataFrame, axis: str, other: str, spec: detectors.Motion) -> DataFrame:
    return detectors.motion_intensity(df, axis, other, spec).select("clip_key", "frame_index", "intensity")


@query(_motion_sql("pitch", "yaw", detectors.NODDING_V1, NODS_SQL))
def detector_nodding_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motion(nods(spark, sf_dir), "pitch", "yaw", detectors.NODDING_V1)


@query(_motion_sql("pitch", "yaw", detectors.NODDING, NODS_SQL))
def detector_nodding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motion(nods(spark, sf_dir), "pitch", "yaw", detectors.NODDING)


@query(_motion_sql("k", "value", detectors.HEAD_SHAKING))
def detector_head_shaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motion(frames(spark, sf_dir), "k", "value", detectors.HEAD_SHAKING)


_KINDS = ("click", "error", "purchase", "signup", "view")
_REACTIONS = f"{FRAMES_SQL}, re as (select clip_key, event_type as reaction, frame_index // 2 as frame_index, cents, frame_index as line_no from ev)"
_WIDE = ", ".join(f"coalesce(max(case when reaction = '{k}' then v end), 0) as {k}_0" for k in _KINDS)
_TOP = "greatest(" + ", ".join(f"{k}_0" for k in _KINDS) + ")"
_PICK = ", ".join("(case when " + " and ".join([f"{k}_0 = {_TOP}", f"{k}_0 > 0", *(f"{p}_0 < {k}_0" for p in _KINDS[:i])]) + f" then {k}_0 else 0 end)::double as {k}" for i, k in enumerate(_KINDS))


def _reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("clip_key", F.col("event_type").alias("reaction"), F.floor(F.col("frame_index") / 2).alias("frame_index"), F.col("cents").cast("double").alias("intensity"), F.col("frame_index").alias("line_no"))


@query(f"""with {_REACTIONS}, l as (select clip_key, reaction, frame_index, max_by(cents, line_no) as v from re group by all),
    w as (select clip_key, frame_index, {_WIDE} from l where clip_key in (select clip_key from re group by 1 having count(distinct reaction) = {len(_KINDS)}) group by 1, 2)
    select clip_key, frame_index, {_PICK} from w""")
def combine_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.combine(_reactions(spark, sf_dir), _KINDS)


@query("""with r as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as p, count(*) over (partition by l_orderkey) as n, cast(l_quantity as bigint) as q from lineitem),
    c as (select l_orderkey as clip_key, (p // 2)::int as chunk_idx, list(q order by p) as data from r where p // 2 < n // 2 group by 1, 2)
    select c.clip_key, chunk_idx, printf('chunk_%03d', chunk_idx) as chunk_name, data[1]::bigint as first_value, data[2]::bigint as second_value
    from c join (select o_orderkey, 1 + o_orderkey % 2 as anchors from orders where o_orderstatus <> 'P') a on a.o_orderkey = c.clip_key where chunk_idx < anchors""")
def chunk_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two rows by position, as many per clip as the anchor has."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_key"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("l_quantity").cast("long").alias("q"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    anchor = orders.select(F.col("o_orderkey").alias("clip_key"), F.explode(F.sequence(F.lit(0), F.col("o_orderkey") % 2)).alias("i"))
    chunks = combine.align(combine.chunk(rows, 2, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ["q"]), anchor)
    return chunks.select("clip_key", "chunk_idx", "chunk_name", F.col("data")[0][0].alias("first_value"), F.col("data")[1][0].alias("second_value"))


@query("""with others as (select l_orderkey as clip_key, case when l_linenumber % 4 = 3 then 'meta' else printf('chunk_%03d', l_linenumber::int) end as chunk_name, count(*) as n from lineitem group by 1, 2),
    kept as (select distinct o_orderkey as clip_key, printf('chunk_%03d', (o_custkey % 5)::int) as chunk_name from orders where o_orderstatus = 'F'),
    held as (select o.* from others o join kept k using (clip_key, chunk_name))
    select clip_key, chunk_name, n::bigint as n from held union all select clip_key, chunk_name, n::bigint from others where chunk_name = 'meta' and clip_key in (select clip_key from held)""")
def prune_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_linenumber") % 4 == 3, "meta").otherwise(F.format_string("chunk_%03d", F.col("l_linenumber").cast("int")))
    others = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_key"), name.alias("chunk_name")).groupBy("clip_key", "chunk_name").agg(F.count(F.lit(1)).alias("n"))
    kept = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("clip_key"), F.format_string("chunk_%03d", (F.col("o_custkey") % 5).cast("int")).alias("chunk_name"))
    return combine.prune(others, kept)


@query("""with h as (select event_id, cast(cast((value - 200) * (case when event_type = 'error' then 400.0 else 0.002 end) as float) as double) as x from events), u as (select *, pow(2.0, greatest(floor(log2(nullif(abs(x), 0))), -14) - 10) as u from h)
    select event_id, case when x = 0 then 0.0 when abs(x) >= 65520 then sign(x) * 'infinity'::double else round_even(x / u, 0) * u end as half from u""")
def half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("value") - 200) * F.when(F.col("event_type") == "error", 400.0).otherwise(0.002)
    return table(spark, sf_dir, "events").select("event_id", scalar.half_precision(x).alias("half"))


@query("""with w as (select vec_id, list_transform(embedding, lambda v: v::double) as x from embeddings),
    r as (select *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x) + 1e-12) as level from w),
    g as (select *, pow(10.0, -20 / 20.0) / level as gain, list_max(list_transform(x, lambda v: abs(v))) as top from r)
    select vec_id, round(level, 6) as rms, case when level < 0.125 then 'NULL' else 'infer' end as action, round(x[1] * gain * case when top * gain > 0.2 then 0.2 / (top * gain) else 1.0 end, 6) as first_sample, (len(x) // 20)::int as n_chunks, round(x[21], 6) as second_chunk_start from g""")
def waveform_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square, the gate on it, loudness with a peak limit, and full chunks."""
    df = table(spark, sf_dir, "embeddings").withColumn("chunks", audio.full_chunks(F.col("embedding"), 20)).withColumn("level", audio.rms(F.col("embedding")))
    loud = audio.loudness_normalised(F.col("embedding"), -20.0, 0.2)
    return df.select("vec_id", F.round("level", 6).alias("rms"), F.when(F.col("level") < 0.125, "NULL").otherwise("infer").alias("action"), F.round(loud[0], 6).alias("first_sample"), F.size("chunks").alias("n_chunks"), F.round(F.col("chunks")[1][0].cast("double"), 6).alias("second_chunk_start"))


_TEXTS = """tx as (select user_id as clip_key, event_id as chunk,
    case event_type when 'view' then 'NULL' || case when c % 3 = 0 then chr(10) || 'noise' else '' end
         when 'signup' then case when c % 2 = 0 then '  ' else '-0.' || printf('%02d', (c % 90)::int) || ', 0.40, 0.9' end
         else printf('%d.%02d, %d.%03d, %d.%02d', (a // 100)::int, (a % 100)::int, (b // 1000)::int, (b % 1000)::int, (s // 100)::int, (s % 100)::int) || chr(10) || printf('0.%02d, 1.%02d, -0.%02d', (a % 90)::int, (b % 90)::int, (s % 97)::int)
              || case when event_type = 'error' then chr(10) || 'noise' || chr(10) || 'Null' when event_type = 'click' then chr(10) || ' 0.125, 0.375 ,0.625 ' || chr(10) || '5.0, 6.0, 0.7' else '' end end as text
    from (select *, c % 250 as a, c % 2600 as b, c % 150 as s from (select user_id, event_id, event_type, cast(round(value * 100) as bigint) as c from events)))"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, kind = F.col("c"), F.col("event_type")
    a, b, s = c % 250, c % 2600, c % 150
    parts = lambda v, n: (F.floor(v / n), v % n)
    lines = F.concat(F.format_string("%d.%02d, %d.%03d, %d.%02d", *parts(a, 100), *parts(b, 1000), *parts(s, 100)), F.lit("\n"), F.format_string("0.%02d, 1.%02d, -0.%02d", a % 90, b % 90, s % 97))
    lines = F.concat(lines, F.when(kind == "error", "\nnoise\nNull").when(kind == "click", "\n 0.125, 0.375 ,0.625 \n5.0, 6.0, 0.7").otherwise(""))
    null = F.concat(F.lit("NULL"), F.when(c % 3 == 0, "\nnoise").otherwise(""))
    early = F.when(c % 2 == 0, "  ").otherwise(F.format_string("-0.%02d, 0.40, 0.9", c % 90))
    rows = table(spark, sf_dir, "events").withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return rows.select(F.col("user_id").alias("clip_key"), F.col("event_id").alias("chunk"), F.when(kind == "view", null).when(kind == "signup", early).otherwise(lines).alias("text"))


def _lines_sql(sign: str) -> str:
    part = lambda i: f"try_cast(nullif(regexp_extract(line, '^\\s*(-?\\d+(?:\\.\\d+)?)\\s*,\\s*(-?\\d+(?:\\.\\d+)?)\\s*,\\s*({sign}\\d+(?:\\.\\d+)?)\\s*$', {i}), '') as double)"
    return f"""{_TEXTS}, ln as (select clip_key, chunk, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from tx),
    pl as (select *, {part(1)} as a, {part(2)} as b, {part(3)} as s from ln)"""


_HELD = "b > a and a >= 0 and b <= 2.4 + 1e-6 and s >= 0.5"


@query(f"with {_lines_sql('')} select clip_key, chunk, line_no::int as line_no, a as start_s, b as end_s, least(s, 1.0) as score from pl where {_HELD}")
def prosody_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prosody.clean(_texts(spark, sf_dir), ["clip_key", "chunk"], 2.4)


@query(f"""with {_lines_sql('')}, k as (select clip_key, chunk, string_agg(printf('%.2f, %.2f, %.2f', a, b, least(s, 1.0)), chr(10) order by line_no) as t from pl where {_HELD} group by 1, 2)
    select clip_key, chunk, coalesce(t, 'NULL') as kept_text from tx left join k using (clip_key, chunk)""")
def prosody_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("clip_key", "chunk", prosody.cleaned_text("text", 2.4).alias("kept_text"))


_SPANS = "sp as (select clip_key, chunk, line_no, s, greatest(0, floor(a * 25.0::double))::bigint as f, least(59, ceil(b * 25.0::double) - 1)::bigint as t from pl where b > a)"


@query(f"""with {_lines_sql('-?')}, {_SPANS},
    cv as (select clip_key, chunk, line_no, s, unnest(range(f, t + 1)) as frame_index from sp where f <= t), la as (select clip_key, chunk, frame_index, max_by(s, line_no) as s from cv group by all),
    ev as (select clip_key, chunk, unnest(range(0, 60)) as frame_index from tx)
    select clip_key, chunk, frame_index::int as frame_index, coalesce(s, 0.0) as intensity_score from ev left join la using (clip_key, chunk, frame_index)""")
def prosody_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prosody.expand(_texts(spark, sf_dir), ["clip_key", "chunk"], 25, 60)


@query(f"""with {_lines_sql('-?')}, {_SPANS}, v as (select clip_key, chunk, count(*) as n from sp where f <= t group by 1, 2),
    c as (select clip_key, chunk, count(*) filter (where trim(line) <> '' and not coalesce(b > a, false) and upper(trim(line)) <> 'NULL') as n_errors, count(*) filter (where upper(trim(line)) = 'NULL') as nulls from pl group by 1, 2)
    select clip_key, chunk, coalesce(v.n, 0)::bigint as n_valid, n_errors, coalesce(v.n, 0) = 0 and nulls > 0 as is_null, not contains(text, 'NULL') as non_null from tx join c using (clip_key, chunk) left join v using (clip_key, chunk)""")
def prosody_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir).withColumn("non_null", ~F.col("text").contains("NULL"))
    return prosody.line_counts(texts, ["clip_key", "chunk", "non_null"])


@query("""with l as (select c_custkey, ' ' || c_name || '.mp4 , emo/' || c_mktsegment || '.csv,' || case when c_custkey % 3 = 0 then '' else ' f/' || c_nationkey || '.pkl' || case when c_custkey % 5 = 0 then ',x' else '' end end || ' ' as value from customer)
    select c_custkey, trim(string_split(trim(value), ',')[1]) as video_path, trim(string_split(trim(value), ',')[2]) as fer_path, trim(string_split(trim(value), ',')[3]) as face_path from l where trim(value) <> '' and len(string_split(trim(value), ',')) = 3""")
def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(" f/"), F.col("c_nationkey").cast("string"), F.lit(".pkl"), F.when(F.col("c_custkey") % 5 == 0, ",x").otherwise("")))
    value = F.concat(F.lit(" "), "c_name", F.lit(".mp4 , emo/"), "c_mktsegment", F.lit(".csv,"), tail, F.lit(" "))
    return manifest.parse_manifest(table(spark, sf_dir, "customer").select("c_custkey", value.alias("value")))


_ROWS = """r as (select user_id as clip_key, event_id as line_no, cast(event_id % 40 as varchar) || case when event_id % 7 = 0 then '.9' when event_id % 11 = 0 then 'x' else '' end as f,
    case when event_id % 13 = 0 then 'bad' when event_id % 17 = 0 then '' else cast(cast(round(value * 100) as bigint) as varchar) || 'e-4' end as happy, case when event_type = 'error' then 'bad' else '-0.5' end as angry from events)"""


def _score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    index = F.concat((e % 40).cast("string"), F.when(e % 7 == 0, ".9").when(e % 11 == 0, "x").otherwise(""))
    happy = F.when(e % 13 == 0, "bad").when(e % 17 == 0, "").otherwise(F.concat(F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("e-4")))
    angry = F.when(F.col("event_type") == "error", "bad").otherwise("-0.5")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_key"), e.alias("line_no"), index.alias("frame_index"), happy.alias("happy"), angry.alias("angry"))


@query(f"with {_ROWS} select clip_key, cast(f as int) as frame_index, max_by(least(1.0, greatest(0.0, cast(coalesce(nullif(happy, ''), '0') as double))), line_no) as happy from r where f not like '%x' and f not like '%.%' and happy <> 'bad' group by 1, 2")
def emotion_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.emotion_scores(_score_rows(spark, sf_dir), ["happy"])


@query(f"with {_ROWS} select clip_key, cast(f as int) as frame_index, max_by(least(1.0, greatest(0.0, cast(coalesce(nullif(happy, ''), '0') as double))), line_no) as happy, 0.0::double as angry from r where f not like '%x' and f not like '%.%' and happy <> 'bad' and angry <> 'bad' group by 1, 2")
def emotion_pair_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row stays only if both of its scores are numbers."""
    return readers.emotion_scores(_score_rows(spark, sf_dir), ["happy", "angry"])


@query(f"with {_ROWS} select clip_key, cast(trunc(cast(f as double)) as int) as frame_index, max_by(cast(happy as double) - 1, line_no) as less from (select * from r where f not like '%x' and happy not in ('bad', '')) group by 1, 2")
def reaction_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes may be decimals, scores aren't limited, and an empty score is no number."""
    rows = _score_rows(spark, sf_dir).drop("angry")
    column = readers.score_column([c for c in rows.columns if c not in ("clip_key", "line_no")], "smiling_intensity")
    return readers.reaction_scores(rows, column).select("clip_key", "frame_index", (F.col(column) - 1).alias("less"))


@query("""with s as (select user_id as clip_key, cast(event_id % 90 as int) as frame_index, max(value / 500) as score from events group by all), l as (select clip_key, unnest(range(0, max(frame_index) + 1))::int as frame_index from s group by clip_key)
    select clip_key, frame_index, round(least(1.0, coalesce(score, 0.0)), 6) as score from l left join s using (clip_key, frame_index)""")
def densified_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip_key"), (F.col("event_id") % 90).cast("int").alias("frame_index")).agg(F.max(F.col("value") / 500).alias("score"))
    return readers.densified(s, "score").select("clip_key", "frame_index", F.round("score", 6).alias("score"))


@query("""with v as (select o_orderkey as key, 1 + o_custkey % 7 as frames from orders where o_orderstatus <> 'P'), t as (select l_orderkey as key, count(*) as rows from lineitem where l_quantity > 10 group by 1)
    select key, coalesce(frames, 0) as frames, coalesce(rows, 0) as rows, reason from (select key, frames, rows, case when rows is null then 'no_table' when frames is null then 'no_video' when rows <> frames then 'count_differs' end as reason from v full join t using (key)) where reason is not null""")
def incomplete_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"), (1 + F.col("o_custkey") % 7).alias("frames"))
    tables = table(spark, sf_dir, "lineitem").where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return manifest.incomplete(videos, tables, ["key"]).na.fill(0, ["frames", "rows"])


@query(f"""with {FRAMES_SQL}, st as (select clip_key, count(*) as total, count(*) filter (where detected or k > 60) as n_detected from ev group by 1) select clip_key, total, n_detected, round(n_detected / total, 6) as detection_rate, total = 66 as frame_count_match from st""")
def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = frames(spark, sf_dir).select("clip_key", "detected", F.when(F.col("k") > 60, F.array(F.lit(1.0))).alias("landmarks"))
    return readers.face_stats(faces).select("clip_key", "total", "n_detected", F.round("detection_rate", 6).alias("detection_rate"), (F.col("total") == 66).alias("frame_count_match"))


@query("""with r as (select d.doc_id, 1 - (d.doc_id % 3) * 2e-7 - case when d.doc_id % 10 = 0 then 0.1 else 0 end as detection_rate from documents d) select doc_id from r where round(detection_rate, 6) = 1.0 and doc_id not in (select doc_id from labels)""")
def usable_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = 1 - (F.col("doc_id") % 3) * 2e-7 - F.when(F.col("doc_id") % 10 == 0, 0.1).otherwise(0.0)
    report = table(spark, sf_dir, "documents").select("doc_id", rate.alias("detection_rate"))
    return manifest.usable(report, table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 25)")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


_NAMES = """ex as (select distinct 'v' || (c_custkey % 50) || '_' || c_nationkey || '_' || lpad(cast(c_custkey as varchar), 6, '0') || '.2' as full_name from customer),
    cu as (select distinct full_name, left(full_name, length(full_name) - (length(full_name) + ascii(right(full_name, 3))) % 6) as name from ex),
    fo as (select name from cu union select full_name from cu where ascii(right(full_name, 3)) % 5 = 0 union select 'x' || name from cu where ascii(right(full_name, 4)) % 7 = 0 union select replace(name, '_', '-') from cu)"""


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    full = c.select(F.concat(F.lit("v"), (F.col("c_custkey") % 50).cast("string"), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit("_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(".2")).alias("name")).distinct()
    n, last = F.char_length("name"), lambda k: F.ascii(F.right(F.col("name"), F.lit(k)))
    cut = full.select(F.col("name").alias("full"), F.substring(F.col("name"), F.lit(1), n - (n + last(3)) % 6).alias("name"))
    found = cut.select("name").unionByName(full.where(last(3) % 5 == 0)).unionByName(cut.where(F.ascii(F.right("full", F.lit(4))) % 7 == 0).select(F.concat(F.lit("x"), "name").alias("name"))).unionByName(cut.select(F.replace("name", F.lit("_"), F.lit("-")).alias("name")))
    return found.distinct(), full


@query(f"""with {_NAMES}, j as (select f.name, regexp_extract(f.name, '^(.+_)([^_]+)$', 1) as prefix, count(e.full_name) as known, count(*) filter (where e.full_name = f.name) as same, count(*) filter (where starts_with(e.full_name, f.name) and e.full_name <> f.name) as n, min(case when starts_with(e.full_name, f.name) and e.full_name <> f.name then e.full_name end) as t
    from fo f left join ex e on regexp_extract(e.full_name, '^(.+_)[^_]+$', 1) = nullif(regexp_extract(f.name, '^(.+_)[^_]+$', 1), '') group by 1, 2),
    o as (select name, t, case when name in (select full_name from ex) then 'already_complete' when prefix = '' then 'invalid_filename_pattern' when known = 0 then 'prefix_not_in_expected' when n > 1 then 'ambiguous_match' when n = 0 then 'not_truncated_or_no_match' when t in (select name from fo) then 'target_exists' else 'renamed' end as outcome from j)
    select name, outcome, case when outcome = 'renamed' then t end as target from o""")
def repaired_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.repaired_names(*_names(spark, sf_dir))


@query("""with p as (select page_id, '/data/Original/Original/' || replace(url, '://', '/') || '_a/emo_scores/' || page_id || '.part.mp4' as path from pages)
    select page_id, regexp_replace(substr(path, 7), '\\.[^./]*$', '') as key_inside, string_split(path, '/')[-2] || '_' || page_id || '.part' as key_outside, replace(path, '/emo_scores/', '/') as no_segment, regexp_replace(path, 'Original', 'Face') as face_path, string_split(path, '/')[-2] || '_' || page_id || '.part' as realtalk, page_id || '.part' as seamless, regexp_extract(url, '^(.*_)?', 1) is not null as ok from p join pages using (page_id)""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/Original/Original/"), F.replace("url", F.lit("://"), F.lit("/")), F.lit("_a/emo_scores/"), F.col("page_id").cast("string"), F.lit(".part.mp4"))
    p = F.col("path")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", scalar.output_key(p, "/data").alias("key_inside"), scalar.output_key(p, "/other").alias("key_outside"), scalar.drop_segment(p, "emo_scores").alias("no_segment"), scalar.replace_first(p, "Original", "Face").alias("face_path"), scalar.clip_key_of(p, F.lit("realtalk")).alias("realtalk"), scalar.clip_key_of(p, F.lit("seamless")).alias("seamless"), F.lit(True).alias("ok"))


@query("""with m as (select vec_id, embedding::double[] as m from embeddings), s as (select *, sqrt(m[1] * m[1] + m[4] * m[4]) as sy from m)
    select vec_id, round(degrees(case when sy < 1e-6 then atan2(-m[6], m[5]) else atan2(m[8], m[9]) end), 5) as pitch, round(degrees(case when sy < 1e-6 then 0.0 else atan2(m[4], m[1]) end), 5) as roll, round(degrees(atan2(-m[7], sy)), 5) as yaw from s""")
def pose_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    matrix = F.array(*(F.array(*(at(3 * r + c) for c in range(3))) for r in range(3)))
    angles = table(spark, sf_dir, "embeddings").withColumn("m", matrix).withColumn("a", scalar.euler_degrees("m"))
    return angles.select("vec_id", *(F.round(F.col("a")[k], 5).alias(k) for k in ("pitch", "roll", "yaw")))


@query("""with p as (select vec_id, list_transform(range(0, 32), lambda i: embedding[2 * i + 1]::double * 2 + 0.5) as xs, list_transform(range(0, 32), lambda i: embedding[2 * i + 2]::double * 2 + 0.5) as ys from embeddings),
    b as (select vec_id, greatest(0, least(1, list_min(xs))) as x0, greatest(0, least(1, list_min(ys))) as y0, greatest(0, least(1, list_max(xs))) as x1, greatest(0, least(1, list_max(ys))) as y1 from p where vec_id % 10 <> 0)
    select vec_id, round(x0, 6) as x0, round(y1, 6) as y1, round_even(x0 * 640, 0)::int as left_px, round_even(y0 * 480, 0)::int as top_px, round_even(x1 * 640, 0)::int as right_px, round_even(y1 * 480, 0)::int as bottom_px from embeddings left join b using (vec_id)""")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row in ten has no landmarks, and so no box."""
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(F.col("embedding")[2 * i].cast("double") * 2 + 0.5, F.col("embedding")[2 * i + 1].cast("double") * 2 + 0.5))
    box, px = scalar.bounding_box("points", 640, 480)
    df = table(spark, sf_dir, "embeddings").withColumn("points", F.when(F.col("vec_id") % 10 == 0, F.array().cast("array<array<double>>")).otherwise(points)).select("vec_id", box.alias("box"), px.alias("px"))
    return df.select("vec_id", F.round(F.col("box")[0], 6).alias("x0"), F.round(F.col("box")[3], 6).alias("y1"), *(F.col("px")[i].alias(n) for i, n in enumerate(("left_px", "top_px", "right_px", "bottom_px"))))


@query(f"""with {FRAMES_SQL}, r as (select clip_key, event_type, max(cents) as top from ev group by all) select * from r qualify row_number() over (partition by clip_key order by top desc, event_type) <= 3""")
def top_blendshapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest shapes of each clip, from a map of shapes."""
    shapes = frames(spark, sf_dir).groupBy("clip_key", "event_type").agg(F.max("cents").alias("top"))
    best = F.row_number().over(Window.partitionBy("clip_key").orderBy(F.desc("top"), "event_type"))
    return shapes.withColumn("_r", best).where("_r <= 3").drop("_r")


@query(f"""with {FRAMES_SQL}, s as (select clip_key, max(cents) as peak, round(avg(case when cents >= 3000 then 1.0 else 0.0 end), 6) as ratio from ev group by 1), c as (select * from s where peak >= 10000 and ratio >= 0.4)
    select * from (select * from c order by md5('7:' || clip_key), clip_key limit 20)""")
def sampled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frames(spark, sf_dir).groupBy("clip_key").agg(F.max("cents").alias("peak"), F.round(F.avg((F.col("cents") >= 3000).cast("double")), 6).alias("ratio"))
    return manifest.seeded_sample(s.where("peak >= 10000 and ratio >= 0.4"), "clip_key", 20, 7)


@query("select o_orderstatus as reaction, o_orderpriority as reason, count(*) as n from orders group by rollup (1, 2)")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.outcome_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("reaction"), F.col("o_orderpriority").alias("reason")), "reaction")


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' order by o_orderkey limit 10")
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy("o_orderkey").limit(10).select("o_orderkey", "o_orderpriority")


@query("with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as k from orders where o_orderstatus = 'O') select coalesce(a.k, b.k) as key, case when a.k is null then 'only_b' when b.k is null then 'only_a' else 'both' end as side from a full join b on a.k = b.k")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')").groupBy(F.col("o_custkey").alias("key")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderstatus") == "O").alias("b"))
    return keys.select("key", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").otherwise("only_b").alias("side"))


@query("""with r as (select c_custkey, case when c_custkey % 4 = 0 then '  ' else cast(c_nationkey as varchar) end as a, case when c_custkey % 6 = 0 then '' else c_mktsegment end as b from customer), n as (select c_custkey, nullif(trim(a), '') as a, nullif(trim(b), '') as b from r) select c_custkey, try_cast(a as int) as a, b from n where a is not null and b is not null""")
def legacy_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank text to null, rows with any null dropped, columns projected."""
    c = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select("c_custkey", F.when(c % 4 == 0, "  ").otherwise(F.col("c_nationkey").cast("string")).alias("a"), F.when(c % 6 == 0, "").otherwise(F.col("c_mktsegment")).alias("b"))
    clean = raw.withColumns({k: F.nullif(F.trim(k), F.lit("")) for k in ("a", "b")}).dropna(how="any", subset=["a", "b"])
    return clean.select("c_custkey", F.col("a").try_cast("int").alias("a"), "b")


@query(f"with {FRAMES_SQL} select ((abs(clip_key) * 7) % 4)::int as shard, count(distinct clip_key) as clips, count(*) as n_frames from ev group by 1")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy(((F.abs("clip_key") * 7) % 4).cast("int").alias("shard")).agg(F.count_distinct("clip_key").alias("clips"), F.count(F.lit(1)).alias("n_frames"))


@query(f"with {FRAMES_SQL} select clip_key, frame_index, case when value < 250 then round(value / 500, 6) end as happy, case when value < 250 then null else 'ValueError: no face' end as reason from ev")
def hosted_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model host with a stand-in model that fails on some frames."""

    def load():
        def model(batch):
            if (batch["value"] >= 250).any():
                raise ValueError("no face")
            return batch[["clip_key", "frame_index"]].assign(happy=(batch["value"] / 500).round(6))

        return model

    df = frames(spark, sf_dir).select(F.concat_ws(":", "clip_key", "frame_index").alias("id"), "clip_key", "frame_index", "value")
    found = inference.host(df, lambda: _with_id(load()), "id string, clip_key long, frame_index long, happy double", "id")
    place = F.split("id", ":")
    return found.select(place[0].cast("long").alias("clip_key"), place[1].cast("long").alias("frame_index"), "happy", "reason")


def _with_id(model):
    return lambda batch: model(batch).assign(id=batch["id"])[["id", "clip_key", "frame_index", "happy"]]


from . import file_queries  # noqa: E402, F401  registers its own

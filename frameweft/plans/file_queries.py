"""Queries of the operators on paths, manifests, listings and stored tables, made of the supplied tables' names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, scalar
from ..operators import combine, inference, manifest, prosody
from ..sources import readers, sinks
from .adapters import FRAMES_SQL, frames, table
from .registry import query

_VIDEO = "'/data/Original/set.' || c_nationkey || '/Original_' || c_custkey || case when c_custkey % 3 = 0 then '.v2' else '' end || case when c_custkey % 5 = 0 then '.MP4' else '.mp4' end"


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    video = F.concat(F.lit("/data/Original/set."), F.col("c_nationkey").cast("string"), F.lit("/Original_"), c.cast("string"), F.when(c % 3 == 0, ".v2").otherwise(""), F.when(c % 5 == 0, ".MP4").otherwise(".mp4"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", video.alias("video"))


@query(rf"""with v as (select c_custkey, c_nationkey, {_VIDEO} as video from customer), s as (select *, regexp_replace(video, '\.[^./]*$', '') as bare, regexp_extract(video, '([^/]*)\.[^./]*$', 1) as name from v)
    select c_custkey, '/out/set/emo_scores/' || name || '.csv' as emotion_csv, '/out/set.' || c_nationkey || '/' || name || '.pkl' as face_table, '/out/' || name || '.pkl' as lone_table, '/out/set/' || name || '/head_and_frown.csv' as general, '/out/set/' || name || '/keypoints.csv' as points,
        regexp_replace(bare, 'Original', 'Emo') || '.csv' as fer_path, regexp_replace(bare, 'Original', 'Face') || '.pkl' as face_path, replace(video, 'Original', 'Copy') as rewritten, 'Original/set.' || c_nationkey || '/' || name as subdir, name || '_Original' as clip, 'chunk_x.1' as chunk, '/o/chunk_' || printf('%03d', c_custkey::int) || '.txt' as chunk_file from s""")
def clip_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path that is made from a video's."""
    v = F.col("video")
    general, points = paths.legacy_tables(v, "/out")
    csv, pkl = paths.manifest_paths(v, "Original", "Emo", "Face")
    clip, chunk = paths.prosody_key(F.concat(F.lit("a/"), scalar.stem(v), F.lit("/Original/chunk_x.1.csv")), "realtalk")
    return _videos(spark, sf_dir).select("c_custkey", paths.emotion_csv(v, "/out").alias("emotion_csv"), paths.face_table(v, "/out", "/data/Original").alias("face_table"), paths.face_table(v, "/out").alias("lone_table"), general.alias("general"), points.alias("points"), csv.alias("fer_path"), pkl.alias("face_path"), paths.rewritten(v, "Original", "Copy").alias("rewritten"), paths.output_folder(v, "/data").alias("subdir"), clip.alias("clip"), chunk.alias("chunk"), paths.chunk_file(F.lit("/o"), F.col("c_custkey")).alias("chunk_file"))


@query(rf"""with l as (select c_custkey, {_VIDEO} || case when c_custkey % 2 = 0 then ', x' else '' end as value from customer union all select c_custkey, 'Seamless/Seamless_' || c_nationkey || '/p' || c_custkey || '.mp4,a,b' from customer union all select c_custkey, case when c_custkey % 2 = 0 then ' ' else ', x' end from customer),
    f as (select c_custkey, value, trim(string_split(trim(value), ',')[1]) as v from l where trim(string_split(trim(value), ',')[1]) <> '')
    select c_custkey, value, case when starts_with(v, '/') then replace(replace(v, 'Original', 'Original_wav'), 'mp4', 'wav') else '/in/' || replace(replace(v, 'Original', 'Original_wav'), 'mp4', 'wav') end as realtalk, case when starts_with(v, '/') then '' else '/in/' end || replace(replace(v, 'Seamless', 'Seamless_audio'), '.mp4', '_speak.wav') as seamless from f""")
def audio_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _list_lines(spark, sf_dir)
    spoken = manifest.audio_list(lines, "seamless", "/in").withColumnRenamed("audio_path", "seamless")
    return manifest.audio_list(spoken, "realtalk", "/in").select("c_custkey", "value", F.col("audio_path").alias("realtalk"), "seamless")


def _list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, even = _videos(spark, sf_dir), F.col("c_custkey") % 2 == 0
    first = v.select("c_custkey", F.concat("video", F.when(even, ", x").otherwise("")).alias("value"))
    second = v.select("c_custkey", F.concat(F.lit("Seamless/Seamless_"), F.col("c_nationkey").cast("string"), F.lit("/p"), F.col("c_custkey").cast("string"), F.lit(".mp4,a,b")).alias("value"))
    return first.unionByName(second).unionByName(v.select("c_custkey", F.when(even, " ").otherwise(", x").alias("value")))


@query(r"""with l as (select o_orderkey as line_no, case when o_custkey % 4 = 0 then '/data/' || o_orderstatus || '/c' || (o_custkey % 90) || '.MP4' when o_custkey % 4 = 1 then '/else/' || o_orderstatus || '/c' || (o_custkey % 90) || '.x.mp4, a' when o_custkey % 4 = 2 then 'c' || o_custkey || '.mp4' else 'c/d' || o_custkey || '.mov' end as v from orders),
    r as (select line_no, case when starts_with(v, '/data/') then substr(v, 7, length(v) - 10) || '.csv' when starts_with(v, '/else/') then regexp_replace(substr(v, 7), '\.mp4, a$', '') || '.csv' end as rel_csv from l)
    select rel_csv, min(line_no) as line_no from r where rel_csv is not null group by 1""")
def combine_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    inside = lambda root, name: F.concat(F.lit(root), "o_orderstatus", F.lit("/c"), (k % 90).cast("string"), F.lit(name))
    line = F.when(k % 4 == 0, inside("/data/", ".MP4")).when(k % 4 == 1, inside("/else/", ".x.mp4, a")).when(k % 4 == 2, F.concat(F.lit("c"), k.cast("string"), F.lit(".mp4"))).otherwise(F.concat(F.lit("c/d"), k.cast("string"), F.lit(".mov")))
    return manifest.combine_manifest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), line.alias("value")), "/data")


@query("""with li as (select case c_nationkey % 3 when 0 then 'd/' when 1 then 'd/emo_scores/' else 'x/' end || c_custkey || '.csv' as path from customer), w as (select p_partkey, 'd/' || p_partkey || '.csv' as fer from part)
    select p_partkey, case when fer in (select path from li) then fer when 'd/emo_scores/' || p_partkey || '.csv' in (select path from li) then 'd/emo_scores/' || p_partkey || '.csv' else fer end as fer, case when 'd/emo_scores/' || p_partkey || '.csv' in (select path from li) then 'd/emo_scores/' || p_partkey || '.csv' when fer in (select path from li) then fer end as first_found from w""")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emotion tables as given or in the folder beside, and the first of some ordered places."""
    k = F.col("c_nationkey") % 3
    listing = table(spark, sf_dir, "customer").select(F.concat(F.when(k == 0, "d/").when(k == 1, "d/emo_scores/").otherwise("x/"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"))
    wanted = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), F.lit(".csv")).alias("fer"))
    places = [F.concat(F.lit(f), F.col("p_partkey").cast("string"), F.lit(".csv")) for f in ("d/emo_scores/", "d/")]
    found = manifest.first_existing(manifest.resolved_emotions(wanted, "fer", listing, "p_partkey"), places, listing, "p_partkey", "first_found")
    return found.select("p_partkey", F.col("fer_resolved").alias("fer"), "first_found")


@query(rf"""with v as (select c_custkey, {_VIDEO} as video from customer), t as (select distinct '/t/set.' || (o_custkey % 25) || '/Original_' || o_custkey || '.pkl' as path from orders)
    select video as video_path, path as table_path from v join t on path = '/t/' || regexp_replace(substr(video, 16), '\.[^./]*$', '') || '.pkl'""")
def mirrored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    tables = table(spark, sf_dir, "orders").select(F.concat(F.lit("/t/set."), (k % 25).cast("string"), F.lit("/Original_"), k.cast("string"), F.lit(".pkl")).alias("path"))
    return manifest.mirrored(_videos(spark, sf_dir).withColumnRenamed("video", "path"), tables, "/data/Original", "/t")


@query("""with r as (select o_custkey as path, case when o_orderstatus = 'P' then ' ' else o_orderstatus end as a, case when o_orderpriority like '1%' then null else '' end as b from orders) select c_custkey as path, count(r.path) filter (where trim(coalesce(a, '')) <> '' or trim(coalesce(b, '')) <> '')::bigint as rows from customer left join r on r.path = c_custkey group by 1""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table that aren't blank throughout."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("a"), F.when(~F.col("o_orderpriority").startswith("1"), "").alias("b"))
    return readers.data_rows(rows, ["a", "b"], table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path")))


@query("""with p as (select 'v' || o_orderkey as video_path, 60 + o_custkey % 3 as a, 61 as b, 1 - (o_orderkey % 4) * 2e-7 - case when o_orderstatus = 'P' then 0.2 else 0 end as rate from orders where o_orderpriority not like '5%')
    select video_path || ',' || a || ',' || b || ',' || printf('%.6f', rate) || ',' || case when a = b then 'True' else 'False' end as value from p where round(rate, 6) >= 1""")
def alignment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment report, without failed pairs and those that aren't detected throughout."""
    k = F.col("o_orderkey")
    rate = 1 - (k % 4) * 2e-7 - F.when(F.col("o_orderstatus") == "P", 0.2).otherwise(0.0)
    error = F.when(F.col("o_orderpriority").startswith("5"), "cannot open")
    pairs = table(spark, sf_dir, "orders").select(F.concat(F.lit("v"), k.cast("string")).alias("video_path"), (60 + F.col("o_custkey") % 3).alias("pkl_total_frames"), F.lit(61).alias("video_total_frames"), rate.alias("detection_rate"), error.alias("error"))
    return manifest.report_lines(manifest.alignment(pairs))


@query("""select 'd/' || o_orderkey || ',' || n || ',' || (1 + o_custkey % 7) as value from orders join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey where n <> 1 + o_custkey % 7""")
def mismatch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("rows"))
    checked = table(spark, sf_dir, "orders").join(counts, "o_orderkey").select(F.concat(F.lit("d/"), F.col("o_orderkey").cast("string")).alias("path"), "rows", (1 + F.col("o_custkey") % 7).alias("frames"))
    return manifest.mismatch_lines(checked)


@query(rf"""with v as (select c_custkey, {_VIDEO} as video, case when c_custkey % 6 = 0 then 'ERROR' when c_custkey % 4 = 0 then '0.999999' else '1.000000' end as rate from customer)
    select video || ',' || regexp_replace(regexp_replace(video, '\.[^./]*$', ''), 'Original', 'fer/out') || '.csv,' || regexp_replace(regexp_replace(video, '\.[^./]*$', ''), 'Original', 'nod/out') || '.pkl' as value from v where rate = '1.000000' and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')""")
def usable_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    v = _videos(spark, sf_dir).select("c_custkey", F.col("video").alias("video_path"), F.when(c % 6 == 0, "ERROR").when(c % 4 == 0, "0.999999").otherwise("1.000000").alias("detection_rate"))
    excluded = v.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("video_path")
    return sinks.manifest_lines(manifest.usable_manifest(v, excluded, "Original", "fer/out", "nod/out"), "video_path", "fer_path", "face_path")


_SHAPES = ("mouthSmileLeft", "mouthSmileRight", "jawOpen", "eyeWideLeft", "browInnerUp", "mouthFrownRight", "browDownLeft", "browDownRight")


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A face per vector: its first components, doubled, are blendshapes, and those that aren't above -0.1 are missing."""
    value = lambda i: F.col("embedding")[i].cast("double") * 2
    entries = F.array(*(F.struct(F.lit(n).alias("k"), value(i).alias("v")) for i, n in enumerate(_SHAPES)))
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.map_from_entries(F.filter(entries, lambda e: e["v"] > -0.1)).alias("blendshapes"))


_V = "case when embedding[{}]::double * 2 > -0.1 then embedding[{}]::double * 2 end"
_SHAPED = "f as (select vec_id, " + ", ".join(f"{_V.format(i + 1, i + 1)} as {n.lower()}" for i, n in enumerate(_SHAPES)) + " from embeddings)"


@query(f"""with {_SHAPED} select vec_id, round(greatest(0, least(1, (coalesce(mouthsmileleft, 0) + coalesce(mouthsmileright, 0)) / 2)), 9) as smile, round(greatest(0, least(1, coalesce(jawopen, 0))), 9) as jaw_open, round(greatest(0, least(1, coalesce(eyewideleft, 0) / 2)), 9) as eye_wide, round(greatest(0, least(1, coalesce(browinnerup, 0))), 9) as brow_inner_up, round(greatest(0, least(1, coalesce(mouthfrownright, 0) / 2)), 9) as mouth_frown,
    round(greatest(0, least(1, (coalesce(browdownleft, 0) + coalesce(browdownright, 0)) / 2)), 9) as brow_down, round((coalesce(browdownleft, 0) + coalesce(browdownright, 0)) / 2, 9) as au04_proxy, round(greatest(0, least(1, (coalesce(browdownleft, 0) + coalesce(browdownright, 0)) / 2)), 9) as au04 from f""")
def blendshape_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir).withColumn("au04_proxy", scalar.au04_proxy("blendshapes"))
    names = ("smile", "jaw_open", "eye_wide", "brow_inner_up", "mouth_frown", "brow_down", "au04_proxy", "au04")
    return readers.blendshape_means(faces).select("vec_id", *(F.round(F.coalesce(n, F.lit(0.0)), 9).alias(n) for n in names))


@query("with s as (select vec_id, " + ", ".join(f"{_V.format(i + 1, i + 1)} as v{i}" for i in range(len(_SHAPES))) + " from embeddings), l as (" + " union all ".join(f"select vec_id, '{n}' as name, v{i} as v, {i} as i from s where v{i} is not null" for i, n in enumerate(_SHAPES)) + """)
    select vec_id, (row_number() over (partition by vec_id order by v desc, i))::int as place, name, round(v, 9) as score from l qualify place <= 5""")
def strongest_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _faces(spark, sf_dir).select("vec_id", F.posexplode(readers.top_shapes("blendshapes")).alias("place", "s"))
    return top.select("vec_id", (F.col("place") + 1).alias("place"), "s.name", F.round("s.score", 9).alias("score"))


@query("with l as (" + " union all ".join(f"select vec_id % 40 as clip_key, '{n}' as name from embeddings where embedding[{i + 1}]::double * 2 > 0.1" for i, n in enumerate(_SHAPES)) + ") select clip_key, string_agg(distinct name, ',' order by name) as names from l group by 1")
def shape_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that any frame of a clip has."""
    strong = F.map_filter("blendshapes", lambda k, v: v > 0.1)
    return readers.frame_keys(_faces(spark, sf_dir).select((F.col("vec_id") % 40).alias("clip_key"), strong.alias("values"))).select("clip_key", F.array_join("names", ",").alias("names"))


@query(f"""with {FRAMES_SQL}, q as (select distinct clip_key, n, unnest([0, 1, 60, -1, -90]) as place from ev), a as (select *, case when place < 0 then n + place else place end as i from q)
    select a.clip_key, a.place::int as place, ev.frame_index, ev.cents from a left join ev on ev.clip_key = a.clip_key and ev.frame_index = a.i""")
def inspected_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at places that may count from the end."""
    found = readers.frames_at(frames(spark, sf_dir).select("clip_key", "frame_index", "cents"), [0, 1, 60, -1, -90])
    return found.select("clip_key", "place", F.when(F.col("cents").isNotNull(), F.col("frame_index")).alias("frame_index"), "cents")


@query("with f as (select vec_id, vec_id % 3 <> 0 as seen, embedding[1]::double as p, embedding[2]::double as y from embeddings) select vec_id, coalesce(case when vec_id % 5 <> 0 then seen end, false) as detected, coalesce(case when vec_id % 3 <> 0 then p end, 0.0) as pitch, coalesce(case when vec_id % 7 <> 0 then y end, 0.0) as yaw from f")
def known_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame without an angle has 0, and one that doesn't say so isn't detected."""
    v, at = F.col("vec_id"), lambda i: F.col("embedding")[i].cast("double")
    faces = table(spark, sf_dir, "embeddings").select("vec_id", F.when(v % 5 != 0, v % 3 != 0).alias("detected"), F.when(v % 3 != 0, at(0)).alias("pitch"), F.when(v % 7 != 0, at(1)).alias("yaw"))
    return readers.pose_angles(faces)


@query("""with r as (select l_orderkey as clip_key, l_linenumber // 2 as f, l_linenumber::int as line_no, l_partkey as p, row_number() over (partition by l_orderkey order by l_linenumber // 2, l_linenumber * 1000000 + l_partkey) - 1 as position from lineitem)
    select clip_key, position::int as position, f::int as frame_index, p / 100 + line_no as weight from r""")
def stored_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined rows in the order of frames, then lines; repeated frames stay."""
    n = F.col("l_linenumber").cast("int")
    text = F.format_string("%d.50", F.floor(n / 2).cast("int"))  # an index may be a decimal, which is cut
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_key"), (n.cast("long") * 1000000 + F.col("l_partkey")).alias("line_no"), text.alias("frame_index"), (F.col("l_partkey") / 100).cast("string").alias("a"), n.cast("string").alias("b"))
    return combine.matrix(rows, ("a", "b")).select("clip_key", "position", "frame_index", (F.col("values")[0] + F.col("values")[1]).alias("weight"))


@query("""with s as (select event_id // 50 as clip_key, event_type as chunk_name, event_id as line_no, (event_id % 9)::int as i, cast(round(value * 100) as bigint) / 100 as v from events), l as (select clip_key, chunk_name, i, max_by(v, line_no) as v from s where i < 6 group by all), k as (select distinct clip_key, chunk_name from s)
    select clip_key, chunk_name, unnest(range(0, 6))::int as frame_index, coalesce(list_extract([max(v) filter (where i = 0), max(v) filter (where i = 1), max(v) filter (where i = 2), max(v) filter (where i = 3), max(v) filter (where i = 4), max(v) filter (where i = 5)], unnest(range(0, 6)) + 1), 0.0) as score from k left join l using (clip_key, chunk_name) group by 1, 2""")
def converted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-length vectors: later lines win, and indexes beyond the length are left out."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.floor(e / 50).alias("clip_key"), F.col("event_type").alias("chunk_name"), e.alias("line_no"), (e % 9).cast("string").alias("frame_index"), (F.round(F.col("value") * 100).cast("long") / 100).cast("string").alias("intensity_score"))
    return prosody.converted_vector(rows, 6).select("clip_key", "chunk_name", F.posexplode("intensity_score").alias("frame_index", "score"))


@query(f"with {FRAMES_SQL}, r as (select distinct cast(clip_key as varchar) as rel_csv, event_type as reaction from ev), m as (select distinct cast(o_custkey % 300 as varchar) as rel_csv from orders) select m.rel_csv, count(r.reaction) = 5 as ok, case when count(r.reaction) = 5 then 'ok' else 'missing ' || (5 - count(r.reaction)) || ' reaction csv(s)' end as message from m left join r using (rel_csv) group by 1")
def combine_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each clip of a manifest: the combination needs all reactions."""
    kinds = ("click", "error", "purchase", "signup", "view")
    reactions = frames(spark, sf_dir).select(F.col("clip_key").cast("string").alias("rel_csv"), F.col("event_type").alias("reaction"), "frame_index", F.col("value").alias("intensity"), F.col("frame_index").alias("line_no"))
    listed = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).cast("string").alias("rel_csv"))
    return combine.combine_clips(listed, reactions, kinds)[1]


@query("with r as (select c_custkey as clip_key, case when c_custkey % 4 = 0 then null else c_nationkey end as a, nullif(trim(case when c_custkey % 6 = 0 then ' ' else c_mktsegment end), '') as b, c_name as p from customer) select clip_key, a, b, p from r where a is not null or b is not null")
def legacy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two tables of the legacy detector, joined: rows of which all general columns are null go."""
    c = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(c.alias("clip_key"), F.when(c % 4 != 0, F.col("c_nationkey")).alias("a"), F.when(c % 6 == 0, " ").otherwise(F.col("c_mktsegment")).alias("b"), F.col("c_name").alias("p"))
    general, points = readers.legacy_tables(raw, ["a", "b"], ["p"], how="all")
    return general.join(points, "clip_key")


@query("with n as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) select o_orderkey, (i % 3)::int as shard from n")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = len(inference.worker_ids("0, 1,,2"))
    return manifest.round_robin(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", shards)


@query("with d as (select distinct l_orderkey from lineitem where l_quantity > 45), f as (select o_orderkey, row_number() over (order by o_orderkey) as i from orders) select o_orderkey, 'limit first' as way from f where i <= 100 and o_orderkey not in (select * from d) union all select * from (select o_orderkey, 'pending first' as way from orders where o_orderkey not in (select * from d) order by 1 limit 100)")
def scheduled_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of what there is, less what is done, and the first hundred of what isn't done."""
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    work = table(spark, sf_dir, "orders").select("o_orderkey")
    both = [manifest.scheduled(work, done, "o_orderkey", 100, first).withColumn("way", F.lit(way)) for first, way in ((True, "limit first"), (False, "pending first"))]
    return both[0].unionByName(both[1])


@query(f"""with {FRAMES_SQL}, s as (select clip_key, max(cents) / 100 as peak, avg(case when cents >= 3000 then 1.0 else 0.0 end) as ratio from ev group by 1), a as (select *, cents >= 3000 as act, row_number() over (partition by clip_key order by frame_index) - row_number() over (partition by clip_key, cents >= 3000 order by frame_index) as r from ev),
    l as (select clip_key, max(n) as run from (select clip_key, count(*) as n from a where act group by clip_key, r) group by 1), c as (select * from s join l using (clip_key) where peak >= 100 and run >= 3 and ratio >= 0.4), k as (select * from c order by md5('7:' || 'v' || clip_key), 'v' || clip_key limit 15)
    select 'v' || clip_key as video_path, 'r/' || clip_key || '.csv' as score_csv_path, printf('%.6f', peak) as peak_score, run::bigint as max_consecutive_active_frames, printf('%.6f', round(ratio, 6)) as active_ratio, 'o/' || clip_key || '.mp4' as overlay_video_path from k""")
def sample_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of the clips that reach the minima of peak, run and ratio, as its manifest has them."""
    from ..functions.sequence import longest_run

    f = frames(spark, sf_dir).select("clip_key", "frame_index", "cents")
    active = F.col("cents") >= 3000
    stats = f.groupBy("clip_key").agg((F.max("cents") / 100).alias("peak"), F.round(F.avg(active.cast("double")), 6).alias("active_ratio")).join(longest_run(f, active), "clip_key")
    name = lambda a, b: F.concat(F.lit(a), F.col("clip_key").cast("string"), F.lit(b))
    stats = stats.withColumns({"video_path": name("v", ""), "csv_path": name("r/", ".csv"), "overlay_video_path": name("o/", ".mp4")})
    return sinks.sample_rows(manifest.selected(stats, 100, 3, 0.4, 15, 7))


@query(f"with {FRAMES_SQL} select e.clip_key, e.frame_index, 'smiling: ' || printf('%.3f', coalesce(round(s.cents / 100000, 3), 0)) as label from ev e left join (select * from ev where event_type <> 'view') s using (clip_key, frame_index)")
def overlay_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return sinks.overlay_labels(f, f.where("event_type <> 'view'").withColumn("score", F.round(F.col("cents") / 1e5, 3)), "smiling", "score")

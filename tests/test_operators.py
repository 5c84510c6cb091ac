"""Hand-written edge cases and numpy restatements of the sequence functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameweft.functions import scalar, sequence
from frameweft.operators import combine, prosody
from frameweft.sources import readers


def clip(spark, values, **more):
    return spark.createDataFrame([(1, i, v, *(c[i] for c in more.values())) for i, v in enumerate(values)], ["clip_key", "frame_index", "x", *more])


def column(df, name):
    return [r[name] for r in df.orderBy("frame_index").collect()]


def averaged(x, w):
    w = w + 1 if w % 2 == 0 else w
    return np.convolve(np.pad(x, w // 2, mode="edge"), np.ones(w) / w, "valid")


@pytest.mark.parametrize("n,window", [(1, 7), (5, 7), (3, 151), (40, 8), (40, 1)])
def test_moving_average(spark, n, window):
    x = np.random.default_rng(n).random(n)
    got = column(clip(spark, x.tolist()).withColumn("a", sequence.moving_average(F.col("x"), window)), "a")
    assert np.allclose(got, averaged(x, window) if window > 1 else x)


def gated(x, on, off, least):
    out, start = [False] * len(x), None
    for i, v in enumerate([*x, -1.0]):
        if start is None and v >= on:
            start = i
        elif start is not None and v < off:
            if i - start >= least:
                out[start:i] = [True] * (i - start)
            start = None
    return out


def test_gate(spark):
    rng = np.random.default_rng(3)
    for x in (np.round(rng.random(80), 1).tolist(), [0.5, 0.3, 0.3], [0.3, 0.4, 0.2], [0.0] * 4, [0.5, 0.4, 0.29, 0.5, 0.5, 0.5]):
        assert column(sequence.with_gate(clip(spark, x), "x", 0.5, 0.3, 3), "gate") == gated(x, 0.5, 0.3, 3)
    with pytest.raises(ValueError):
        sequence.with_gate(clip(spark, [0.0]), "x", 0.3, 0.5, 1)


def test_gap_fill_and_norm(spark):
    x, seen = [1.0, 9.0, None, 9.0, 5.0, 9.0], [False, True, True, False, True, False]
    got = column(clip(spark, x, d=seen).withColumn("f", sequence.fill_gaps(F.col("x"), F.col("d"))), "f")
    assert got == [9.0, 9.0, 0.0, 2.5, 5.0, 5.0]
    none = clip(spark, [1.0, 2.0], d=[False, False]).withColumn("f", sequence.fill_gaps(F.col("x"), F.col("d")))
    assert column(none, "f") == [0.0, 0.0]
    assert column(clip(spark, [0.0, 0.0]).withColumn("r", sequence.robust_norm(F.col("x"))), "r") == [0.0, 0.0]


def test_turns_skip_plateaus(spark):
    df = clip(spark, [0.0, 1.0, 1.0, 0.0, 2.0, 2.0, 3.0])
    assert set(column(sequence.with_turns(df, "x", ["clip_key"]), "turns")) == {2}


def test_clip_keeps_null(spark):
    got = column(clip(spark, [None, float("nan"), -1.0, 2.0, 0.5]).withColumn("c", sequence.clip01(F.col("x"))), "c")
    assert got == [None, None, 0.0, 1.0, 0.5]


def test_winner_ties_and_zeros(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.1), (0.0, 0.0, 0.0), (None, 0.2, 0.3)], "a double, b double, c double")
    assert [tuple(r) for r in df.select(*(v.alias(k) for k, v in combine.winner_take_all("a", "b", "c").items())).collect()] == [(0.5, 0, 0), (0, 0, 0), (0, 0, 0.3)]


@pytest.mark.parametrize("n,chunks", [(119, 1), (120, 2), (59, 0)])
def test_chunks_by_position(spark, n, chunks):
    df = spark.createDataFrame([("a", i * 3 + 7, float(i)) for i in range(n)], "clip_key string, frame_index int, v double")
    got = combine.chunk(df, 60, ["frame_index"], ["v"]).orderBy("chunk_idx").collect()
    assert len(got) == chunks and all(len(r.data) == 60 for r in got)
    if got:
        assert got[0].chunk_name == "chunk_000" and got[0].data[5] == [5.0]


def test_prosody(spark):
    texts = spark.createDataFrame([("a", "0.00, 2.40, 0.90"), ("b", "0.40, 1.20, 0.78\n0.80, 1.00, 0.5"), ("c", "NULL"), ("d", ""), ("e", "0.28, 0.32, -0.5\n1.0, 0.5, 0.9"), ("f", "NULL\nnoise"), ("g", "5.0, 6.0, 0.7\nnull"), ("h", "-0.10, 0.40, 0.9"), ("i", "-0.50, -0.10, 0.9")], "k string, text string")
    rows = {(r.k, r.frame_index): r.intensity_score for r in prosody.expand(texts, ["k"], 25, 60).collect()}
    assert len(rows) == 9 * 60 and all(rows["a", i] == 0.9 for i in range(60))
    assert rows["b", 9] == 0 and rows["b", 10] == 0.78 and rows["b", 20] == 0.5 and rows["b", 29] == 0.78 and rows["b", 30] == 0
    assert rows["c", 0] == rows["d", 0] == 0 and rows["e", 7] == -0.5 and rows["e", 6] == 0
    assert [rows["h", i] for i in (0, 9, 10)] == [0.9, 0.9, 0.0] and not any(rows[k, i] for k in "gi" for i in range(60))
    counts = {r.k: (r.n_valid, r.n_errors, r.is_null) for r in prosody.line_counts(texts, ["k"]).collect()}
    assert counts == {"a": (1, 0, False), "b": (2, 0, False), "c": (0, 0, True), "d": (0, 0, False), "e": (1, 1, False), "f": (0, 1, True), "g": (0, 0, True), "h": (1, 0, False), "i": (0, 0, False)}
    dirty = spark.createDataFrame([("a", "0.1, 0.2, 0.49\n0.1, 0.2, 0.50\n0.1, 0.2, 1.20\n0.1, 2.41, 0.9\nx"), ("b", " null "), ("c", None), ("d", "-0.1, 0.2, 0.9\r\n0.125, 0.375, 0.625\n0.145, 2.4000001, 0.985")], "k string, text string")
    assert [r.score for r in prosody.clean(dirty, ["k"], 2.4).where("k = 'a'").orderBy("line_no").collect()] == [0.5, 1.0]
    kept = {r.k: r.t for r in dirty.select("k", prosody.cleaned_text("text", 2.4).alias("t")).collect()}
    expected = "\n".join(f"{a:.2f}, {b:.2f}, {c:.2f}" for a, b, c in ((0.125, 0.375, 0.625), (0.145, 2.4000001, 0.985)))
    assert kept == {"a": "0.10, 0.20, 0.50\n0.10, 0.20, 1.00", "b": "NULL", "c": "NULL", "d": expected}


def test_two_decimals(spark):
    x = [i / 1000 for i in range(2500)] + [i / 8 for i in range(20)] + np.random.default_rng(2).random(500).tolist()
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(scalar.two_decimals(F.col("x"))).collect()]
    assert got == [f"{v:.2f}" for v in x]


def test_half_precision(spark):
    x = np.concatenate([np.random.default_rng(1).normal(size=500), [0.0, 1.0, 6e-8, 1e-5, -0.3, 65504, 65519, 65520, -70000, 1e30]])
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1).select(scalar.half_precision(F.col("x"))).collect()]
    with np.errstate(over="ignore"):
        assert got == x.astype(np.float32).astype(np.float16).astype(float).tolist()


def test_no_landmarks_no_box(spark):
    box, px = scalar.bounding_box("p", 10, 10)
    rows = spark.createDataFrame([(None,), ([],), ([[0.25, -1.0], [0.65, 0.5]],)], "p array<array<double>>").select(box, px).collect()
    assert [tuple(r) for r in rows] == [(None, None), (None, None), ([0.25, 0.0, 0.65, 0.5], [2, 0, 6, 5])]


def test_pruned_clips_go_whole(spark):
    others = spark.createDataFrame([("a", "chunk_000"), ("a", "meta"), ("b", "chunk_009"), ("b", "meta"), ("c", "meta"), ("d", "chunk_1"), ("d", "chunk_2")], "clip_key string, chunk_name string")
    kept = spark.createDataFrame([("a", "chunk_000"), ("b", "chunk_000"), ("c", "chunk_000"), ("d", "chunk_2"), ("d", "chunk_2")], "clip_key string, chunk_name string")
    assert sorted(map(tuple, combine.prune(others, kept).collect())) == [("a", "chunk_000"), ("a", "meta"), ("d", "chunk_2")]


def test_paths(spark):
    df = spark.createDataFrame([("/r/a/b_33.281_41.261.mp4",)], "p string")
    got = df.select(scalar.output_key(F.col("p"), "/r"), scalar.stem(F.col("p")), scalar.output_key(F.col("p"), "/x"), *scalar.prefix_and_end(F.lit("ab_cd_e"))).first()
    assert tuple(got) == ("a/b_33.281_41.261", "b_33.281_41.261", "a_b_33.281_41.261", "ab_cd_", "e")


def test_emotion_rows(spark):
    """An index must be whole, an empty or missing score is 0, and of repeated frames the last line counts."""
    rows = spark.createDataFrame([("a", 0, "1.9", "0.2"), ("a", 1, " 1", "0.7"), ("a", 2, "x", "0.7"), ("a", 3, "2", "1d"), ("a", 4, "3", ""), ("a", 5, "4", None), ("a", 6, "1", "7")], "clip_key string, line_no int, frame_index string, happy string")
    assert sorted(map(tuple, readers.emotion_scores(rows, ["happy"]).collect())) == [("a", 1, 1.0), ("a", 3, 0.0), ("a", 4, 0.0)]
    assert readers.emotion_scores(rows, ["happy", "sad"]).where("sad = 0").count() == 3
    scan = readers.reaction_scores(rows.withColumn("happy", F.expr("case when happy = '0.2' then '-3' else happy end")), "happy")
    assert sorted(map(tuple, scan.collect())) == [("a", 1, 7.0)]
    assert readers.score_column(["frame_index", "x"], "y") == "x" and readers.sample_column(["z", "frame_index", "b_intensity"]) == "b_intensity"
    for columns in (["frame_index"], ["frame_index", "x", "z"]):
        with pytest.raises(ValueError):
            readers.score_column(columns, "y")


def test_smile_is_limited(spark):
    faces = spark.createDataFrame([(True, {"mouthSmileLeft": 1.5, "mouthSmileRight": 1.5, "browDownLeft": 0.5})], "detected boolean, blendshapes map<string, double>")
    row = readers.blendshape_means(faces).first()
    assert (row.smile, row.brow_down, row.au04, row.jaw_open) == (1.0, 0.25, 0.25, 0.0)


def test_strict_tables(spark):
    rows = spark.createDataFrame([("a", "c", 0, "0.9", "0.5"), ("a", "c", 1, "7", "0.5"), ("a", "c", 2, "0", "0.25")], "clip_key string, chunk_name string, line_no int, frame_index string, intensity_score string")
    assert prosody.converted_vector(rows, 3).first().intensity_score == [0.25, 0.0, 0.0]
    with pytest.raises(Exception, match="isn't a number"):
        prosody.converted_vector(rows.withColumn("intensity_score", F.lit("x")), 3).collect()
    with pytest.raises(Exception, match="unknown dataset"):
        spark.range(1).select(scalar.clip_key_of(F.lit("a/b.csv"), F.lit("other"))).collect()
    with pytest.raises(KeyError):
        readers.require_columns(rows, ["missing"])


def test_stream_gate(spark, tmp_path):
    from frameweft.streaming.gate import stream_events

    x = [0.1, 0.6, 0.4, 0.35, 0.1, 0.7, 0.1, 0.9, 0.9, 0.9]
    for part in (0, 1):
        spark.createDataFrame([(1, i, x[i]) for i in range(part * 5, part * 5 + 5)], "clip_key long, frame_index long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("clip_key long, frame_index long, x double").parquet(str(tmp_path / "in"))
    query = stream_events(stream, "x", 0.5, 0.3, 3).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("closed").collect()] == [(1, 1, 4, 3)]

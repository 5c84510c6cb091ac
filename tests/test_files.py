"""Readers, writers and drivers on files of a temporary folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameweft.functions import paths
from frameweft.operators import combine, detectors, drivers, inference, manifest
from frameweft.sources import readers, sinks


def texts(df, name="value"):
    return [r[name] for r in df.collect()]


def test_discovery(spark, tmp_path):
    for name in ("b/x.MP4", "a/y.mov", "a/z.txt", "c.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = texts(readers.discover(spark, str(tmp_path)), "path")
    assert [p.rsplit("/", 1)[1] for p in found] == ["y.mov", "x.MP4", "c.mp4"]
    assert texts(readers.discover(spark, str(tmp_path), "mp4", first=1), "path") == found[1:2]
    assert texts(readers.discover(spark, str(tmp_path / "c.mp4")), "path") == found[2:]


def test_csv_columns_go_by_their_own_header(spark, tmp_path):
    (tmp_path / "one.csv").write_text('frame_index,happy\n0,0.5\n"1","0,5"\n\n2,\n')
    (tmp_path / "two.csv").write_text("sad,happy,frame_index\r\n0.1,0.9,7\r\n")
    rows = readers.read_csv_frames(spark, str(tmp_path), ["frame_index", "happy", "angry"]).orderBy("path", "line_no").collect()
    assert [(r.frame_index, r.happy, r.angry) for r in rows] == [("0", "0.5", None), ("1", "0,5", None), ("2", "", None), ("7", "0.9", None)]


def test_writers_and_readers_agree(spark, tmp_path):
    frames = spark.createDataFrame([("smiling", k, i, i / 7) for k in ("a", "b") for i in range(5)], "reaction string, clip_key string, frame_index int, v double")
    sinks.write_signals(frames, f"{tmp_path}/signals")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/signals").select(frames.columns).collect())) == sorted(map(tuple, frames.collect()))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_signals(frames, f"{tmp_path}/signals")
    sinks.write_signals(frames, f"{tmp_path}/signals", overwrite=True)

    sinks.write_signal_csv(frames, f"{tmp_path}/csv", "v")
    back = readers.read_csv_frames(spark, f"{tmp_path}/csv/clip_key=a", ["frame_index", "v"]).orderBy("line_no").collect()
    assert [(r.frame_index, r.v) for r in back] == [(str(i), f"{i / 7:.6f}") for i in range(5)]

    chunks = combine.chunk(frames, 2, ["frame_index"], ["v"]).withColumn("modality", F.lit("reaction"))
    sinks.write_chunks(combine.half_chunks(chunks), f"{tmp_path}/chunks")
    stored = {(r.clip_key, r.chunk_name): r.data for r in spark.read.parquet(f"{tmp_path}/chunks").collect()}
    assert stored["b", "chunk_001"] == [[float(np.float16(np.float32(i / 7)))] for i in (2, 3)] and len(stored) == 4

    sinks.write_manifest(spark.createDataFrame([("a.mp4", "b", "c")], "x string, y string, z string"), f"{tmp_path}/list", "x", "y", "z")
    assert tuple(manifest.parse_manifest(readers.read_lines(spark, f"{tmp_path}/list").select("value")).first()) == ("a.mp4", "b", "c")

    spoken = spark.createDataFrame([("v1", 3, "0.1, 0.2, 0.9\n0.3, 0.4, 0.8"), ("v1", 1003, "NULL")], "clip_key string, chunk int, text string")
    sinks.write_segments(spoken, f"{tmp_path}/text")
    found = {r.path.split("clip_key=")[1].rsplit("/", 1)[0]: r.text for r in readers.read_texts(spark, f"{tmp_path}/text").collect()}
    assert found == {"v1/chunk_name=chunk_003": "0.1, 0.2, 0.9\n0.3, 0.4, 0.8\n", "v1/chunk_name=chunk_1003": "NULL\n"}
    (tmp_path / "prompt.txt").write_text("\n Say what you hear. \n")
    assert readers.read_prompt(spark, str(tmp_path / "prompt.txt")) == "Say what you hear."

    sinks.write_lines(manifest.mismatch_lines(spark.createDataFrame([("b", 1, 2), ("a", 3, 1), ("c", 1, 1), ("d", 1, None)], "path string, rows int, frames int")), f"{tmp_path}/mismatch")
    assert texts(readers.read_lines(spark, f"{tmp_path}/mismatch")) == ["a,3,1", "b,1,2"]


def test_listing_functions(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 9, 1)], "k int")
    assert {r.k: r.shard for r in manifest.round_robin(df, "k", 3).collect()} == {1: 0, 3: 1, 5: 2, 9: 0}
    done = spark.createDataFrame([(1,)], "k int")
    assert sorted(texts(manifest.scheduled(df, done, "k", 2), "k")) == [3] and sorted(texts(manifest.scheduled(df, done, "k", 2, False), "k")) == [3, 5]
    assert inference.worker_ids("0, 2,") == [0, 2] and inference.worker_ids(None) == [-1] and inference.worker_ids(None, 2) == [0, 1]
    with pytest.raises(ValueError):
        inference.worker_ids(" , ")
    lines = spark.createDataFrame([("/r/s/a.b.MP4, x",), (" /r/s/a.b.mp4",), ("/q/p/c.mp4",), ("d.mp4",), ("",), ("/r/e.mov",)], "value string").withColumn("line_no", F.monotonically_increasing_id())
    assert sorted(texts(manifest.combine_manifest(lines, "/r"), "rel_csv")) == ["p/c.csv", "s/a.b.csv"]
    clip, chunk = paths.prosody_key(F.lit("x/v_speak_1_speak/chunk_004.csv"), "seamless")
    assert tuple(spark.range(1).select(clip, chunk).first()) == ("v_1", "chunk_004")


def test_parameters_are_checked():
    for gate in (detectors.Gate(0, 0.5, 0.3, 1), detectors.Gate(5, 0.5, 0.3, 0), detectors.Gate(5, 0.3, 0.5, 1)):
        with pytest.raises(ValueError):
            drivers.check_gate(gate)
    for change in ({"baseline": 0}, {"turns": -1}, {"cycles": -1}):
        with pytest.raises(ValueError):
            drivers.check_motion(drivers.replace(detectors.NODDING, **change))
    assert all(drivers.check_motion(p) for p in drivers.NODDING_PROFILES.values())


def smiling(happy, smile, seen):
    """The detector restated in numpy."""
    raw = np.clip((0.65 * happy + 0.35 * smile) * seen, 0, 1)
    s = np.round(np.convolve(np.pad(raw, 3, mode="edge"), np.ones(7) / 7, "valid"), 6)
    out, start = np.zeros(len(s)), None
    for i, v in enumerate([*s, -1]):
        if start is None and v >= 0.45:
            start = i
        elif start is not None and v < 0.30:
            if i - start >= 6:
                out[start:i] = s[start:i]
            start = None
    return out


def test_detector_from_manifest_to_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    faces, lines, expected = [], [], {}
    for k in range(3):
        n, happy = 90, np.clip(np.repeat(rng.random(9), 10) + rng.normal(0, 0.05, 90), 0, 1).round(3)
        smile, seen = rng.random(n).round(3), rng.random(n) > 0.1
        folder = tmp_path / "fer" / ("emo_scores" if k == 1 else "")
        folder.mkdir(parents=True, exist_ok=True)
        if k < 2:
            (folder / f"v{k}.csv").write_text("frame_index,happy\n" + "".join(f"{i},{h}\n" for i, h in enumerate(happy)))
            expected[f"s/v{k}"] = smiling(happy, smile, seen)
        faces += [(f"{tmp_path}/faces/v{k}.pkl", i, bool(seen[i]), {"mouthSmileLeft": float(smile[i]), "mouthSmileRight": float(smile[i])}, None, None) for i in range(n)]
        lines.append(f"/videos/s/v{k}.mp4,{tmp_path}/fer/v{k}.csv,{tmp_path}/faces/v{k}.pkl")
    lines += [f"/videos/s/v9.mp4,{tmp_path}/fer/v0.csv,{tmp_path}/faces/v9.pkl", "two,fields"]
    (tmp_path / "list.txt").write_text("\n".join(lines))
    spark.createDataFrame(faces, "path string, frame_index long, detected boolean, blendshapes map<string, double>, pitch double, yaw double").write.parquet(f"{tmp_path}/faces")
    args = (spark, "smiling", f"{tmp_path}/list.txt", f"{tmp_path}/fer", f"{tmp_path}/faces", f"{tmp_path}/out", "/videos")
    results = {r.clip_key: (r.ok, r.message) for r in drivers.run_detector(*args).collect()}
    assert results["s/v0"] == results["s/v1"] == (True, "ok") and len(results) == 4
    assert results["s/v2"] == (False, f"fer_path not found: {tmp_path}/fer/v2.csv") and results["s/v9"] == (False, f"face_path not found: {tmp_path}/faces/v9.pkl")
    got = spark.read.parquet(f"{tmp_path}/out/intensity")
    assert got.count() == 180
    for k, v in expected.items():
        found = [r.smiling_intensity for r in got.where(F.col("clip_key") == k).orderBy("frame_index").collect()]
        assert np.allclose(found, v, atol=2e-6) and v.any()
    with pytest.raises(Exception, match="already exists"):
        drivers.run_detector(*args)
    assert drivers.run_detector(*args, sample=2, seed=3, overwrite=True, csv=True).count() == 2
    with pytest.raises(ValueError):
        drivers.run_detector(*args, gate=detectors.Gate(7, 0.3, 0.5, 6))


@pytest.mark.parametrize("name", sorted(drivers.DETECTORS))
def test_every_detector_runs(spark, name):
    wave = lambda i: (0.0, 10.0, 0.0, -10.0)[i % 4]
    faces = spark.createDataFrame([("a", i, True, {"jawOpen": (i % 9) / 9, "browInnerUp": 0.8}, *((wave(i), 0.0) if "nod" in name else (0.0, wave(i)))) for i in range(60)], "clip_key string, frame_index long, detected boolean, blendshapes map<string, double>, pitch double, yaw double")
    emotions = spark.createDataFrame([("a", i, str(i), "0.9", "0.9", "0.9", "0.8") for i in range(60)], "clip_key string, line_no int, frame_index string, happy string, sad string, angry string, surprise string")
    rows = drivers.detect(name, faces, emotions).collect()
    assert len(rows) == 60 and any(r[f"{name}_intensity"] > 0 for r in rows)

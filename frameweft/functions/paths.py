"""Column functions: where the files of a clip lie, by the path of its video."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import parent, replace_first, stem, without_suffix


def _stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def under(path: Column, root: str) -> Column:
    """The path below root; null if it isn't."""
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30))


def emotion_csv(video: Column, root: str) -> Column:
    """<root>/<parent's stem>/emo_scores/<stem>.csv; videos of equal names in folders of equal names share one."""
    return F.concat(F.lit(root + "/"), F.concat_ws("/", _stem_of(parent(video)), F.lit("emo_scores"), F.concat(stem(video), F.lit(".csv"))))


def face_table(video: Column, root: str, input_root: str | None = None) -> Column:
    """The video's place below input_root, below root instead and ending in .pkl; without input_root <root>/<stem>.pkl."""
    name = stem(video) if input_root is None else without_suffix(under(video, input_root))
    return F.concat(F.lit(root + "/"), name, F.lit(".pkl"))


def legacy_tables(video: Column, root: str) -> tuple[Column, Column]:
    """The paths of the two tables of a video: general features and key points."""
    folder = F.concat(F.lit(root + "/"), _stem_of(parent(video)), F.lit("/"), stem(video))
    return F.concat(folder, F.lit("/head_and_frown.csv")), F.concat(folder, F.lit("/keypoints.csv"))


def manifest_paths(video: Column, old: str, emotions: str, faces: str) -> tuple[Column, Column]:
    """The video's path with the first old replaced, by emotions and ending in .csv, and by faces and ending in .pkl."""
    moved = lambda new, end: F.concat(without_suffix(replace_first(video, old, new)), F.lit(end))
    return moved(emotions, ".csv"), moved(faces, ".pkl")


def rewritten(path: Column, old: str, new: str) -> Column:
    """path with every old replaced."""
    return F.replace(path, F.lit(old), F.lit(new))


def combined_csv(video: Column, root: str) -> Column:
    """The place of a clip's table: below root as the video, else <parent>/<stem>.csv; null where a video has no parent."""
    outside = F.when(parent(video).isNotNull(), F.concat(parent(video), F.lit("/"), stem(video)))
    return F.concat(F.coalesce(without_suffix(under(video, root)), outside), F.lit(".csv"))


def audio_file(video: Column, dataset: str, root: str, spoken: bool = True) -> Column:
    """The audio file of a video; relative paths are below root. spoken: seamless files end in _speak."""
    if dataset == "realtalk":
        moved = rewritten(rewritten(video, "Original", "Original_wav"), "mp4", "wav")
    elif dataset == "seamless":
        moved = rewritten(rewritten(video, "Seamless", "Seamless_audio"), *((".mp4", "_speak.wav") if spoken else ("mp4", "wav")))
    else:
        moved = video
    return F.when(moved.startswith("/"), moved).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), moved))


def output_folder(audio: Column, root: str) -> Column:
    """The place of an audio file below root, without suffix; null if it isn't below."""
    return without_suffix(under(audio, root))


def prosody_key(path: Column, dataset: str) -> tuple[Column, Column]:
    """Clip and chunk of a converted table's path below its root. realtalk: <grandparent>_<parent>; seamless:
    the parent without every _speak. A path that is too short is an error, and so is another dataset."""
    parts = F.split(path, "/")
    if dataset == "realtalk":
        least, clip = 3, F.concat_ws("_", F.try_element_at(parts, F.lit(-3)), parent(path))
    elif dataset == "seamless":
        least, clip = 2, rewritten(parent(path), "_speak", "")
    else:
        raise ValueError(f"unknown dataset {dataset}")
    return F.when(F.size(parts) < least, F.raise_error(F.concat(F.lit("too few parts in "), path))).otherwise(clip), stem(path)


def chunk_file(folder: Column, number: Column) -> Column:
    """<folder>/chunk_<number>.txt, with three digits or more."""
    return F.concat(folder, F.lit("/"), F.format_string("chunk_%03d.txt", number.cast("int")))


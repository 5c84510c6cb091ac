"""Column functions: paths and names, parsing, poses, boxes and half precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line formats of timed events; only the second takes scores with a sign.
EVENT_LINE = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*$"
SIGNED_EVENT_LINE = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*$"
#: Where a text file's lines end.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"


def number(text: Column) -> Column:
    """A double where text is a plain decimal number, else null."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def whole_number(text: Column) -> Column:
    """An int where text is one, without a fraction; else null."""
    return F.when(text.rlike(WHOLE_NUMBER), F.trim(text).try_cast("int"))


def two_decimals(x: Column) -> Column:
    """x >= 0 as text with two decimals, rounded by its exact binary value, halves to even.

    The doubled hundreds of x are compared with the odd number in the middle: x is split
    into two parts of which the products by 200 are exact.
    """
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    low = F.floor(x * 100).cast("double")
    over = (high * 200 - (2 * low + 1)) + (x - high) * 200
    cents = F.when(over > 0, low + 1).when((over == 0) & (low % 2 == 1), low + 1).otherwise(low).cast("long")
    return F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a name that only begins with a dot has none."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def parent(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def suffix(path: Column) -> Column:
    """The last suffix with its dot, or an empty text."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def without_suffix(path: Column) -> Column:
    """path without the last suffix of its last part."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def output_key(path: Column, root: str) -> Column:
    """The path below root without suffix, else <parent>_<stem>."""
    inside = without_suffix(F.substring(path, len(root) + 2, 1 << 30))
    return F.when(path.startswith(root + "/"), inside).otherwise(F.concat_ws("_", parent(path), stem(path)))


def drop_segment(path: Column, name: str) -> Column:
    return F.array_join(F.filter(F.split(path, "/"), lambda x: x != name), "/")


def replace_first(text: Column, old: str, new: str) -> Column:
    """text with the first occurrence of old replaced."""
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, F.lit(new), at, F.lit(len(old)))).otherwise(text)


def clip_key_of(path: Column, dataset: Column) -> Column:
    """realtalk: <parent>_<stem>; seamless: <stem>. Another dataset is an error, and so is a realtalk path without parent."""
    short = F.raise_error(F.concat(F.lit("no parent in "), path))
    realtalk = F.when(parent(path).isNull(), short).otherwise(F.concat_ws("_", parent(path), stem(path)))
    return F.when(dataset == "realtalk", realtalk).when(dataset == "seamless", stem(path)).otherwise(F.raise_error(F.concat(F.lit("unknown dataset "), dataset)))


def prefix_and_end(name: Column) -> tuple[Column, Column]:
    """The name up to its last underscore, and what follows; null if either is missing."""
    found = r"^(.+_)([^_]+)$"
    return F.nullif(F.regexp_extract(name, found, 1), F.lit("")), F.nullif(F.regexp_extract(name, found, 2), F.lit(""))


def euler_degrees(m: str) -> Column:
    """A struct of pitch, roll and yaw of a row-major 3 x 3 (or 4 x 4, by rows) rotation in array column m."""
    at = lambda r, c: F.element_at(F.element_at(m, r + 1), c + 1)
    sy = F.sqrt(at(0, 0) * at(0, 0) + at(1, 0) * at(1, 0))
    flat = sy < 1e-6
    pitch = F.when(flat, F.atan2(-at(1, 2), at(1, 1))).otherwise(F.atan2(at(2, 1), at(2, 2)))
    roll = F.when(flat, F.lit(0.0)).otherwise(F.atan2(at(1, 0), at(0, 0)))
    return F.struct(F.degrees(pitch).alias("pitch"), F.degrees(roll).alias("roll"), F.degrees(F.atan2(-at(2, 0), sy)).alias("yaw"))


def bounding_box(points: str, width: int, height: int) -> tuple[Column, Column]:
    """Least and greatest x and y of an array of points, limited to [0, 1], and in whole pixels, halves to even.
    Without points both are null."""
    some = F.coalesce(F.size(points) > 0, F.lit(False))
    side = lambda pick, i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), pick(F.transform(points, lambda p: p[i]))))
    box = F.array(side(F.array_min, 0), side(F.array_min, 1), side(F.array_max, 0), side(F.array_max, 1))
    scale = F.array(*(F.lit(float(v)) for v in (width, height, width, height)))
    return F.when(some, box), F.when(some, F.transform(F.zip_with(box, scale, lambda a, b: F.rint(a * b)), lambda v: v.cast("int")))


def au04_proxy(blendshapes: str) -> Column:
    """The mean of the shapes that lower the brows, a missing one counting as 0; null without shapes."""
    shape = lambda k: F.coalesce(F.col(blendshapes)[k], F.lit(0.0))
    return F.when(F.coalesce(F.size(blendshapes) > 0, F.lit(False)), (shape("browDownLeft") + shape("browDownRight")) / 2)


def half_precision(x: Column) -> Column:
    """x rounded to what a half-precision float holds, by way of single precision; beyond its range infinite."""
    x = x.cast("float").cast("double")
    size = F.abs(x)
    ulp = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)).cast("double"), F.lit(-14.0)) - 10)
    held = F.when(size >= 65520, F.lit(float("inf"))).when(size == 0, F.lit(0.0)).otherwise(F.rint(size / ulp) * ulp)
    return F.when(F.isnan(x), x).when(x < 0, -held).otherwise(held)

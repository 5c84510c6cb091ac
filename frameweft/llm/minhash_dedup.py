"""Near-duplicate documents: minima of many universal hashes, banding, exact confirmation and components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import fresh, materialize
from .textops import LOWER, U64, bytes_of, hash_runs, hash_words, mix, ranges, slices, split_words


@dataclass(frozen=True)
class NearConfig:
    """similar: links have at least this share of the union in common, in percent.

    With bands of rows minima each, a pair at 80 % is missed with probability
    (1 - .8**rows)**bands: 5e-8 as given. bins: minima of the second signature,
    one for each part of the hashes' range; what falls short of similar there by
    more than sigmas standard deviations isn't compared any further. block: the
    rows of a bucket that are compared with one another at a time.
    """

    shingle: int = 5
    similar: int = 80
    bands: int = 32
    rows: int = 4
    bins: int = 1024
    sigmas: float = 6.0
    block: int = 512
    seed: int = 20

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.bands * self.rows
        return rng.integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's k-word shingles, and the offsets of each text's.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    data = LOWER[data]
    starts, ends, of_text = split_words(data, at)
    words, count = hash_words(data, starts, ends), np.diff(of_text)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.zeros(int(n.sum()), U64)
    offsets = np.concatenate([[0], np.cumsum(n)])
    for size in range(1, k + 1):
        texts = np.flatnonzero(count == size if size < k else count >= k)
        if len(texts):
            out[ranges(offsets[texts], n[texts])] = mix(hash_runs(words, size) ^ U64(size * 0x9E3779B9))[ranges(of_text[texts], n[texts])]
    return out, offsets


def _signatures(cfg: NearConfig):
    """id, row_hash, size of the set, its digest, and a key for each band of its minima."""
    a, b = cfg.hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch, "text", 1 << 20):
                marks, offsets = shingles(data, at, cfg.shingle)
                sizes, digests = [], []
                for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = np.unique(marks[lo:hi])
                    sizes.append(len(own))
                    digests.append(hashlib.md5(own.tobytes(), usedforsecurity=False).digest())
                digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                full = np.flatnonzero(np.diff(offsets) > 0)
                minima = np.zeros((len(a), rows.num_rows), U64)
                low, x = marks & U64(0xFFFFFFFF), np.empty_like(marks)
                for j in range(len(a) if len(full) else 0):
                    np.multiply(low, a[j], out=x)
                    x += b[j]
                    minima[j, full] = np.minimum.reduceat(x, offsets[full])
                minima >>= U64(32)
                keys = np.zeros((rows.num_rows, cfg.bands), U64)
                for band in range(cfg.bands):
                    key = np.full(rows.num_rows, band + 1, U64)
                    for j in range(band * cfg.rows, (band + 1) * cfg.rows):
                        key = mix(key * U64(0x9E3779B97F4A7C15) ^ minima[j])
                    keys[:, band] = key
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array(sizes, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, cfg.bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))],
                    ["id", "row_hash", "n", "high", "low", "bands"],
                )

    return run


def _sketches(cfg: NearConfig):
    """id, size of the set, and a byte of the least hash in each of cfg.bins parts of the range; 0: none."""
    shift = U64(64 - (cfg.bins - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch, "text"):
                marks, offsets = shingles(data, at, cfg.shingle)
                sizes, out = [], []
                for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = np.unique(marks[lo:hi])
                    part = (own >> shift).astype(np.int64)
                    least = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(own) else np.zeros(0, np.int64)
                    sketch = np.zeros(cfg.bins, np.uint8)
                    sketch[part[least]] = (mix(own[least]) % U64(255)).astype(np.uint8) + 1
                    sizes.append(len(own))
                    out.append(sketch.tobytes())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["id", "n", "sketch"])

    return run


_GROUP = ["key", "lo", "hi"]
_DEALT = [*_GROUP, "id", "part", "own", "n", "sketch", "bands", "pivot", "apart"]


def _agreeing(cfg: NearConfig):
    """Of rows sorted by (key, lo, hi): pairs of different components that may be similar enough.

    A group is one bucket or two of its blocks, of about 2 * cfg.block rows at
    most. A pair counts in the first of the buckets that hold both. It is ruled
    out by the sizes of the sets; by their sketches, where agreement over the
    bins that either fills is an unbiased estimate from a sample of the union
    without replacement; or by the distances from a pivot that both were
    compared with, as these obey the triangle inequality.
    """
    limit = cfg.similar / 100

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        cols = dict(zip(_DEALT, zip(*rows, strict=True), strict=True))
        key, lo, hi = (cols[k][0] for k in _GROUP)
        ids, parts, own, n = (np.array(cols[k], np.int64) for k in ("id", "part", "own", "n"))
        pivot, apart = np.array([x or 0 for x in cols["pivot"]], np.int64), np.array([np.nan if x is None else x for x in cols["apart"]])
        sketch = np.frombuffer(b"".join(cols["sketch"]), np.uint8).reshape(len(rows), -1)
        bands = np.array(cols["bands"], np.int64)
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        for i in left.tolist():
            other = right[(parts[right] != parts[i]) & ((ids[right] > ids[i]) | (lo != hi))]
            other = other[100 * np.minimum(n[other], n[i]) >= cfg.similar * np.maximum(n[other], n[i])]
            far = (pivot[other] == pivot[i]) & (np.abs(apart[other] - apart[i]) > 1 - limit + 1e-9)
            other = other[~far]
            if not len(other):
                continue
            filled = ((sketch[other] | sketch[i]) != 0).sum(axis=1)
            alike = ((sketch[other] == sketch[i]) & (sketch[i] != 0)).sum(axis=1)
            union = np.maximum((n[other] + n[i]) / (1 + limit), filled)
            slack = cfg.sigmas * np.sqrt(limit * (1 - limit) / filled * np.maximum(1 - filled / union, 0)) + 2 / filled
            other = other[alike >= (limit - slack) * filled]
            if len(other):
                other = other[bands[i][np.argmax(bands[other] == bands[i], axis=1)] == key]
            for j in other.tolist():
                yield min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    found += pairs(held)
                    held = []
                held.append(row)
            yield _pairs(found)
        if held:
            yield _pairs(list(pairs(held)))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    array = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(array[:, 0]), pa.array(array[:, 1])], ["a", "b"])


def _confirmed(cfg: NearConfig):
    """For rows (a, b, text of a, text of b): how far their whole sets are apart, and whether they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = batch.slice(lo, 64)
                x, x_at = shingles(*bytes_of(rows.column(2)), cfg.shingle)
                y, y_at = shingles(*bytes_of(rows.column(3)), cfg.shingle)
                apart, linked = [], []
                for i in range(rows.num_rows):
                    p, q = np.unique(x[x_at[i] : x_at[i + 1]]), np.unique(y[y_at[i] : y_at[i + 1]])
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    either = len(p) + len(q) - both
                    apart.append(1 - both / max(either, 1))
                    linked.append(both > 0 and 100 * both >= cfg.similar * either)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(apart, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "apart", "linked"])

    return run


def _compared(pairs: DataFrame, texts: DataFrame, cfg: NearConfig, label: str) -> DataFrame:
    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return materialize(both.mapInArrow(_confirmed(cfg), "a long, b long, apart double, linked boolean"), label)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", cfg: NearConfig = NearConfig()) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept, row_hash.

    A-Z are lower-cased, words are split at [\\x20\\x09-\\x0D], and a document's
    set has its distinct shingles of cfg.shingle words, as 64-bit hashes. Two
    documents are linked if their sets have cfg.similar percent of the union in
    common; component_id is the smallest id that links reach.

    Equal sets are one class from the start, by a 128-bit digest, so copies never
    meet in pairs. Classes fall into buckets by band. A bucket's pivot is the class
    whose buckets are largest, which the original of many copies tends to be.
    First each class is compared with the pivot that it shares most bands with;
    then, in buckets that still hold several components, classes of different
    components, in blocks of rows so that no task holds a whole bucket. There a
    signature rules out what can't be similar, see _agreeing(). What it leaves is
    compared on whole sets. Components join by large-star and small-star steps
    after either round.

    Null and empty texts, and texts of white space only, have an empty set and
    are linked with nothing. Rows with a null id aren't linked either: their
    component_id is null and they are kept. Rows that repeat an id are one
    document if their texts are equal, else each has its own links under that id.
    An empty table gives an empty result; extra columns aren't read.
    """
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("row_hash"))
    signed = materialize(source.mapInArrow(_signatures(cfg), "id long, row_hash long, n long, high long, low long, bands array<long>"), "signatures")
    classes = signed.where("n > 0 and id is not null").groupBy("high", "low").agg(F.min(F.struct("id", "row_hash")).alias("best"), F.any_value("bands").alias("bands"))
    # from here to the components a class goes by a number of its own: two classes may have one id
    classes = materialize(classes.select("high", "low", F.col("best.id").alias("doc"), "best.row_hash", "bands", F.monotonically_increasing_id().alias("id")), "classes")
    banded = classes.select("id", "doc", "row_hash", F.explode("bands").alias("key"))
    sizes = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    members = materialize(banded.join(sizes, "key"), "members")
    wanted = members.select("id", "doc", "row_hash").distinct()
    texts = materialize(source.withColumnRenamed("id", "doc").join(wanted, ["doc", "row_hash"]).select("id", "text").dropDuplicates(["id"]), "texts")

    degrees = members.groupBy("id").agg(F.sum("size").alias("degree"))
    pivots = materialize(members.join(degrees, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", F.bitwise_not("id"))).alias("pivot")), "pivots")
    shared = members.join(pivots, "key").where("id <> pivot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("bands"))
    best = shared.groupBy("id").agg(F.max_by("pivot", F.struct("bands", F.bitwise_not("pivot"))).alias("pivot"))
    first = _compared(best.select(F.col("id").alias("a"), F.col("pivot").alias("b")), texts, cfg, "first-pairs")
    of_a, of_b = classes.select(F.col("id").alias("a"), F.col("doc").alias("doc_a")), classes.select(F.col("id").alias("b"), F.col("doc").alias("doc_b"))
    linked = lambda pairs: pairs.where("linked").select("a", "b").join(of_a, "a").join(of_b, "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    links = linked(first)
    parts = materialize(connected_components(links).withColumnRenamed("id", "doc"), "components")

    placed = materialize(members.select("key", "id", "doc", "size").join(parts, "doc", "left").select("key", "id", "size", F.coalesce("component", "doc").alias("part")), "placed")
    mixed = materialize(placed.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("key"), "mixed")
    unsettled = materialize(placed.join(mixed, "key"), "unsettled")
    from_pivot = first.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "apart").unionByName(first.select(F.col("b").alias("id"), F.col("b").alias("pivot"), F.lit(0.0).alias("apart")).distinct())
    # a pivot of others may have a pivot of its own; one of the two will do
    from_pivot = from_pivot.groupBy("id").agg(F.min_by(F.struct("pivot", "apart"), F.struct("apart", "pivot")).alias("p")).select("id", "p.pivot", "p.apart")
    sketched = texts.join(unsettled.select("id").distinct(), "id").select("id", "text").mapInArrow(_sketches(cfg), "id long, n long, sketch binary")
    sketched = materialize(sketched.join(classes.select("id", "bands"), "id").join(from_pivot, "id", "left"), "sketches")
    blocks = F.ceil(F.col("size") / cfg.block).cast("int")
    dealt = unsettled.select("key", "id", "part", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "part", "own").join(sketched, "id").select(*_DEALT)
    more = dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_agreeing(cfg), "a long, b long")
    second = _compared(more, texts, cfg, "second-pairs")
    parts = materialize(connected_components(links.unionByName(linked(second))).withColumnRenamed("id", "doc"), "components")

    named = materialize(classes.select("high", "low", "doc").join(parts, "doc", "left").select("high", "low", F.coalesce("component", "doc").alias("component_id")), "named")
    out = signed.select("id", "row_hash", F.col("n").alias("n_shingles"), "high", "low").join(named, ["high", "low"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(F.coalesce(component, "id")).alias("kept"), "row_hash")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", cfg: NearConfig = NearConfig()) -> DataFrame:
    """docs with one document of each component, with all columns; rows with a null id stay."""
    gone_id, gone_hash = fresh(docs, "_gone_id"), fresh(docs, "_gone_hash")
    gone = near_duplicates(docs, id, text, cfg).where("not kept").select(F.col(id).alias(gone_id), F.col("row_hash").alias(gone_hash))
    return docs.join(gone, (F.col(id).cast("long") == F.col(gone_id)) & (F.xxhash64(F.col(text)) == F.col(gone_hash)), "left_anti")

"""Exact deduplication by 128-bit content hash, with the bytes compared inside groups."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, materialize, release
from .textops import SPACE_BYTES, bytes_of

Digest = Callable[[bytes], bytes]
#: Parts into which the texts of one digest are dealt for the comparison of bytes.
SALTS = 16
#: Bits of the filter of repeated digests, as a power of two: 8 MB at any size of the table.
FILTER_BITS = 26


def md5(body: bytes) -> bytes:
    return hashlib.md5(body, usedforsecurity=False).digest()


def _bodies(column: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """Each whole text and what is left of it without white space."""
    data, at = bytes_of(column)
    raw = data.tobytes()
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        text = raw[lo:hi]
        yield text, text.translate(None, SPACE_BYTES)


def _slot(digest: bytes) -> int:
    """The bit of the filter that a digest sets."""
    return int.from_bytes(digest[:4].ljust(4, b"\0"), "big") >> (32 - FILTER_BITS)


def _keys(digest: Digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, chars, shas = [], [], []
            for text, body in _bodies(batch.column(1)):
                keys.append(digest(body))
                chars.append(len(text) if text.isascii() else len(text.decode("utf-8", "replace")))
                shas.append(hashlib.sha256(body).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(map(_slot, keys), pa.int32()), pa.array(chars, pa.int64()), pa.array(shas, pa.string())], ["id", "row_hash", "digest", "slot", "chars", "text_sha256"])

    return run


def _texts(digest: Digest, shared):
    """The bodies whose digest the filter has: those of all groups of several rows, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows, keys, bodies = [], [], []
            for i, (_, body) in enumerate(_bodies(batch.column(1))):
                key = digest(body)
                slot = _slot(key)
                if bits[slot >> 3] >> (slot & 7) & 1:
                    rows.append(i)
                    keys.append(key)
                    bodies.append(body)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(keys, pa.binary()), pa.array([i % SALTS for i in rows], pa.int32()), pa.array(bodies, pa.binary())], ["id", "row_hash", "digest", "salt", "body"])

    return run


def _filter(groups: DataFrame) -> np.ndarray:
    """The bits of the groups' digests. Executors set them, 64 at a time; what reaches the driver has the filter's size at most."""
    words = groups.groupBy((F.col("slot").bitwiseAND(F.lit((1 << FILTER_BITS) - 64))).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), "<i8")
    out[words.column("at").to_numpy() >> 6] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _keepers(rows: DataFrame, *key: str) -> DataFrame:
    """Per key: the row with the most code points, then the smallest id, and the size.

    ~id turns the order of ids round without overflow; a null id comes last.
    """
    best = F.max(F.struct("chars", F.bitwise_not("id").alias("turned")))
    return rows.groupBy(*key).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(*key, F.bitwise_not("best.turned").alias("keep_id"), "group_size")


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", digest: Digest = md5) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, row_hash.

    Texts are equal if they are identical without the characters of
    [\\x20\\x09-\\x0D]. Of equal texts the row with the most code points stays,
    then the one with the smallest id. row_hash is xxhash64 of the original text.

    Digests are aggregated on the map side, so a group of any size reaches the
    shuffle as one row per task. Then the texts of groups of several rows, which a filter
    of 8 MB picks at the scan, with few others as long as the groups are few beside its bits, dealt
    out by digest and salt, give each group's least and greatest bytes: where
    these differ the digest has collided, and its rows are grouped by the whole
    bytes instead. The table of such groups is written before rows join it, so
    that both sides come from a shuffle and Spark can split a frequent digest.

    A null text counts as empty, and empty texts form one group like any other.
    A null id keeps its row in its group, but loses every tie; a group of only
    such rows has a null keep_id and keeps all of them. Rows that repeat an id
    count in group_size, and are kept together. Of other columns none is read.
    An empty table gives an empty result.
    """
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("row_hash"))
    rows = materialize(source.mapInArrow(_keys(digest), "id long, row_hash long, digest binary, slot int, chars long, text_sha256 string"), "digests")
    groups = materialize(_keepers(rows, "digest", "slot").where("group_size > 1"), "groups")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(groups))
    groups = groups.drop("slot")
    several = groups.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    texts = source.mapInArrow(_texts(digest, shared), "id long, row_hash long, digest binary, salt int, body binary")
    compared = texts.join(several.hint("merge"), ["digest", "salt"]).groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    collided = materialize(compared.where("least != most").select("digest"), "collided")
    shared.destroy()
    out = rows.drop("slot").join(groups, "digest", "left")
    if not collided.isEmpty():
        apart = _by_bytes(source, collided, digest)
        out = out.join(collided, "digest", "left_anti").select(apart.columns).unionByName(apart)
    else:
        release(collided)
    alone = F.col("group_size").isNull()
    keep_id, group_size = F.when(alone, F.col("id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1).cast("long"))
    return out.select(F.col("id").alias(id), keep_id.alias("keep_id"), group_size.alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), "text_sha256", "row_hash")


def _by_bytes(source: DataFrame, collided: DataFrame, digest: Digest) -> DataFrame:
    """The rows of collided digests, grouped by their whole bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(_bodies(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([digest(b) for _, b in both], pa.binary()), pa.array([len(t.decode("utf-8", "replace")) for t, _ in both], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for _, b in both], pa.string()), pa.array([b for _, b in both], pa.binary())], ["id", "row_hash", "digest", "chars", "text_sha256", "body"])

    rows = source.mapInArrow(run, "id long, row_hash long, digest binary, chars long, text_sha256 string, body binary").join(collided, "digest")
    return rows.join(_keepers(rows, "body"), "body").select("id", "keep_id", "group_size", "text_sha256", "row_hash")


def drop_exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates() drops, with all columns.

    A dropped row is found by id and row_hash; a row with a null id stays, and rows
    that repeat the id and text of the one that stays do too. A null text counts as
    empty: of null and empty texts one stays. An empty table gives an empty result;
    other columns are kept, whatever their names.
    """
    gone_id, gone_hash = fresh(docs, "_gone_id"), fresh(docs, "_gone_hash")
    gone = exact_duplicates(docs, id, text).where("not kept").select(F.col(id).alias(gone_id), F.col("row_hash").alias(gone_hash))
    return docs.join(gone, (F.col(id).cast("long") == F.col(gone_id)) & (F.xxhash64(F.col(text)) == F.col(gone_hash)), "left_anti")

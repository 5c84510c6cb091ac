"""Substring deduplication by hashing lines and their sentences: later copies go, with their offsets kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, materialize
from .textops import LOWER, U64, _powers, char_index, hash_words, mix, slices, split_words

_BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
SCHEMA = "id long, row_hash long, unit_no int, start int, end int, n_words int, high long, low long"
#: What ends a line, and what a word ends with that ends a sentence.
LINE_ENDS, SENTENCE_ENDS = b"\n\x0b\x0c\r", b".!?"


def unit_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """The numbers of the words with which units begin: the first of a text, of a line, and after a sentence's end."""
    line, sentence = np.zeros(256, bool), np.zeros(256, bool)
    line[list(LINE_ENDS)] = True
    sentence[list(SENTENCE_ENDS)] = True
    breaks = np.flatnonzero(line[data])
    first = np.zeros(len(starts), bool)
    first[of_text[:-1][np.diff(of_text) > 0]] = True
    first[1:] |= np.diff(np.searchsorted(breaks, starts)) > 0
    first[1:] |= sentence[data[ends[:-1] - 1]]
    return np.flatnonzero(first)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, text, row_hash) per unit its place, code points and 128-bit digest."""
    for batch in batches:
        for rows, data, at in slices(batch, "text"):
            starts, ends, of_text = split_words(data, at)
            if not len(starts):
                continue
            lo = unit_starts(data, starts, ends, of_text)
            hi = np.r_[lo[1:], len(starts)]
            words = hash_words(LOWER[data], starts, ends)
            digests = []
            for base, x in zip(_BASES, (words, mix(words ^ U64(_BASES[1]))), strict=True):
                up, down = _powers(base, len(words) + 1)
                total = np.zeros(len(x) + 1, U64)
                np.cumsum(x * up[: len(x)], out=total[1:])
                digests.append(mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(U64)).view(np.int64))
            text_no = np.searchsorted(of_text, lo, side="right") - 1
            chars = char_index(data)
            base_char = chars[at[text_no]]
            unit_no = np.arange(len(lo)) - np.searchsorted(lo, of_text[text_no])
            take = pa.array(text_no)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(take), rows.column(2).take(take), *(pa.array(x.astype(np.int32)) for x in (unit_no, chars[starts[lo]] - base_char, chars[ends[hi - 1]] - base_char, hi - lo)), pa.array(digests[0]), pa.array(digests[1])],
                ["id", "row_hash", "unit_no", "start", "end", "n_words", "high", "low"],
            )


def repeated_units(docs: DataFrame, id: str = "doc_id", text: str = "text", min_run: int = 1) -> DataFrame:
    r"""One row per repeated unit: id, unit_no, start, end, n_words, kept, first_id, first_unit, copies, run_words.

    A unit is a line or a sentence of one: it ends where a line does, at [\x0A-\x0D],
    and after a word that ends in one of .!? . Two units are equal if their words,
    split at [\x20\x09-\x0D] with A-Z in lower case, are. A unit is repeated if an
    equal one is anywhere, in this text or another. Of equal units the one with the
    smallest (id, unit_no) is kept, the others may go: kept is false for them.
    first_id and first_unit name the kept one, copies counts all of them. start and
    end are code points of the original text, from the first to the last word, end
    exclusive; unit_no counts all of a text's units from 0.

    Units that follow each other in a text and are all repeated form a run, of run_words
    words. Runs of fewer than min_run words are left out, whatever units they hold;
    so a repeated passage is found though its lines and sentences are short, and a
    heading that stands alone is not. With 1 every repeated unit is returned.

    Digests of 128 bits are aggregated on the map side, so a line that a third of
    all texts hold costs a row per task; the join that follows has one row per
    digest on one side, and its other side is split where a digest is frequent
    (both sides come from a shuffle, as that table is written first).

    A null or empty text has no units. Texts with a null id are left alone, as
    nothing could name what is removed. Rows that repeat an id are further
    occurrences: of equal (id, unit_no) all but the stated one stay, as they are
    the same unit; texts that differ under one id have their own runs. An empty table
    gives an empty result; extra columns aren't read.
    """
    source = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("row_hash"))
    units = materialize(source.mapInArrow(_units, SCHEMA), "units")
    first = F.min(F.struct("id", "unit_no"))
    groups = units.groupBy("high", "low").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = materialize(groups.select("high", "low", F.col("first.id").alias("first_id"), F.col("first.unit_no").alias("first_unit"), "copies"), "repeated")
    found = units.join(groups, ["high", "low"]).drop("high", "low")
    if min_run > 1:
        row = ["id", "row_hash"]
        found = found.withColumn("run", F.col("unit_no") - F.dense_rank().over(Window.partitionBy(*row).orderBy("unit_no")))
        found = found.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy(*row, "run", "unit_no")))
        words = F.sum(F.col("n_words") / F.col("same")).over(Window.partitionBy(*row, "run"))
        found = found.withColumn("run_words", F.round(words).cast("int")).where(F.col("run_words") >= min_run)
    else:
        found = found.withColumn("run_words", F.col("n_words"))
    kept = (F.col("id") == F.col("first_id")) & (F.col("unit_no") == F.col("first_unit"))
    return found.select(F.col("id").alias(id), "unit_no", "start", "end", "n_words", kept.alias("kept"), "first_id", "first_unit", "copies", "run_words")


def remove_spans(docs: DataFrame, spans: DataFrame, id: str = "doc_id", text: str = "text", out: str = "kept_spans") -> DataFrame:
    """docs with the spans (id, start, end) cut out of their texts.

    A further column, out, lists what is left as (start, end) in code points of the
    original text; a column of docs that has this name is replaced. Spans may overlap. A
    text without spans stays as it is; its list is null if the text is. Rows with a null id
    stay as they are, rows that repeat an id lose the same spans, and an empty table gives
    an empty result.
    """
    cut_id, cuts = fresh(docs, "_cut_id"), fresh(docs, "_cuts")
    own = spans.where(F.col(id).isNotNull()).groupBy(F.col(id).alias(cut_id)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(cuts))
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("kept"))

    def step(acc, cut):
        free = F.when(cut["start"] > acc["at"], F.array(F.struct(acc["at"].alias("start"), cut["start"].alias("end")))).otherwise(none)
        return F.struct(F.greatest(acc["at"], cut["end"]).alias("at"), F.concat(acc["kept"], free).alias("kept"))

    length = F.char_length(F.col(text))
    walked = F.aggregate(F.concat(F.coalesce(cuts, none), F.array(F.struct(length.alias("start"), length.alias("end")))), zero, step, lambda acc: acc["kept"])
    joined = docs.join(own, F.col(id) == F.col(cut_id), "left").withColumn(out, F.when(F.col(text).isNotNull(), walked))
    left = F.array_join(F.transform(out, lambda s: F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])), "")
    return joined.withColumn(text, F.when(F.col(cuts).isNull(), F.col(text)).otherwise(left)).drop(cut_id, cuts)

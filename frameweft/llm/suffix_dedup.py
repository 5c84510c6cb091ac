"""Repeated passages by a sparse suffix array over content-selected word positions.

Of each text only the suffixes at minimiser positions are retained: position p
is a minimiser if the hash of the three words from p is the smallest of some
window of WINDOW successive positions. The smallest of the WINDOW positions with
which a passage of min_words words begins is retained wherever the passage occurs, and
from there on all its occurrences agree over min_words - WINDOW + 1 words, the prefix.

The retained suffixes are sorted globally by their prefix, which goes by its hash, then
by text and position. Neighbours with equal prefixes are matches. Matches of a text
with one other text that follow each other at the same distance join into a track: its
words are the other's, from the first prefix to the last. That settles the inside of long
repeats. At the ends, and where tracks are short or change, matches are
extended left and right together: every run of min_words words that may hold is looked up by
a 128-bit digest among all occurrences of the suffix in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release
from .textops import U64, char_index, hash_runs, hash_words, mix, slices, split_words

WINDOW = 16
_GRAM = 3
_BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _least(words: np.ndarray, text_no: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The three-word hashes, and for each position the smallest of its window; 0 where that isn't within one text."""
    grams = hash_runs(words, _GRAM, base=0x2545F4914F6CDD1D)
    if len(grams) < window:
        return grams, np.zeros(0, U64)
    least, k = grams, 1
    while 2 * k <= window:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    if k < window:
        least = np.minimum(least[: len(grams) - window + 1], least[window - k : len(grams) - k + 1])
    n, reach = len(least), window - 1 + _GRAM - 1
    return grams, np.where(text_no[:n] == text_no[reach : reach + n], least, U64(0))


def minimisers(words: np.ndarray, text_no: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions with the smallest three-word hash of any window that lies within one text."""
    grams, least = _least(words, text_no, window)
    if not len(least):
        return np.zeros(0, np.int64)
    edge = np.zeros(window - 1, U64)
    most, k = np.concatenate([edge, least, edge]), 1
    while 2 * k <= window:
        most, k = np.maximum(most[:-k], most[k:]), 2 * k
    if k < window:
        most = np.maximum(most[: len(grams)], most[window - k : window - k + len(grams)])
    return np.flatnonzero((grams == most[: len(grams)]) & (most[: len(grams)] != 0))


def _words(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    starts, ends, of_text = split_words(data, at)
    return starts, ends, of_text, hash_words(data, starts, ends), np.repeat(np.arange(rows.num_rows), np.diff(of_text))


def _suffixes(prefix: int):
    """From (id, fork, text): key, id, fork, pos of each retained suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch, "text"):
                _, _, of_text, words, text_no = _words(rows, data, at)
                keys, p = hash_runs(words, prefix), minimisers(words, text_no)
                p = p[p < len(keys)]
                p = p[text_no[p] == text_no[p + prefix - 1]]
                take = pa.array(text_no[p])
                yield pa.RecordBatch.from_arrays([pa.array(keys[p].view(np.int64)), rows.column(0).take(take), rows.column(1).take(take), pa.array((p - of_text[text_no[p]]).astype(np.int32))], ["key", "id", "fork", "pos"])

    return run


_PLACE = ("id", "fork", "pos")
_ORDER = ["key", *_PLACE]
_KINDS = {"key": np.int64, "id": np.int64, "fork": np.int32, "pos": np.int32, "first": bool, "matched": bool, "other_id": np.int64, "other_fork": np.int32, "other_pos": np.int32}
_FOUND = "key long, id long, fork int, pos int, first boolean, matched boolean, other_id long, other_fork int, other_pos int, edge boolean"


def _compare(final: bool):
    """Of suffixes in sorted order, those whose key a neighbour has.

    first: no smaller place (id, fork, pos) has the key. other: the place before it in the
    order, for the first one the place after it. The first and the last row of a
    partition are returned in any case, as edges, unless final.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        begun = False

        def out(x: dict[str, np.ndarray], upto: int, last: bool) -> pa.RecordBatch:
            edge = np.zeros(upto, bool)
            if not final and upto:
                edge[0], edge[-1] = not begun, last
            keep = x["matched"][:upto] | edge
            return pa.RecordBatch.from_arrays([*(pa.array(x[k][:upto][keep]) for k in _KINDS), pa.array(edge[keep])], [*_KINDS, "edge"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(_ORDER)}
            for k, kind in _KINDS.items():
                if k not in x:
                    there = batch.schema.get_field_index(k)
                    x[k] = batch.column(there).to_numpy(zero_copy_only=False) if there >= 0 else np.full(n, k == "first", kind)
            x = {k: np.concatenate([held[k], x[k]]) if held is not None else np.array(x[k]) for k in _KINDS}
            same = x["key"][1:] == x["key"][:-1]
            twice = same & (x["pos"][1:] == x["pos"][:-1]) & (x["id"][1:] == x["id"][:-1]) & (x["fork"][1:] == x["fork"][:-1])
            if twice.any():  # rows that repeat an id and its text
                x = {k: v[np.r_[True, ~twice]] for k, v in x.items()}
                same = x["key"][1:] == x["key"][:-1]
            after = np.flatnonzero(same & ~x["matched"][:-1])
            for k in _PLACE:
                x[f"other_{k}"][after] = x[k][after + 1]
            for k in _PLACE:
                x[f"other_{k}"][1:][same] = x[k][:-1][same]
            x["first"][1:] &= ~same
            x["matched"][1:] |= same
            x["matched"][:-1] |= same
            upto = len(x["key"]) - 1
            if upto:
                yield out(x, upto, False)
                begun = True
            held = {k: v[-1:] for k, v in x.items()}
        if held is not None:
            yield out(held, 1, True)

    return run


_MARKS = "array<struct<pos:int,key:long,first:boolean,other_id:long,other_fork:int,other_pos:int>>"
_TRACKS = "id long, fork int, tracks array<struct<x:int,y:int,removed:boolean,other:long>>, asks array<struct<key:long,offsets:int>>"
_TRACKS_ARROW = pa.schema([("id", pa.int64()), ("fork", pa.int32()), ("tracks", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("removed", pa.bool_()), ("other", pa.int64())]))), ("asks", pa.list_(pa.struct([("key", pa.int64()), ("offsets", pa.int32())])))])


def _tracks(prefix: int, min_words: int):
    """From (id, fork, marks): per text its tracks of min_words words or more, and the suffixes that they leave
    open, with the distances (a bit each) to the beginnings of runs of min_words that aren't in a track."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_, fork, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                marks = marks.values
                col = {k: marks.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "key", "first", "other_id", "other_fork", "other_pos")}
                order = np.argsort(col["pos"], kind="stable")
                col = {k: v[order] for k, v in col.items()}
                pos = col["pos"].astype(np.int64)
                away = col["other_pos"] - pos
                goes_on = (col["other_id"][1:] == col["other_id"][:-1]) & (col["other_fork"][1:] == col["other_fork"][:-1]) & (away[1:] == away[:-1]) & (pos[1:] <= pos[:-1] + prefix)
                begins = np.flatnonzero(np.r_[True, ~goes_on])
                ends = np.r_[begins[1:], len(pos)] - 1
                x, y = pos[begins], pos[ends] + prefix
                of = np.repeat(np.arange(len(begins)), ends - begins + 1)
                offsets = np.zeros(len(pos), np.int64)
                for a in range(WINDOW):
                    p = pos - a
                    offsets |= ((p >= 0) & ((p < x[of]) | (p + min_words > y[of]))).astype(np.int64) << a
                long, open_ = y - x >= min_words, np.flatnonzero(offsets)
                own = [{"x": int(x[k]), "y": int(y[k]), "removed": not bool(col["first"][begins[k]]), "other": int(col["other_id"][begins[k]])} for k in np.flatnonzero(long)]
                asks = [{"key": k, "offsets": o} for k, o in zip(col["key"][open_].tolist(), offsets[open_].tolist(), strict=True)]
                out.append((id_, fork, own, asks))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _TRACKS_ARROW, strict=True)], schema=_TRACKS_ARROW)

    return run


_SPAN = [("x", "int"), ("y", "int"), ("start", "int"), ("end", "int"), ("before", "int"), ("after", "int")]
_RUNS = "id long, fork int, " + ", ".join(f"`{n}` {t}" for n, t in _SPAN) + ", high long, low long, removed boolean, other long"


def _runs(prefix: int, min_words: int):
    """From (id, fork, text, tracks, members): a row for each track, and one with its digest for each run of
    min_words words that a member, a suffix with the distances that some text asks for, is the smallest of.

    x and y are words, start and end their code points; before is where the word before x ends, after
    where that after y begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in slices(batch, "text"):
                starts, ends, of_text, words, text_no = _words(rows, data, at)
                keys, (grams, least) = hash_runs(words, prefix).view(np.int64), _least(words, text_no)
                digests = [hash_runs(w, min_words, base).view(np.int64) for base, w in zip(_BASES, (words, mix(words ^ U64(_BASES[1]))), strict=True)]
                chars = char_index(data)
                text, x, y, removed, other, tracked = ([] for _ in range(6))
                for i in range(rows.num_rows):
                    lo, hi = int(of_text[i]), int(of_text[i + 1])
                    tracks, members = rows.column(3)[i].values, rows.column(4)[i].values
                    if tracks is not None and len(tracks):
                        u, v = (tracks.field(k).to_numpy().astype(np.int64) + lo for k in ("x", "y"))
                        fits = v <= hi  # else of another text that goes by this id and fork
                        text += [i] * int(fits.sum())
                        x.append(u[fits])
                        y.append(v[fits])
                        removed += tracks.field("removed").to_numpy(zero_copy_only=False)[fits].tolist()
                        other += tracks.field("other").to_numpy()[fits].tolist()
                        tracked += [True] * int(fits.sum())
                    if members is not None and len(members):
                        m, key, offsets = (members.field(k).to_numpy().astype(np.int64) for k in ("pos", "key", "offsets"))
                        m = m + lo
                        fits = np.flatnonzero(m + prefix <= hi)
                        fits = fits[keys[m[fits]] == key[fits]]
                        begins = []
                        for a in range(WINDOW):
                            p = m[fits][(offsets[fits] >> a & 1) == 1] - a
                            p = p[(p >= lo) & (p + min_words <= hi)]
                            begins.append(p[grams[p + a] == least[p]])
                        p = np.unique(np.concatenate(begins))
                        text += [i] * len(p)
                        x.append(p)
                        y.append(p + min_words)
                        removed += [None] * len(p)
                        other += [None] * len(p)
                        tracked += [False] * len(p)
                if not text:
                    continue
                text, x, y, tracked = np.array(text), np.concatenate(x), np.concatenate(y), np.array(tracked)
                lo, hi, base = of_text[text], of_text[text + 1], chars[at[text]]
                before = np.where(x > lo, chars[ends[np.maximum(x - 1, 0)]] - base, 0)
                after = np.where(y < hi, chars[starts[np.minimum(y, len(starts) - 1)]] - base, chars[ends[y - 1]] - base)
                digest = [np.where(tracked, 0, d[np.minimum(x, len(d) - 1)]) if len(d) else np.zeros(len(x), np.int64) for d in digests]
                take = pa.array(text)
                ints = [x - lo, y - lo, chars[starts[x]] - base, chars[ends[y - 1]] - base, before, after]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), *(pa.array(v.astype(np.int32)) for v in ints), *(pa.array(d, mask=tracked) for d in digest), pa.array(removed, pa.bool_()), pa.array(other, pa.int64())], ["id", "fork", *(n for n, _ in _SPAN), "high", "low", "removed", "other"])

    return run


_PARTS = "id long, start int, end int, n_words int, kept boolean, other_id long, passage_words int"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, spans): the parts of each text's passages. A passage is a run of words that spans cover; it is
    parted into what some removed span covers and the rest."""
    for batch in batches:
        out: list[tuple] = []
        for id_, spans in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            spans = spans.values
            x, y, start, end, before, after, other = (spans.field(k).to_numpy().astype(np.int64) for k in ("x", "y", "start", "end", "before", "after", "other"))
            removed = spans.field("removed").to_numpy(zero_copy_only=False).astype(bool)
            first, last = dict(zip(x.tolist(), start.tolist(), strict=True)), dict(zip(y.tolist(), end.tolist(), strict=True))
            ended, next_ = dict(zip(x.tolist(), before.tolist(), strict=True)), dict(zip(y.tolist(), after.tolist(), strict=True))

            def merged(some: np.ndarray) -> list[tuple[int, int, int]]:
                """Spans that meet, joined: from, to, and the other text of the first."""
                order = some[np.lexsort((-y[some], x[some]))]
                if not len(order):
                    return []
                reach = np.maximum.accumulate(y[order])
                begins = np.flatnonzero(np.r_[True, x[order][1:] > reach[:-1]])
                return list(zip(x[order][begins].tolist(), reach[np.r_[begins[1:], len(order)] - 1].tolist(), other[order][begins].tolist(), strict=True))

            gone = merged(np.flatnonzero(removed))
            for lo, hi, partner in merged(np.arange(len(x))):
                at = lo
                for a, b, o in [g for g in gone if lo <= g[0] < hi]:
                    if at < a:
                        out.append((id_, first[at] if at in first else next_[at], ended[a], a - at, True, partner, hi - lo))
                    out.append((id_, first[a], last[b], b - a, False, o, hi - lo))
                    at = b
                if at < hi:
                    out.append((id_, first[at] if at in first else next_[at], last[hi], hi - at, True, partner, hi - lo))
        cols = list(zip(*out, strict=True)) or [[]] * 7
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "start", "end", "n_words", "kept", "other_id", "passage_words"])


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    r"""One row per passage or part of one: id, start, end, n_words, kept, other_id, passage_words.

    Words are split at [\x20\x09-\x0D] and compared as they are. A run of min_words words that
    occurs elsewhere too, in another text or in another place of this one, is
    repeated. A passage is a run of words in which every word lies in a repeated run: all
    such words are covered, and no others. It splits into parts: kept is false where
    a repeated run also occurs earlier, by (id, position), and true for the rest, which may
    be shorter than min_words. other_id is a text that shares the part, or a repeated run of it.
    start and end are code points, end exclusive; passage_words counts the whole passage.

    Prefixes go by 64-bit hashes, but one alone settles nothing: a track holds two
    that follow each other at least, and other runs have a digest of 128 bits.

    Sorting is by ranges of (key, id, position), so a passage that a third of all
    texts hold spreads over many tasks. Neighbours in two tasks meet in a second
    comparison of each task's first and last row. The runs of such a passage are aggregated on
    the map side, and join a table of one row per digest.

    Texts that are null, empty or shorter have no passages, nor have texts with a
    null id. Rows that repeat an id are one text if their texts are equal; else each is a text
    of its own under that id. An empty table gives an empty result; extra columns aren't read.
    """
    if min_words < WINDOW + _GRAM:
        raise ValueError(f"min_words must be {WINDOW + _GRAM} at least")
    prefix = min_words - WINDOW + 1
    source = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.shiftright(F.xxhash64(F.col(text).cast("string")), 32).cast("int").alias("fork"), F.col(text).cast("string").alias("text"))
    suffixes = materialize(source.mapInArrow(_suffixes(prefix), "key long, id long, fork int, pos int"), "suffixes")
    found = materialize(suffixes.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(_compare(False), _FOUND), "neighbours")
    release(suffixes)
    neighbours = found
    edges = found.where("edge").drop("edge").coalesce(1).sortWithinPartitions(*_ORDER).mapInArrow(_compare(True), _FOUND)
    found = found.where("not edge").unionByName(edges).drop("edge")

    marks = found.groupBy("id", "fork").agg(F.collect_list(F.struct("pos", "key", "first", "other_id", "other_fork", "other_pos")).alias("marks"))
    tracks = materialize(marks.mapInArrow(_tracks(prefix, min_words), _TRACKS), "tracks")
    asked = materialize(tracks.select(F.explode("asks").alias("a")).groupBy("a.key").agg(F.bit_or("a.offsets").alias("offsets")), "asked")
    members = found.select(*_ORDER).join(asked, "key").groupBy("id", "fork").agg(F.collect_list(F.struct("pos", "key", "offsets")).alias("members"))
    known = tracks.where("size(tracks) > 0").select("id", "fork", "tracks").join(members, ["id", "fork"], "full")
    runs = materialize(source.join(known, ["id", "fork"]).select("id", "fork", "text", "tracks", "members").mapInArrow(_runs(prefix, min_words), _RUNS), "runs")
    for df in (neighbours, tracks, asked):
        release(df)

    place = F.struct("id", "fork", "x")
    open_ = runs.where("high is not null").select("high", "low", "id", "fork", "x")
    repeated = materialize(open_.groupBy("high", "low").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most"), "repeated")
    settled = runs.where("high is not null").drop("removed", "other").join(repeated, ["high", "low"])
    settled = settled.withColumns({"removed": F.col("least") != place, "other": F.when(F.col("least") != place, F.col("least.id")).otherwise(F.col("most.id"))})
    columns = ["id", "fork", *(n for n, _ in _SPAN), "removed", "other"]
    spans = settled.select(columns).unionByName(runs.where("high is null").select(columns))
    spans = spans.groupBy("id", "fork").agg(F.collect_list(F.struct(*columns[2:])).alias("spans")).select("id", "spans")
    return spans.mapInArrow(_parts, _PARTS).withColumnRenamed("id", id)

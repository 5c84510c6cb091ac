"""Bounded-space online packing of token sequences into windows of a fixed size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .shared import materialize
from .textops import slices

_SCHEMA = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, window int"
_MERGED = 1 << 30


@dataclass(frozen=True)
class PackConfig:
    """open_windows: windows that a partition holds open. waste: the tokens of a
    window that may stay empty rather than be filled by a cut. end: the id after
    each document. merge: partitions whose leftovers one task merges."""

    size: int = 4096
    open_windows: int = 16
    waste: int = 16
    end: int = 2
    merge: int = 8


@dataclass
class _Window:
    number: int
    used: int = 0
    pieces: list[tuple] = field(default_factory=list)

    def put(self, piece: tuple) -> None:
        id_, start, length, total, raw = piece
        self.pieces.append((id_, start, length, total, self.used, raw))
        self.used += length


class _Packer:
    """Open windows, and the pieces of windows that are full or have been emitted."""

    def __init__(self, cfg: PackConfig) -> None:
        self.cfg, self.open, self.made = cfg, [], 0
        self.done: list[tuple] = []

    def _new(self) -> _Window:
        self.made += 1
        return _Window(self.made - 1)

    def _emit(self, window: _Window) -> None:
        self.done += [(*p[:4], window.number, *p[4:]) for p in window.pieces]

    def add(self, id_: int | None, start: int, total: int, raw: bytes) -> None:
        """A document's ids from start on, as bytes."""
        size, left = self.cfg.size, len(raw) // 4
        while left >= size:
            full = self._new()
            full.put((id_, start, size, total, raw[: 4 * size]))
            self._emit(full)
            raw, start, left = raw[4 * size :], start + size, left - size
        while left:
            fits = [w for w in self.open if size - w.used >= left]
            if fits:
                best = max(fits, key=lambda w: w.used)
                best.put((id_, start, left, total, raw))
                if best.used == size:
                    self._emit(best)
                    self.open.remove(best)
                return
            if len(self.open) < self.cfg.open_windows:
                self.open.append(self._new())
                continue
            fullest = max(self.open, key=lambda w: w.used)
            gap = size - fullest.used
            if gap > self.cfg.waste:
                fullest.put((id_, start, gap, total, raw[: 4 * gap]))
                raw, start, left = raw[4 * gap :], start + gap, left - gap
            self._emit(fullest)
            self.open.remove(fullest)

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def _batch(rows: list[tuple], prefix: int, window: list[int] | None = None) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    sequence = [prefix << 32 | n for n in cols[4]]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
    values = (*cols[:4], sequence, *cols[5:7], window or [None] * len(rows))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "window"])


def _pack(path: str, cfg: PackConfig):
    """Packs a partition; the pieces of windows still open at its end come with their window's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, part = load(path), _Packer(cfg), TaskContext.get().partitionId()
        end = np.array([cfg.end], "<u4").tobytes()
        for batch in batches:
            for rows, data, at in slices(batch, "text", 1 << 21):
                ids, bounds = bpe.encode(data, at)
                raw, n = np.ascontiguousarray(ids.astype("<u4")).tobytes(), (4 * bounds).tolist()
                for id_, lo, hi in zip(rows.column(0).to_pylist(), n[:-1], n[1:], strict=True):
                    packer.add(id_, 0, (hi - lo) // 4 + 1, raw[lo:hi] + end)
                yield _batch(packer.take(), part)
        left = [(w.number, (*p[:4], w.number, *p[4:])) for w in packer.open for p in w.pieces]
        yield _batch([p for _, p in left], part, [n for n, _ in left])

    return run


def _merge(cfg: PackConfig):
    """Packs the leftovers of some partitions; the last window is cut at powers of two."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        packer = _Packer(PackConfig(cfg.size, 1, 0, cfg.end))
        for id_, start, total, raw in zip(*(table.column(c).to_pylist() for c in ("id", "start", "doc_tokens", "ids")), strict=True):
            packer.add(id_, start, total, raw)
        rows = packer.take()
        pieces = [p for w in packer.open for p in w.pieces]
        left = sum(p[2] for p in pieces)
        while left:
            room = window = 1 << (left.bit_length() - 1)
            number, offset = packer.made, 0
            packer.made += 1
            while room:
                id_, start, length, total, _, raw = pieces.pop(0)
                own = min(length, room)
                rows.append((id_, start, own, total, number, offset, raw[: 4 * own]))
                if own < length:
                    pieces.insert(0, (id_, start + own, length - own, total, 0, raw[4 * own :]))
                room, offset = room - own, offset + own
            left -= window
        return pa.Table.from_batches([_batch(rows, _MERGED + key[0].as_py())])

    return run


def packed(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", cfg: PackConfig = PackConfig()) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids.

    A document is its token ids for the tokenizer file at path (see bpe.encoded)
    and cfg.end. Each id lies in exactly one piece of length ids from start on,
    and that at offset in its sequence; ids has them as little-endian unsigned
    32-bit integers. A sequence holds cfg.size ids at most.

    Each partition keeps cfg.open_windows windows open. A document's full windows
    go out at once, what is left goes into the fullest window that holds it; if
    none does, the fullest window is filled by a cut, unless cfg.waste ids or fewer
    are missing, and goes out. What is open at the end of the partitions is merged
    by groups of cfg.merge partitions; the last ids of a group form sequences of
    lengths that are powers of two. Memory is bounded by the windows of a group.

    A null or empty text is cfg.end alone. A null id and rows that repeat an id
    are packed like any other row. Very long texts span many sequences. An empty
    table gives an empty result; extra columns aren't read.
    """
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    pieces = materialize(source.mapInArrow(_pack(path, cfg), _SCHEMA), "pieces")
    merged = pieces.where("window is not null").groupBy(F.expr(f"(sequence_id >> 32) div {cfg.merge}").alias("part")).applyInArrow(_merge(cfg), _SCHEMA)
    return pieces.where("window is null").unionByName(merged).drop("window").withColumnRenamed("id", id)

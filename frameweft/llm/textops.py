"""Vectorised text kernels shared by the corpus operators.

A batch of texts is handled as one byte buffer with document offsets, so that
splitting, hashing and windowing run in numpy over millions of words at once
instead of in Python loops over single words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of the operators' contracts, [\x20\x09-\x0D].
SPACE_BYTES = b" \t\n\x0b\x0c\r"

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[list(SPACE_BYTES)] = True
#: Everything but ASCII letters and the bytes of longer UTF-8 characters.
NON_LETTER = np.ones(256, dtype=bool)
NON_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_KEEP = np.array([(1 << (8 * k)) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], dtype=U64)
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = U64(30), U64(27), U64(31), U64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of whole rows of about limit bytes of text, with each run's bytes and offsets."""
    data, at = bytes_of(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def parts(data: np.ndarray, between: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Places of data in parts of about limit bytes, none of which ends inside of a word: between tells
    the bytes that belong to none. A longer word stays whole."""
    lo, n = 0, len(data)
    while lo < n:
        hi = lo + limit
        while hi < n:
            free = np.flatnonzero(between[data[hi : hi + 4096]])
            if len(free):
                hi += int(free[0])
                break
            hi += 4096
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def split_words(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the offsets of each text's words; no word crosses two texts."""
    return split_at(separator[data], at)


def split_at(between: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """split_words() for bytes that are marked as lying between words."""
    n = len(between)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    off = np.ones(n + 2, dtype=bool)
    off[1:-1] = between
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    inside = ~off[1:-1]
    starts = np.flatnonzero(inside & (off[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (off[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of data, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    length = ends - starts
    out = mix((lanes[starts] & _KEEP[np.minimum(length, 8)]) + length.astype(U64) * _M1)
    long, at = np.flatnonzero(length > 8), 8
    while len(long):
        lane = lanes[starts[long] + at] & _KEEP[np.minimum(length[long] - at, 8)]
        out[long] = mix((out[long] ^ lane) * _M1 + _S27)
        at += 8
        long = long[length[long] > at]
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: So many powers are kept for each base; for the words of a very long text more are made and dropped.
_KEPT = 1 << 18


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least (base is odd)."""
    if base in _POWERS and n <= len(_POWERS[base][0]):
        return _POWERS[base]
    size = max(1 << 12, min(1 << int(n).bit_length(), _KEPT)) if n <= _KEPT else n
    up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    made = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size <= _KEPT:
        _POWERS[base] = made
    return made


def hash_runs(words: np.ndarray, k: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A 64-bit hash of words[i:i + k] for each i from 0 to len(words) - k, by prefix sums."""
    n = len(words)
    if n < k:
        return np.zeros(0, U64)
    up, down = _powers(base, n)
    total = np.zeros(n + 1, U64)
    np.cumsum(words * up[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])


def char_index(data: np.ndarray) -> np.ndarray:
    """For each byte position (and the end), the code points that begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)

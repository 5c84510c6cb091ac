"""BPE encoding by a pair occurrence index, and decoding.

The words that a partition adds to its cache are laid out as one array of
symbols. An index maps each mergeable pair to all its positions there; the
active ranks are applied in ascending order, each at all its positions at once,
and only the lists of the pairs that a merge creates are touched.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textops import U64, hash_words, ranges, slices, split_words

#: The most that a worker's cache holds: words, and token ids and bytes of all of these.
CACHE_WORDS, CACHE_IDS = 800_000, 16_000_000
#: What the fast split of many words at once doesn't cover: characters from
#: U+0180 on, which normalisation may join or fold, and special tokens.
_ODD = re.compile("[^\x00-\u017f]|<\\|")


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself where
    it is printable, else the next free code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letter[b] for b in range(256)]


class PairIndexBPE:
    """A tokenizer file's BPE model with word ends, lower-casing and byte letters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + suffix] for x in letters], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.a = np.array([vocab[x] for x, _ in merges], np.int64)
        self.b = np.array([vocab[y] for _, y in merges], np.int64)
        self.made = np.array([vocab[x + y] for x, y in merges], np.int64)
        if len(np.unique(self.made)) != len(self.made):
            raise ValueError("two merges make the same symbol: ranks then can't be applied in one ascending order")
        keys = self.a << 20 | self.b
        self._order = np.argsort(keys)
        self._keys = np.concatenate([keys[self._order], [np.iinfo(np.int64).max]])
        self._order = np.concatenate([self._order, [-1]])
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        # the library's own normaliser and splitter, for the words that _ODD finds
        library = Tokenizer.from_file(path)
        self._normalize, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self._byte_of = {x: b for b, x in enumerate(letters)}
        (split,) = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self._pattern = regex.compile("\n|" + split["pattern"]["Regex"])
        self._clear()

    def _clear(self) -> None:
        self._hash = np.zeros(0, U64)
        self._at, self._n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._first, self._size, self._bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self._ids = np.zeros(0, np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a << 20 | b
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._order[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids, end to end, and the offsets of each piece's. Pieces aren't empty."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(size)
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - size] = -1
        rank = np.full(n, -1, np.int64)
        rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
        rank[ends - 1] = -1
        order = np.argsort(rank, kind="stable")
        order = order[np.searchsorted(rank[order], 0) :]
        first, begins = np.unique(rank[order], return_index=True)
        index: dict[int, list[np.ndarray]] = {r: [x] for r, x in zip(first.tolist(), np.split(order, begins[1:]), strict=True)} if len(order) else {}
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.a[r], self.b[r]
            at = at[symbol[at] == a]
            at = at[after[at] >= 0]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # of overlapping pairs the leftmost counts
                keep, taken = [], -1
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != taken:
                        keep.append(p)
                        taken = q
                at = np.array(keep, np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone] = self.made[r], -1
            right = after[gone]
            after[at] = right
            inside = right >= 0
            before[right[inside]] = at[inside]
            left = before[at]
            starts = np.concatenate([left[left >= 0], at[inside]])
            new = self.ranks(symbol[starts], symbol[after[starts]])
            starts, new = starts[new >= 0], new[new >= 0]
            if not len(new):
                continue
            order = np.argsort(new, kind="stable")
            new, starts = new[order], starts[order]
            cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
            for x, part in zip(new[[0, *cuts]].tolist(), np.split(starts, cuts), strict=True):
                if x in index:
                    index[x].append(part)
                else:
                    index[x] = [part]
                    heapq.heappush(active, x)
        stays = symbol >= 0
        return symbol[stays].astype(np.int32), np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], ends])]

    def _split_odd(self, word: str) -> list[bytes | int]:
        """The pieces of a word without ASCII white space as bytes, and special tokens as ids."""
        out: list[bytes | int] = []
        for part in self._special.split(word) if self._special else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [bytes(map(self._byte_of.__getitem__, x)) for x, _ in self._split(self._normalize(part))]
        return out

    def _split_words(self, words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct pieces, the words' pieces as indexes of these, end to end, and each word's count.

        Special tokens are the indexes after those of the pieces, in the order of
        their ids.
        """
        joined = "\n".join(words)
        odd = {i for i, w in enumerate(words) if _ODD.search(w)} if _ODD.search(joined) else set()
        if odd:
            joined = "\n".join("" if i in odd else w for i, w in enumerate(words))
        plain = self._pattern.findall(joined.lower())
        distinct = set(plain) - {"\n"}
        number = {x: i for i, x in enumerate(distinct)} | {"\n": -1}
        flat = np.fromiter(map(number.__getitem__, plain), np.int64, len(plain))
        bounds = np.concatenate([[-1], np.flatnonzero(flat < 0), [len(flat)]])
        count, flat = np.diff(bounds) - 1, flat[flat >= 0]
        pieces = [x.encode() for x in distinct]
        if odd:
            at = {x: i for i, x in enumerate(pieces)}
            parts = {i: self._split_odd(words[i]) for i in sorted(odd)}
            for own in parts.values():
                for x in own:
                    if type(x) is bytes:
                        at.setdefault(x, len(at))
            pieces, special = list(at), {x: len(at) + i for i, x in enumerate(sorted(set(self.special.values())))}
            begins = np.cumsum(count) - count
            more = [(begins[i], special[x] if type(x) is int else at[x]) for i, own in parts.items() for x in own]
            for i, own in parts.items():
                count[i] = len(own)
            if more:
                where, what = zip(*more, strict=True)
                flat = np.insert(flat, where, what)
        return pieces, flat, count

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, end to end, and the offsets of each word's."""
        pieces, flat, count = self._split_words(words)
        ids, at = self.merge(pieces) if pieces else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        specials = sorted(set(self.special.values()))
        ids = np.concatenate([ids, np.array(specials, np.int32)])
        lo = np.concatenate([at[:-1], at[-1] + np.arange(len(specials))])
        hi = np.concatenate([at[1:], at[-1] + 1 + np.arange(len(specials))])
        size = (hi - lo)[flat]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids[ranges(lo[flat], size)], total[np.concatenate([[0], np.cumsum(count)])]

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Adds words to the cache; hashes are sorted."""
        ids, bounds = self._encoded([w.decode("utf-8", "replace") for w in words])
        place, size = np.searchsorted(self._hash, hashes), np.fromiter(map(len, words), np.int64, len(words))
        first = len(self._bytes) + np.cumsum(size) - size
        for name, new in (("_hash", hashes), ("_at", len(self._ids) + bounds[:-1]), ("_n", np.diff(bounds)), ("_first", first), ("_size", size)):
            setattr(self, name, np.insert(getattr(self, name), place, new))
        self._ids = np.concatenate([self._ids, ids])
        self._bytes = np.concatenate([self._bytes, np.frombuffer(b"".join(words), np.uint8)])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the offsets of each text's.

        Words are looked up by 64-bit hashes, and their bytes compared with those of the
        word that the hash stands for, here and in the cache. Where any differ, all words
        of these texts go by their bytes alone.
        """
        starts, ends, of_text = split_words(data, at)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        hashes, first, inverse = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
        raw, size = data.tobytes(), ends - starts
        same = _same(data, starts, size, data, starts[first][inverse], size[first][inverse])
        found = np.searchsorted(self._hash, hashes)
        known = np.zeros(len(hashes), bool) if not len(self._hash) else self._hash[np.minimum(found, len(self._hash) - 1)] == hashes
        if same and known.any():
            old, new = found[known], first[known]
            same = _same(data, starts[new], size[new], self._bytes, self._first[old], self._size[old])
        if not same:
            words = [raw[lo:hi] for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
            number = {w: i for i, w in enumerate(dict.fromkeys(words))}
            ids, bounds = self._encoded([w.decode("utf-8", "replace") for w in number])
            inverse = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            lo, n = bounds[:-1][inverse], np.diff(bounds)[inverse]
        else:
            if not known.all():
                if len(self._hash) + np.count_nonzero(~known) > CACHE_WORDS or len(self._ids) + len(self._bytes) > CACHE_IDS:
                    self._clear()
                    known[:] = False
                fresh = first[~known]
                self._learn([raw[lo:hi] for lo, hi in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)], hashes[~known])
                found = np.searchsorted(self._hash, hashes)
            ids, lo, n = self._ids, self._at[found][inverse], self._n[found][inverse]
        return ids[ranges(lo, n)], np.concatenate([[0], np.cumsum(n)])[of_text]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens with a space between each two, in UTF-8, special ones included."""
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


def _same(a: np.ndarray, at: np.ndarray, n: np.ndarray, b: np.ndarray, bt: np.ndarray, m: np.ndarray) -> bool:
    """Whether all spans of bytes, of a at `at` and of b at `bt`, are alike, of n and m bytes."""
    return bool((n == m).all()) and bool((a[ranges(at, n)] == b[ranges(bt, n)]).all())


@lru_cache(maxsize=1)
def load(path: str) -> PairIndexBPE:
    """One for each Python worker: its cache serves all of the worker's tasks."""
    return PairIndexBPE(path)


def encoded(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ids, the text's token ids as little-endian unsigned 32-bit integers, per row.

    Ids are those of the tokenizers library for the file at path, without special
    tokens added. path must exist on every executor. Null and empty texts have no
    ids. Rows that repeat an id and rows with a null id are encoded like any
    other. An empty table gives an empty result; extra columns aren't read.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for rows, data, at in slices(batch, "text", 1 << 21):
                ids, bounds = bpe.encode(data, at)
                yield pa.RecordBatch.from_arrays([rows.column(0), _binary(ids, bounds)], ["id", "ids"])

    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id)


def _binary(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(ids.astype("<u4"))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def round_trip_digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 per row, see encoded(); an empty
    sequence decodes to an empty text."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for rows, data, at in slices(batch, "text", 1 << 21):
                ids, bounds = bpe.encode(data, at)
                raw, n = np.ascontiguousarray(ids.astype("<u4")), bounds.tolist()
                own = [hashlib.sha256(raw[lo:hi]).hexdigest() for lo, hi in zip(n[:-1], n[1:], strict=True)]
                texts = [hashlib.sha256(bpe.decode(ids[lo:hi])).hexdigest() for lo, hi in zip(n[:-1], n[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds)), pa.array(own, pa.string()), pa.array(texts, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id)

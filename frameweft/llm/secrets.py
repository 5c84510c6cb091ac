"""Secrets in texts: rules for the base kinds, and a character network over further candidates."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, small_batches
from .textops import LOWER, slices

# The base kinds, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")


@dataclass(frozen=True)
class SecretConfig:
    """findings: labelled findings that are made to fit and to calibrate the network.
    before, inside, after: characters of a window. recall: what the threshold must
    keep of the labelled secrets that fitting didn't see; it is the highest such."""

    findings: int = 6000
    before: int = 20
    inside: int = 32
    after: int = 8
    dims: int = 8
    widths: tuple[int, ...] = (3, 5)
    filters: int = 16
    epochs: int = 12
    recall: float = 0.97
    seed: int = 11


def labelled_findings(cfg: SecretConfig) -> list[tuple[str, int, int, int]]:
    """Made-up texts with the place of a candidate and whether it is a secret, from a fixed seed.

    Secrets are random strings of usual alphabets and lengths, with and without a
    word before them that says so, and with or without digits. The others are what
    else is long in running text: numbers, dates, addresses, versions, paths, file
    names, rules of one sign, long and compound words, names in mixed case.
    """
    rng = random.Random(cfg.seed)
    pick = lambda letters, lo, hi: "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
    word = lambda: pick(string.ascii_lowercase, 2, 9)
    mixed, lower = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits

    def secret() -> str:
        return rng.choice((lambda: pick(mixed, 20, 48), lambda: pick(string.ascii_letters, 16, 40) + pick(string.digits, 0, 1), lambda: pick(lower, 20, 40), lambda: pick(mixed + "+/", 24, 64) + rng.choice(("", "=", "==")), lambda: pick(string.ascii_uppercase + string.digits, 16, 32), lambda: pick("0123456789abcdef", 20, 64), lambda: rng.choice(("sk_live_", "ghp_", "xox-", "key-", "pk.")) + pick(mixed, 18, 36), lambda: ".".join(pick(mixed + "-_", 16, 30) for _ in range(3))))()

    syllables = "an ar ba ber con da de di do el en er es fa ge gen he ho in ing is ka ken la le li lo ma men mi mo na ne ni nis ob on or pe pre ra re ri ro sa schaft se si so ta te ter ti tion to tra un ung ver vi zu".split()
    spoken = lambda lo, hi: "".join(rng.choice(syllables) for _ in range(rng.randint(lo, hi)))

    def plain() -> str:
        return rng.choice((lambda: spoken(7, 12), lambda: spoken(7, 10).capitalize(), lambda: spoken(7, 10).upper(), lambda: "-".join(spoken(2, 4) for _ in range(4)), lambda: "_".join(spoken(2, 4) for _ in range(4)), lambda: "".join(spoken(2, 3).capitalize() for _ in range(4)), lambda: spoken(2, 3) + "".join(spoken(2, 3).capitalize() for _ in range(3)), lambda: "/".join(spoken(2, 4) for _ in range(4)), lambda: ".".join(spoken(2, 4) for _ in range(4)), lambda: f"www.{spoken(2, 5)}.{spoken(2, 4)}.com/{spoken(2, 4)}", lambda: rng.choice("=-_.+") * rng.randint(16, 60), lambda: spoken(3, 5) + rng.choice(("...", "--", "./")) + spoken(4, 6), lambda: f"{spoken(3, 5)}.{spoken(4, 6)}@"))()

    def other() -> str:
        if rng.random() < 0.5:
            return plain()
        return rng.choice((lambda: pick(string.digits, 16, 24), lambda: "-".join(pick(string.digits, 3, 5) for _ in range(5)), lambda: ".".join(pick(string.digits, 1, 3) for _ in range(6)), lambda: f"{word()}.{pick(string.digits, 1, 3)}.{word()}.example.com", lambda: "/".join(word() + pick(string.digits, 0, 2) for _ in range(4)), lambda: f"{word()}-{word()}-{word()}-{pick(string.digits, 1, 4)}", lambda: f"{word()}_{word()}_{rng.randint(1990, 2030)}.txt", lambda: f"20{pick(string.digits, 2, 2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}.00.00", lambda: word() + word() + word() + pick(string.digits, 2, 3), lambda: "=" * rng.randint(8, 20) + pick(string.digits, 2, 4) + "-" * 8, lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}-{word()}.{pick(string.digits, 4, 6)}"))()

    out = []
    for i in range(cfg.findings):
        label = i % 2
        lead = " ".join(word() for _ in range(rng.randint(0, 5)))
        if rng.random() < (0.4 if label else 0.05):
            lead += " " + rng.choice(("auth=", "Authorization: Bearer ", "credential: ", "key ", "pwd=", "private_key: ", "client-id="))
        else:
            lead += rng.choice((" ", " ", "\n", ": ", ' "', " ("))
        body = secret() if label else other()
        if len(body) < 16:
            body += pick(string.digits, 4, 6) + (pick(mixed, 10, 14) if label else "")
        tail = rng.choice((" ", ". ", '"', "\n", ", ", "")) + " ".join(word() for _ in range(rng.randint(0, 3)))
        out.append((lead + body + tail, len(lead), len(lead) + len(body), label))
    return out


def _windows(text: str, start: int, end: int, cfg: SecretConfig) -> list[np.ndarray]:
    """The characters around and in a candidate, as codes; a long candidate gives several windows."""
    out = []
    for at in range(start, max(start + 1, end - cfg.inside // 2), cfg.inside // 2):
        row = np.zeros(cfg.before + cfg.inside + cfg.after, np.uint8)
        for k, (lo, hi) in ((0, (at - cfg.before, at)), (cfg.before, (at, min(end, at + cfg.inside))), (cfg.before + cfg.inside, (min(end, at + cfg.inside), min(end, at + cfg.inside) + cfg.after))):
            for i in range(max(lo, 0), min(hi, len(text))):
                code = ord(text[i])
                row[k + i - lo] = code if 32 <= code < 127 else 1 if code < 32 else 2
        out.append(row)
    return out


class Network:
    """Embedded characters, filters of several widths, max pooling and a logistic output."""

    def __init__(self, cfg: SecretConfig) -> None:
        rng = np.random.default_rng(cfg.seed)
        self.cfg = cfg
        self.embedding = rng.normal(0, 0.5, (128, cfg.dims))
        self.filters = [rng.normal(0, 0.3, (w * cfg.dims, cfg.filters)) for w in cfg.widths]
        self.bias = np.zeros((len(cfg.widths), cfg.filters))
        self.out, self.base = rng.normal(0, 0.3, len(cfg.widths) * cfg.filters), np.zeros(1)
        self.threshold = 0.5

    def _forward(self, rows: np.ndarray):
        x = self.embedding[rows]
        parts, tops, views = [], [], []
        for i, (w, f) in enumerate(zip(self.cfg.widths, self.filters, strict=True)):
            view = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(len(rows), x.shape[1] - w + 1, -1)
            z = view @ f + self.bias[i]
            tops.append(z.argmax(axis=1))
            parts.append(np.maximum(z.max(axis=1), 0))
            views.append(view)
        hidden = np.concatenate(parts, axis=1)
        return hidden, tops, views, 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.base, -40, 40)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(rows[i : i + 512])[3] for i in range(0, len(rows), 512)]) if len(rows) else np.zeros(0)

    def fit(self, rows: np.ndarray, labels: np.ndarray) -> None:
        rng = np.random.default_rng(self.cfg.seed)
        params = [self.embedding, *self.filters, self.bias, self.out, self.base]
        sums = [np.full_like(p, 1e-3) for p in params]
        for _ in range(self.cfg.epochs):
            for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
                hidden, tops, views, p = self._forward(rows[batch])
                g = (p - labels[batch]) / len(batch)
                grads = [np.zeros_like(q) for q in params]
                grads[-1][0], grads[-2][:] = g.sum(), hidden.T @ g
                back = np.where(hidden > 0, g[:, None] * self.out, 0)
                k = self.cfg.filters
                for i, w in enumerate(self.cfg.widths):
                    own = back[:, i * k : (i + 1) * k]
                    grads[-3][i] = own.sum(axis=0)
                    chosen = views[i][np.arange(len(batch))[:, None], tops[i]]
                    grads[1 + i][:] = np.einsum("bkd,bk->dk", chosen, own)
                    to_x = np.einsum("dk,bk->bkd", self.filters[i], own).reshape(len(batch), k, w, -1)
                    codes = rows[batch][np.arange(len(batch))[:, None, None], tops[i][:, :, None] + np.arange(w)]
                    np.add.at(grads[0], codes.ravel(), to_x.reshape(-1, self.cfg.dims))
                for q, s, d in zip(params, sums, grads, strict=True):
                    s += d * d
                    q -= 0.1 * d / np.sqrt(s)


@lru_cache(maxsize=2)
def trained(cfg: SecretConfig) -> Network:
    """The network for cfg: fitted on the candidates that scan() finds in three quarters
    of the labelled findings, with the highest threshold by which scan() keeps cfg.recall
    of the secrets among the others; those that no candidate covers count as lost, and
    those that the rules find don't count."""
    rows, labels, of, known = [], [], [], []
    for i, (text, start, end, label) in enumerate(labelled_findings(cfg)):
        base = base_spans(text)
        own = [w for s, e in _further(text, base) if s < end and start < e for w in _windows(text, s, e, cfg)]
        if label and i % 8 >= 6 and not _covered(start, end, base):
            known.append(i)
        rows += own
        labels += [label] * len(own)
        of += [i] * len(own)
    rows, labels, of = np.array(rows), np.array(labels, float), np.array(of)
    held = of % 8 >= 6  # both labels alternate
    net = Network(cfg)
    net.fit(rows[~held], labels[~held])
    best = np.zeros(max(of.max(), max(known)) + 1)
    np.maximum.at(best, of[held], net.score(rows[held]))
    secrets = np.sort(best[known])
    net.threshold = float(secrets[int((1 - cfg.recall) * len(secrets))])
    return net


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


def _runs(mask: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.zeros(len(mask) + 1, bool)
    edge[at] = True
    padded = np.concatenate([[False], mask, [False]])
    starts = np.flatnonzero(mask & (~padded[:-2] | edge[:-1]))
    ends = np.flatnonzero(mask & (~padded[2:] | edge[1:])) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def _suspects(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers of the texts that may hold a span, from their bytes: no other text does."""
    places = [_runs(_HEX[data], at, LEAST_HEX)[0]]
    starts, _ = _runs(_TOKEN[data], at, 16)
    places.append(starts)
    low, raw = LOWER[data].tobytes(), data.tobytes()
    for where, words in ((low, KEYWORDS), (raw, (b"AKIA",))):
        for w in words:
            hits, i = [], where.find(w)
            while i >= 0:
                hits.append(i)
                i = where.find(w, i + len(w))
            places.append(np.array(hits, np.int64))
    return np.unique(np.searchsorted(at, np.concatenate(places), side="right") - 1)


def _covered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether spans, sorted by start, cover all from start to end."""
    for a, _, b in spans:
        if a <= start < b:
            start = b
    return start >= end


def _further(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidates: all tokens of 16 or more characters that base spans don't cover whole. An
    assignment takes all of a token from its word on, so what is before it stands alone."""
    out = []
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        e = min([e, *(a for a, k, b in base if k == 0 and a < e and s < b)])
        if e - s >= 16 and not _covered(s, e, base):
            out.append((s, e))
    return out


def scan(texts: list[str], cfg: SecretConfig = SecretConfig()) -> list[list[tuple[int, int, int]]]:
    """Per text, (start, number of the kind, end) by start, then kind: base spans and what the network adds."""
    found, rows, of = [base_spans(t) for t in texts], [], []
    for i, t in enumerate(texts):
        for s, e in _further(t, found[i]):
            own = _windows(t, s, e, cfg)
            rows += own
            of += [(i, s, e)] * len(own)
    if rows:
        net = trained(cfg)
        hits = {x for x, p in zip(of, net.score(np.array(rows)), strict=True) if p >= net.threshold}
        for i, s, e in hits:
            found[i] = sorted([*found[i], (s, 3, e)])
    return found


def secret_spans(docs: DataFrame, text: str = "text", cfg: SecretConfig = SecretConfig(), spans: str = "_spans") -> DataFrame:
    """docs with a further column, spans: an array of (kind, start, end) for each row.
    A column of docs that has this name is replaced.

    Kinds are assign, access and hex, by the rules above on the whole text and
    leftmost without overlap within a kind, and model for what the network adds.
    start and end are code points, end exclusive; the order is by start, then kind.

    The network is fitted in each Python worker, from a fixed seed and so alike.
    A text that is null or empty has no spans. All columns, rows that repeat and
    null ids pass through as they are. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != spans.lower()]
    source, at = docs.select(*kept), kept.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = source.withColumn(spans, F.array().cast("array<struct<kind:string,start:int,end:int>>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays([*batch.columns, batch.column(at).cast(pa.string())], [*map(str, range(batch.num_columns)), "text"])
            for rows, data, bounds in slices(named, "text"):
                found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
                some = _suspects(data, bounds)
                texts = rows.column(rows.num_columns - 1).take(pa.array(some)).to_pylist()
                for i, own in zip(some.tolist(), scan([t or "" for t in texts], cfg), strict=True):
                    found[i] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(found, kind)], [*kept, spans])

    return source.mapInArrow(run, schema)


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """docs with all columns, and mask in the place of each secret; spans that overlap or touch are one.

    Texts without a secret, empty and null ones stay as they are, and so do all other
    columns, whatever their names, rows that repeat and null ids. An empty table gives
    an empty result.
    """
    spans, merged = fresh(docs, "_spans"), fresh(docs, "_merged")
    found = secret_spans(docs, text, cfg, spans)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def join(acc, s):
        last = F.element_at(acc, -1)
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(own)).when(s["start"] <= last["end"], grown).otherwise(F.concat(acc, F.array(own)))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"), s["end"].alias("at"))
    masked = F.aggregate(merged, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.char_length(text))))
    return found.withColumn(merged, F.aggregate(spans, none, join)).withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(F.col(text))).drop(spans, merged)

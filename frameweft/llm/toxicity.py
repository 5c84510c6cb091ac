"""A convolutional text classifier: hashed word embeddings, several widths, max pooling, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches
from .textops import LOWER, NON_LETTER, U64, bytes_of, hash_words, parts, slices, split_words


@dataclass(frozen=True)
class ToxicConfig:
    """rows: labelled documents that the model is fitted on, at most; those with the
    smallest hash of their id, and of these as many as have bytes of text between them.
    slice: bytes of text that are scored at a time; of a longer text parts are. calibration: one in so many of them is left out of
    fitting; with all labelled documents beyond rows they set the scale of the score
    and, for each language, the threshold with the fewest errors. prefixes: a word is
    the sum of the embeddings of itself and of its first so many bytes. bins: parts
    of one in the histograms of responses, which are counted from -span to span."""

    rows: int = 6000
    bytes: int = 64 << 20
    slice: int = 1 << 18
    calibration: int = 4
    buckets: int = 1 << 15
    dims: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    prefixes: tuple[int, ...] = (4, 5)
    epochs: int = 6
    batch: int = 64
    rate: float = 0.1
    seed: int = 7
    bins: int = 256
    span: int = 40


def tokens(data: np.ndarray, at: np.ndarray, cfg: ToxicConfig) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word and of its prefixes, a column each, and the offsets of each text's words.

    Words are runs of letters: ASCII ones in lower case, and all other characters.
    """
    data = LOWER[data]
    starts, ends, of_text = split_words(data, at, NON_LETTER)
    out = np.empty((len(starts), 1 + len(cfg.prefixes)), np.uint16 if cfg.buckets <= 1 << 16 else np.int32)
    out[:, 0] = hash_words(data, starts, ends) % U64(cfg.buckets)
    for i, n in enumerate(cfg.prefixes):
        out[:, i + 1] = (hash_words(data, starts, np.minimum(ends, starts + n)) ^ U64(n * 0x9E37)) % U64(cfg.buckets)
    return out, of_text


class Model:
    """The weights. score() needs one table lookup per word column and offset in a filter."""

    def __init__(self, cfg: ToxicConfig) -> None:
        rng = np.random.default_rng(cfg.seed)
        self.cfg = cfg
        self.embedding = rng.normal(0, 0.1, (cfg.buckets, cfg.dims)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, cfg.dims, cfg.filters)).astype(np.float32) for w in cfg.widths]
        self.bias = np.zeros(len(cfg.widths) * cfg.filters, np.float32)
        self.out = rng.normal(0, 0.3, len(self.bias)).astype(np.float32)
        self.base = np.float32(-1.0)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str | None, float] = {None: 0.5}
        self.fitted = np.zeros(0, np.int64)

    def tables(self) -> np.ndarray:
        """For each bucket, what it adds to each filter at each offset."""
        return np.concatenate([self.embedding @ f[j] for f in self.filters for j in range(len(f))], axis=1)

    def pooled(self, table: np.ndarray, words: np.ndarray, of_text: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each text; 0 where there is none above."""
        n, k = len(of_text) - 1, self.cfg.filters
        out = np.zeros((n, len(self.bias)), np.float32)
        size = np.diff(of_text)
        if not len(words):
            return out
        x = table[words[:, 0]]
        for i in range(1, words.shape[1]):
            x += table[words[:, i]]
        col = 0
        for i, w in enumerate(self.cfg.widths):
            texts = np.flatnonzero(size >= w)
            if len(texts) and len(x) >= w:
                z = x[: len(x) - w + 1, col : col + k].copy()
                for j in range(1, w):
                    z += x[j : len(x) - w + 1 + j, col + j * k : col + (j + 1) * k]
                if w > 1:  # windows that reach into the next text
                    last = of_text[1:][:, None] - np.arange(1, w)
                    last = last[(last >= 0) & (last < len(z))]
                    z[last] = -np.inf
                best = np.maximum.reduceat(z, np.minimum(of_text[texts], len(z) - 1), axis=0)
                out[texts, i * k : (i + 1) * k] = np.maximum(best + self.bias[i * k : (i + 1) * k], 0)
            col += w * k
        return out

    def raw(self, table: np.ndarray, words: np.ndarray, of_text: np.ndarray) -> np.ndarray:
        return self.pooled(table, words, of_text) @ self.out + self.base

    def response(self, table: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """raw() of texts as bytes. A text that is longer than a slice goes through the filters in parts,
        each with the last words of the part before it; the largest response is that of the whole."""
        if len(at) != 2 or len(data) <= self.cfg.slice:
            return self.raw(table, *tokens(data, at, self.cfg))
        reach, best, before = max(self.cfg.widths) - 1, np.zeros((1, len(self.bias)), np.float32), None
        for lo, hi in parts(data, NON_LETTER, self.cfg.slice):
            words, _ = tokens(data[lo:hi], np.array([0, hi - lo]), self.cfg)
            words = words if before is None else np.concatenate([before, words])
            best = np.maximum(best, self.pooled(table, words, np.array([0, len(words)])))
            before = words[max(0, len(words) - reach) :]
        return best @ self.out + self.base

    def score(self, raw: np.ndarray) -> np.ndarray:
        z = raw.astype(np.float64) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: pa.Array, labels: np.ndarray, langs: list[str | None], cfg: ToxicConfig = ToxicConfig()) -> Model:
    """A model fitted on labelled texts. Without texts of both labels every score is the share of label 1.

    The first filter of width one starts out as the log odds of buckets, the others
    at random. Adagrad follows the gradient of the log loss; through max pooling it
    reaches the words of the largest responses only.
    """
    model, rng = Model(cfg), np.random.default_rng(cfg.seed)
    n, y = len(labels), labels.astype(np.float32)
    if not n or y.min() == y.max():
        share = float(np.clip(y.mean() if n else 0.0, 0.01, 0.99))
        model.out[:], model.base, model.scale, model.shift = 0, np.float32(0), 1.0, float(np.log(share / (1 - share)))
        return model
    parts = [tokens(*bytes_of(texts.slice(i, 256)), cfg) for i in range(0, n, 256)]  # keeps what hashing needs small
    words = np.concatenate([w for w, _ in parts])
    of_text = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))])
    del parts
    held = np.arange(n) % cfg.calibration == 0 if n >= 4 * cfg.calibration else np.zeros(n, bool)
    train = np.flatnonzero(~held)
    if y[train].min() == y[train].max():
        held[:], train = False, np.arange(n)

    seen = np.zeros((2, cfg.buckets), np.float32)
    for i in train.tolist():
        seen[int(y[i]), np.unique(words[of_text[i] : of_text[i + 1]])] += 1
    ones, zeros = y[train].sum(), len(train) - y[train].sum()
    odds = np.log((seen[1] + 0.1) / (ones + 0.2)) - np.log((seen[0] + 0.1) / (zeros + 0.2))
    model.embedding[:, 0] = np.clip(odds * np.minimum(seen.sum(axis=0) / 5, 1), -1, 4) * 0.5
    model.filters[0][0, :, 0] = 0
    model.filters[0][0, 0, 0] = 1
    model.out[0], model.bias[0] = 1.0, -1.0

    weight = np.where(y == 1, min(4.0, zeros / max(ones, 1)), 1.0).astype(np.float32)
    sums = [np.full_like(p, 1e-2) for p in (model.embedding, *model.filters, model.bias, model.out)]
    base_sum, k = 1e-2, cfg.filters

    def step(p: np.ndarray, s: np.ndarray, g: np.ndarray) -> None:
        s += g * g
        p -= cfg.rate * g / np.sqrt(s)

    for _ in range(cfg.epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // cfg.batch)):
            g_filters, g_bias, g_out, g_base = [np.zeros_like(f) for f in model.filters], np.zeros_like(model.bias), np.zeros_like(model.out), 0.0
            rows, grads = [], []
            for i in batch.tolist():
                own = words[of_text[i] : of_text[i + 1]]
                x = model.embedding[own].sum(axis=1)
                hidden, best = np.zeros(len(model.bias), np.float32), np.full(len(model.bias), -1)
                for f, (w, filt) in enumerate(zip(cfg.widths, model.filters, strict=True)):
                    if len(own) >= w:
                        z = sum(x[j : len(x) - w + 1 + j] @ filt[j] for j in range(w))
                        top = z.argmax(axis=0)
                        best[f * k : (f + 1) * k] = top
                        hidden[f * k : (f + 1) * k] = z[top, np.arange(k)] + model.bias[f * k : (f + 1) * k]
                active = (hidden > 0) & (best >= 0)
                hidden = np.where(active, hidden, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.base, -30, 30)))
                g = np.float32((p - y[i]) * weight[i] / len(batch))
                g_out += g * hidden
                g_base += g
                back = np.where(active, g * model.out, 0).astype(np.float32)
                g_bias += back
                for c in np.flatnonzero(active).tolist():
                    f, filt = c // k, model.filters[c // k]
                    for j in range(cfg.widths[f]):
                        at = best[c] + j
                        g_filters[f][j, :, c % k] += back[c] * x[at]
                        rows.append(own[at])
                        grads.append(back[c] * filt[j, :, c % k])
            if rows:
                buckets, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(buckets), cfg.dims), np.float32)
                np.add.at(total, inverse, np.repeat(np.array(grads), words.shape[1], axis=0))
                sums[0][buckets] += total * total
                model.embedding[buckets] -= cfg.rate * total / np.sqrt(sums[0][buckets])
            for p, s, g in zip((*model.filters, model.bias, model.out), sums[1:], (*g_filters, g_bias, g_out), strict=True):
                step(p, s, g)
            base_sum += g_base * g_base
            model.base = np.float32(model.base - cfg.rate * g_base / np.sqrt(base_sum))
    model.fitted = train
    rows, table = np.flatnonzero(held) if held.any() and y[held].min() < y[held].max() else train, model.tables()
    raw = np.concatenate([model.raw(table, words[of_text[i] : of_text[i + 1]], np.array([0, of_text[i + 1] - of_text[i]])) for i in rows.tolist()]).astype(np.float64)
    calibrate(model, raw, y[rows], np.array([langs[i] or "" for i in rows.tolist()]), np.ones(len(rows), np.int64))
    return model


def calibrate(model: Model, raw: np.ndarray, label: np.ndarray, langs: np.ndarray, count: np.ndarray) -> None:
    """Sets the scale so that 0.5 parts the labels best, then the threshold that does for each language.

    count: how many documents each response, label and language stands for.
    """
    mean = np.average(raw, weights=count)
    model.scale = float(4 / max(np.sqrt(np.average((raw - mean) ** 2, weights=count)), 1e-6))
    model.shift = -_best_cut(raw, label, count) * model.scale
    score = 1 / (1 + np.exp(-np.clip(raw * model.scale + model.shift, -40, 40)))
    model.thresholds = {None: 0.5}
    for lang in sorted({*langs.tolist()} - {""}):
        here = langs == lang
        if label[here].min() < label[here].max():
            model.thresholds[lang] = float(np.clip(_best_cut(score[here], label[here], count[here]), 0.3, 0.9))


def _best_cut(values: np.ndarray, label: np.ndarray, count: np.ndarray) -> float:
    """The middle one of the cuts with the fewest errors."""
    known, of = np.unique(values, return_inverse=True)
    cuts = np.concatenate([[known[0] - 1e-3], (known[1:] + known[:-1]) / 2, [known[-1] + 1e-3]])
    ones, zeros = (np.bincount(of, np.where(label == k, count, 0), len(known)) for k in (1, 0))
    errors = np.concatenate([[0], np.cumsum(ones)]) + zeros.sum() - np.concatenate([[0], np.cumsum(zeros)])
    best = np.flatnonzero(errors == errors.min())
    return float(cuts[best[len(best) // 2]])


def _responses(shared, span: int):
    """id, lang and the model's response to the text, limited to span, from (id, text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        for batch in batches:
            for rows, data, bounds in slices(batch, "text", model.cfg.slice):
                raw = np.clip(model.response(table, data, bounds).astype(np.float64), -span, span)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(raw)], ["id", "lang", "raw"])

    return run


def _calibrated(model: Model, docs: DataFrame, known: DataFrame, fitted: list[int], cfg: ToxicConfig) -> None:
    """Calibrates the model on all labelled documents but the fitted ones, by histograms that executors count."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, model.tables()))
    own = F.broadcast(spark.createDataFrame([(i,) for i in fitted], "id long"))
    found = docs.mapInArrow(_responses(shared, cfg.span), "id long, lang string, raw double").join(known.join(own, "id", "left_anti"), "id")
    counts = found.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "label", F.round(F.col("raw") * cfg.bins).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "label", "bin").toArrow()
    label = counts.column("label").to_numpy()
    if len(label) and label.min() < label.max():
        calibrate(model, counts.column("bin").to_numpy() / cfg.bins, label, np.array(counts.column("lang").to_pylist()), counts.column("n").to_numpy())
    shared.destroy()


def _fitted(docs: DataFrame, labels: DataFrame, cfg: ToxicConfig, id: str, text: str, lang: str) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label")).where("id is not null and label in (0, 1) and pmod(crc32(cast(id as string)), 5) <> 0")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(cfg.rows)
    order = [F.xxhash64("id"), F.col("id"), F.col("text_hash")]
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null")
    sizes = texts.join(F.broadcast(chosen.select("id")), "id").select("id", F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("size")).orderBy(*order).limit(cfg.rows)
    before = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # of cfg.rows rows
    wanted = sizes.withColumn("upto", before).where(F.col("upto") <= cfg.bytes).select("id", "text_hash").distinct().join(chosen, "id")
    table = texts.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(wanted), ["id", "text_hash"]).orderBy(*order).limit(cfg.rows).drop("text_hash").toArrow()
    model = fit(table.column("text").combine_chunks(), table.column("label").to_numpy(), table.column("lang").to_pylist(), cfg)
    if len(model.fitted):
        _calibrated(model, texts, known, sorted({*table.column("id").to_numpy()[model.fitted].tolist()}), cfg)
    return model


def toxic_scores(docs: DataFrame, labels: DataFrame, cfg: ToxicConfig = ToxicConfig(), id: str = "doc_id", text: str = "text", lang: str = "lang", score: str = "_score", toxic: str = "_toxic") -> DataFrame:
    """docs with two further columns: score (0 to 1, higher: more likely toxic) and toxic.
    Columns of docs that have one of these names are replaced.

    The model is fitted on the driver, on cfg.rows labelled documents of cfg.bytes at
    most, of ids whose crc32 as text isn't divisible by 5; those are 6,000 ids, the only
    thing that is broadcast beside the weights of a few megabytes. It sees words
    of the text only. All labelled documents of such ids that weren't fitted are
    then scored on the executors, and set the scale and the thresholds. toxic
    holds the score against the threshold of the row's language, or against 0.5 if
    that is null or had no two labels among those.

    All of a text is scored, a very long one in parts that overlap, with the same
    result. Null and empty texts, and texts without letters, get
    the score of no response, whatever the model's base gives. Labels other than 0
    and 1 and null ids are ignored; an id that is labelled twice counts as toxic if
    either label is. Rows that repeat an id are scored alike if their texts are. An
    empty table gives an empty result; without usable labels the score is constant.
    """
    small_batches(docs.sparkSession)
    model = _fitted(docs, labels, cfg, id, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast((model, model.tables()))
    kept = [c for c in docs.columns if c.lower() not in (score.lower(), toxic.lower())]
    source, at, tongue = docs.select(*kept), kept.index(text), kept.index(lang)
    schema = source.withColumns({score: F.lit(0.0), toxic: F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        for batch in batches:
            named = pa.RecordBatch.from_arrays([*batch.columns, batch.column(at).cast(pa.string())], [*map(str, range(len(kept))), "text"])
            for rows, data, bounds in slices(named, "text", model.cfg.slice):
                found = model.score(model.response(table, data, bounds))
                limit = np.array([model.thresholds.get(x, 0.5) for x in rows.column(tongue).to_pylist()])
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(found), pa.array(found >= limit)], [*kept, score, toxic])

    return source.mapInArrow(run, schema)

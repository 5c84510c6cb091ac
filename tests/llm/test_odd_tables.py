"""Empty tables, clashing names, null and repeated ids; and operators against plain loops."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from frameweft.llm import secrets, toxicity
from frameweft.llm.bpe import round_trip_digests
from frameweft.llm.exact_dedup import drop_exact_duplicates
from frameweft.llm.line_hash import remove_spans, repeated_units
from frameweft.llm.minhash_dedup import drop_near_duplicates
from frameweft.llm.packing import packed
from frameweft.llm.textops import NON_LETTER, hash_words, parts
from frameweft.llm.tokenizer_files import path_of

TOKENIZER = path_of("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_empty_tables_stay_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, _spans int, kept_spans int")
    assert secrets.redacted(none).columns == none.columns and secrets.redacted(none).count() == 0
    for f in (drop_exact_duplicates, drop_near_duplicates):
        assert f(none).columns == none.columns and f(none).count() == 0
    assert remove_spans(none, repeated_units(none)).count() == 0


def test_clashing_names(spark):
    """Columns called as the operators' own helpers are kept, or replaced where the docstring says so."""
    rows = [(1, "password=abcdef1 here", "x", "y", "z", 1), (2, "", "x", "y", "z", 2), (None, None, "x", "y", "z", 3), (1, "password=abcdef1 here", "x", "y", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string, _merged string, _cuts string, _gone_id int")
    masked = secrets.redacted(docs)
    assert masked.columns == docs.columns and sorted((r.text or "", r._spans, r._merged) for r in masked.collect()) == [("", "x", "y"), ("", "x", "y"), ("[SECRET] here", "x", "y"), ("[SECRET] here", "x", "y")]
    assert secrets.secret_spans(docs).columns == [c for c in docs.columns if c != "_spans"] + ["_spans"]
    assert sorted((r.doc_id is None, r._gone_id) for r in drop_exact_duplicates(docs).collect()) == [(False, 1), (False, 1), (False, 2), (True, 3)]
    cut = remove_spans(docs, spark.createDataFrame([(1, 0, 9)], "doc_id long, start int, end int"))
    assert sorted(r.text or "" for r in cut.collect()) == ["", "", "abcdef1 here", "abcdef1 here"] and "_cuts" in cut.columns
    scored = spark.createDataFrame([(1, "a b", "en", "old", "old")], "doc_id long, text string, lang string, _score string, _Toxic string")
    row = toxicity.toxic_scores(scored, spark.createDataFrame([], "doc_id long, toxic int"))
    assert row.columns == ["doc_id", "text", "lang", "_score", "_toxic"] and isinstance(row.first()._score, float)


def test_null_and_repeated_ids_are_packed_and_encoded(spark):
    rng = random.Random(3)
    rows = [(None, words(rng, 30)), (None, None), (5, words(rng, 40)), (5, words(rng, 50)), (5, words(rng, 9)), (6, "")]
    docs = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string").withColumn("ids", F.lit("x"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    expected = sorted((-1 if i is None else i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*rows, rows[2]])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in round_trip_digests(docs, TOKENIZER).collect()) == expected
    pieces = packed(docs, TOKENIZER).collect()
    total = defaultdict(int)
    for r in pieces:
        total[-1 if r.doc_id is None else r.doc_id] += r.length
    assert {i: sum(n + 1 for j, n in expected if j == i) for i in (-1, 5, 6)} == total


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """With a hash of three values words collide all the time, in a text and with the cache; bytes decide."""
    from tokenizers import Tokenizer

    from frameweft.llm import bpe

    library, rng = Tokenizer.from_file(TOKENIZER), random.Random(4)
    for n in (1, 3, 1 << 60):
        own = bpe.PairIndexBPE(TOKENIZER)
        monkeypatch.setattr(bpe, "hash_words", lambda *a, n=n: hash_words(*a) % np.uint64(n))
        for texts in (["one"], ["two"], [words(rng, 30), "", words(rng, 40) + " naïve <|endoftext|>"], ["one two"]):
            ids, at = own.encode(*toxicity.bytes_of(pa.array(texts)))
            assert [ids[lo:hi].tolist() for lo, hi in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# --- toxicity ---


def plain_response(model, text):
    """The model's response to a text, a word and a filter at a time."""
    cfg = model.cfg
    rows = []
    for w in re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())):
        x = np.zeros(cfg.dims)
        for k, cut in ((0, None), *((p * 0x9E37, p) for p in cfg.prefixes)):
            own = np.frombuffer(w[:cut], np.uint8)
            h = int(hash_words(own, np.array([0]), np.array([len(own)]))[0]) ^ k
            x += model.embedding[h % cfg.buckets]
        rows.append(x)
    hidden = []
    for f, w in zip(model.filters, cfg.widths, strict=True):
        for c in range(cfg.filters):
            top = [sum(rows[i + j] @ f[j, :, c] for j in range(w)) for i in range(len(rows) - w + 1)]
            hidden.append(max(0.0, max(top) + model.bias[len(hidden)]) if top else 0.0)
    return float(np.dot(hidden, model.out) + model.base)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(8)
    texts = [words(rng, 14) + (" vile thing " if i % 3 == 0 else " kind thing ") + words(rng, 5) for i in range(240)]
    return toxicity.fit(pa.array(texts), np.array([int(i % 3 == 0) for i in range(240)]), ["en"] * 240, toxicity.ToxicConfig(rows=240, slice=4096))


def test_responses_equal_a_plain_loop(model):
    rng = random.Random(9)
    texts = ["", None, "one", "Vile", "é ß vile-thing 12 x", words(rng, 40), words(rng, 3).upper()]
    data, at = toxicity.bytes_of(pa.array(texts))
    got = model.response(model.tables(), data, at)
    assert np.allclose(got, [plain_response(model, t) for t in texts], atol=1e-4)


def test_long_texts_score_the_same_in_parts(model):
    """A text of 2 MB goes through 4 KB at a time; what decides stands across a cut, or anywhere else."""
    rng = random.Random(10)
    long = words(rng, 330_000)
    whole = toxicity.Model(toxicity.ToxicConfig())
    whole.__dict__.update({k: v for k, v in model.__dict__.items() if k != "cfg"})
    for place in (0, 4090, 1_000_000, len(long)):
        text = long[:place] + " vile thing " + long[place:]
        data, at = toxicity.bytes_of(pa.array([text]))
        got = model.response(model.tables(), data, at)
        assert np.allclose(got, whole.raw(model.tables(), *toxicity.tokens(data, at, model.cfg)), atol=1e-5)
    assert [hi - lo for lo, hi in parts(np.frombuffer(b"x" * 10_000 + b" y", np.uint8), NON_LETTER, 100)] == [10_000, 2]


# --- secrets ---


def plain_spans(t):
    """The base kinds, a character at a time."""
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low = "".join(c.lower() if c.isascii() else c for c in t)
    out = []

    def run(i, letters):
        while i < len(t) and t[i] in letters:
            i += 1
        return i

    i = 0
    while i < len(t):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, i)), None)
        j = -1
        if word:
            j = i + len(word)
            j += j < len(t) and t[j] in "\"'"
            j = run(j, " ")
            if j < len(t) and t[j] in ":=":
                j = run(j + 1, " ")
                j += j < len(t) and t[j] in "\"'"
                start, j = j, run(j, value)
                if j > start:
                    if j - start >= 6:
                        out.append((i, "assign", j))
                    i = j
                    continue
        i += 1
    for kind, prefix, letters, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(t):
            if t.startswith(prefix, i) and (j := run(i + len(prefix), letters)) > i + len(prefix):
                if j - i >= least:
                    out.append((i, kind, j))
                i = j
            else:
                i += 1
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))


def test_base_spans_equal_plain_rules(spark):
    rng = random.Random(12)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "apikey", "API-KEY", ":", "=", " ", "  ", '"', "'", "AKIA", "AKIAB", "0f3a9c1d", "A1B2C3D4E5", "x", "é", "ſecret", "abcdef", "_.=-", "\n", "hunter2", "0" * 24]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in secrets.secret_spans(docs).collect():
        assert [(s.start, s.kind, s.end) for s in r._spans if s.kind != "model"] == plain_spans(r.text), r.text


# --- pipeline ---


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage of the pipeline against a plain form, each on what its predecessor kept."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" api_key: 'A1b2C3d4' "))).otherwise(F.col("text")))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        stages[name](spark, df, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        return out, {r.doc_id: r for r in out.collect()}

    before = {r.doc_id: r for r in docs.collect()}
    model = toxicity._fitted(docs, labels, toxicity.ToxicConfig(), "doc_id", "text", "lang")
    score = {i: float(model.score(np.array([plain_response(model, r.text)]))[0]) for i, r in before.items()}
    clean = {i for i, s in score.items() if s < model.thresholds.get(before[i].lang, 0.5)}
    close = {i for i, s in score.items() if abs(s - model.thresholds.get(before[i].lang, 0.5)) < 1e-4}
    docs, after = step("toxicity", docs)
    assert set(after) | close == clean | close and len(after) < len(before)

    groups = defaultdict(list)
    for i, r in after.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), i))
    docs, after = step("exact_dedup", docs)
    assert set(after) == {min(g)[1] for g in groups.values()}

    sets = {}
    for i, r in after.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r.text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    part = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and part[a] != part[b] and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
    docs, after = step("near_dedup", docs)
    assert set(after) == set(part.values()) and len(after) < len(sets)

    texts = {i: r.text or "" for i, r in after.items()}
    docs, after = step("secrets", docs)
    changed = 0
    for i, r in after.items():
        out, at, spans = "", 0, []
        for s, _, e in secrets.scan([texts[i]])[0]:
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        for s, e in spans:
            out, at = out + texts[i][at:s] + "[SECRET]", e
        assert r.text == out + texts[i][at:] and r.n_chars == len(r.text)
        assert {(s, k) for s, k, _ in plain_spans(texts[i])} <= {(s, secrets.KINDS[k]) for s, k, _ in secrets.scan([texts[i]])[0]}
        changed += bool(spans)
    assert set(after) == set(texts) and changed

    library, pieces = Tokenizer.from_file(TOKENIZER), defaultdict(list)
    for r in stages["packing"](spark, docs, SF).collect():
        pieces[r.doc_id].append((r.start, r.ids))
    for i, r in after.items():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert b"".join(x for _, x in sorted(pieces[i])) == np.array(ids, "<u4").tobytes()
    assert set(pieces) == set(after)

"""The corpus operators on odd tables, and against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameweft.llm import secrets as scan
from frameweft.llm.bpe import round_trip_digests
from frameweft.llm.components import connected_components
from frameweft.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from frameweft.llm.fuzzy_lines import LineConfig, fuzzy_lines
from frameweft.llm.hnsw import nearest
from frameweft.llm.line_hash import remove_spans, repeated_units
from frameweft.llm.minhash_dedup import NearConfig, drop_near_duplicates, near_duplicates
from frameweft.llm.packing import PackConfig, packed
from frameweft.llm.suffix_dedup import repeated_passages
from frameweft.llm.tokenizer_files import path_of
from frameweft.llm.toxicity import toxic_scores

TOKENIZER = path_of("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, kept string"
WORDS = [a + b for a in "the an of to in".split() for b in ("", "ra", "lo", "mi", "su", "ke")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Odd rows, copies, near copies and a passage that several texts hold."""
    rng = random.Random(1)
    passage, base = prose(rng, 70), prose(rng, 150).split(" ")
    texts = [None, "", " \n\t", "one", "Two words", prose(rng, 20000), "ß é 日本語 🙂 é"]
    texts += [prose(rng, 200) for _ in range(30)]
    texts += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(4)]
    for n in (1, 2, 3, 5, 9, 14, 20):
        own = base[:]
        for i in rng.sample(range(len(own)), n):
            own[i] = "x" + own[i]
        texts.append(" ".join(own))
    texts += [texts[10], texts[10].replace(" ", "  "), texts[10].upper()]
    rows = [(i, t, rng.choice(("en", "fr", None)), "s", None, None, "y") for i, t in enumerate(texts)]
    rows += [(None, "null id " + texts[12], None, None, None, 1, None), rows[15]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (exact_duplicates, repeated_units, near_duplicates, repeated_passages, fuzzy_lines):
        assert f(none).count() == 0
    assert packed(none, TOKENIZER).count() == round_trip_digests(none, TOKENIZER).count() == scan.secret_spans(none).count() == 0
    assert toxic_scores(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


@pytest.mark.parametrize("digest", [None, lambda b: b[:1]])
def test_exact(spark, corpus, digest):
    """The second digest collides all the time; whole bytes then decide."""
    got = exact_duplicates(corpus, **({"digest": digest} if digest else {})).collect()
    groups = defaultdict(list)
    for r in corpus.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    expected = defaultdict(list)
    for body, rows in groups.items():
        for _, _, i in rows:
            expected[i].append((min(rows)[2], len(rows), i == min(rows)[2], hashlib.sha256(body.encode()).hexdigest()))
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.keep_id, r.group_size, r.kept, r.text_sha256))
    assert found == expected
    if not digest:
        left = drop_exact_duplicates(corpus)
        assert left.columns == corpus.columns and left.count() == sum(r.kept for r in got)


def test_lines(spark, corpus):
    spans = repeated_units(corpus)
    passage = [r for r in spans.collect() if r.n_words == 70]
    assert len(passage) == 3 and len({r.first_id for r in passage}) == 1
    cut = by_id(remove_spans(corpus, spans))
    texts = {r.doc_id: r.text for r in corpus.collect()}
    for r in passage:
        (row,) = cut[r.doc_id]
        assert row.text == texts[r.doc_id][: r.start] + texts[r.doc_id][r.end :]
        assert "".join(texts[r.doc_id][k.start : k.end] for k in row.kept_spans) == row.text


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(sets, similar):
    part = {i: i for i in sets}

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= similar * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                part[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("cfg", [NearConfig(), NearConfig(shingle=3, similar=85, bands=25, rows=5)])
def test_near(spark, corpus, cfg):
    sets = {r.doc_id: shingles(r.text, cfg.shingle) for r in corpus.collect() if r.doc_id is not None}
    part = components(sets, cfg.similar)
    got = by_id(near_duplicates(corpus, cfg=cfg))
    for i, s in sets.items():
        assert all((r.n_shingles, r.component_id, r.kept) == (len(s), part[i], part[i] == i) for r in got[i])
    assert got[None][0].component_id is None and got[None][0].kept
    assert len(set(part.values())) < len(sets) - 3
    assert drop_near_duplicates(corpus).columns == corpus.columns


def test_near_in_large_buckets(spark):
    """Chains of edits from one text, so that buckets hold many texts of several components; small blocks part them."""
    rng = random.Random(31)
    texts, base = [], prose(rng, 120).split(" ")
    for _ in range(90):
        own = texts[rng.randrange(len(texts))].split(" ") if texts and rng.random() < 0.7 else base[:]
        for i in rng.sample(range(len(own)), rng.choice((1, 2, 5, 9))):
            own[i] = prose(rng, 1)
        texts.append(" ".join(own))
    sets = {i: shingles(t, 3) for i, t in enumerate(texts)}
    part = components(sets, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"id": F.lit(1), "part": F.lit("x"), "_gone_id": F.lit(2)})
    cfg = NearConfig(shingle=3, block=8)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, cfg=cfg).collect()} == part and 5 < len(set(part.values())) < 80
    left = drop_near_duplicates(docs, cfg=cfg)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(part.values()))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7), (3, 2)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    part = {x: x for e in edges for x in e}
    for _ in part:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    assert got == {x: p for x, p in part.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def passages_by_brute_force(rows, n=50):
    """The words of each (id, text) that lie in a run of n words which occurs elsewhere, and in one that occurs earlier."""
    words = {(i, t): [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for i, t in rows}
    seen = defaultdict(set)
    for (i, t), w in words.items():
        for p in range(len(w) - n + 1):
            seen[tuple(x[2] for x in w[p : p + n])].add((i, p, t))
    covered, later = defaultdict(set), defaultdict(set)
    for at in seen.values():
        least = min((i, p) for i, p, _ in at)
        for i, p, t in at if len(at) > 1 else ():
            covered[i, t].update(range(p, p + n))
            if (i, p) != least:
                later[i, t].update(range(p, p + n))
    return words, covered, later


def held_passages(found, words):
    """The words that rows cover, and those that may go."""
    covered, gone = defaultdict(set), defaultdict(set)
    for r in found:
        ((key, w),) = [(k, w) for k, w in words.items() if k[0] == r.doc_id]
        own = {k for k, (s, e, _) in enumerate(w) if s >= r.start and e <= r.end}
        assert len(own) == r.n_words and w[min(own)][0] == r.start and w[max(own)][1] == r.end
        covered[key] |= own
        if not r.kept:
            gone[key] |= own
    return covered, gone


def test_passages(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect() if r.doc_id is not None and r.text]
    words, covered, later = passages_by_brute_force(rows)
    found = repeated_passages(corpus).collect()
    assert held_passages(found, words) == (covered, later) and covered and all(r.passage_words >= 50 for r in found)


def test_passages_with_ends_in_common(spark):
    """Texts that share pieces of each other's passages, of every length about 50, copies, and texts of one word."""
    rng = random.Random(21)
    base = prose(rng, 400).split(" ")
    texts = [" ".join(base), " ".join(base), "la " * 130, "la " * 49 + "lo " * 60]
    for k in range(120):
        at, n = rng.randrange(340), rng.choice((34, 35, 48, 49, 50, 51, 52, 60, 64, 65, 66, 90))
        texts.append(f"{prose(rng, rng.randrange(20))}\n{' '.join(base[at : at + n])} {prose(rng, rng.randrange(25))} {' '.join(base[at // 2 : at // 2 + rng.randrange(70)])}")
    rows = list(enumerate(texts))
    words, covered, later = passages_by_brute_force(rows)
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").withColumns({"id": F.lit("x"), "spans": F.lit(1)}).repartition(5)
    assert held_passages(repeated_passages(docs).collect(), words) == (covered, later)


def test_passages_of_texts_under_one_id(spark):
    rng = random.Random(22)
    one, two = prose(rng, 60), prose(rng, 80)
    docs = spark.createDataFrame([(1, one), (1, two), (2, "x " + two), (3, one + " y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.kept) for r in repeated_passages(docs).collect()) == [(1, 60, True), (1, 80, True), (2, 80, False), (3, 60, False)]


def test_fuzzy_lines(spark):
    rng = random.Random(2)
    line = prose(rng, 60)
    other = line.replace(line.split()[5], line.split()[5] + "x", 1)
    docs = spark.createDataFrame([(1, line + "\n" + prose(rng, 30)), (2, line.upper() + "!\n\n" + other), (3, None), (4, "")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r for r in fuzzy_lines(docs).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 2)}
    assert got[1, 0].kept and not got[2, 0].kept and (got[2, 0].first_id, got[2, 0].first_line, got[2, 0].copies) == (1, 0, 2)


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return row[-1]


@pytest.mark.parametrize("split", [256, 3])
def test_fuzzy_lines_against_brute_force(spark, split):
    """Many near copies of a few lines, long, short and without spaces, beside others and odd characters. Edit
    similarity alone decides; with the small split, all buckets are large ones."""
    rng = random.Random(9)
    texts = [None, "", "\n\n", "\u4e00 \u201cQuoted\u201d x\u0301 \U0001f642\n7", prose(rng, 700)]
    for base in (prose(rng, 60), prose(rng, 25), "Chapter twelve of the handbook", "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(80))):
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(("", "x", "yz", " "))
            texts.append(prose(rng, 8) + "\n" + "".join(own))
    rows = [(i, t, None) for i, t in enumerate(texts)]
    rows += [(10, texts[11], "extra"), (None, texts[12], None)]
    lines = defaultdict(list)
    for i, t, _ in rows:
        for k, line in enumerate((t or "").split("\n") if i is not None else ()):
            norm = " ".join(re.findall(r"[^\W_]+", line.lower()))
            if norm:
                lines[norm].append((i, k))
    names = list(lines)
    part = list(range(len(names)))
    for a in range(len(names)):
        for b in range(a):
            x, y = names[a], names[b]
            most = int(0.2 * max(len(x), len(y)) + 1e-9)
            if part[a] != part[b] and abs(len(x) - len(y)) <= most and sum(abs(x.count(c) - y.count(c)) for c in set(x + y)) <= 2 * most and edits(x, y) <= most:
                part = [part[b] if p == part[a] else p for p in part]
    groups = defaultdict(list)
    for a, name in enumerate(names):
        groups[part[a]] += lines[name]
    expected = sorted((*place, *min(groups[part[a]]), len(lines[name]), len(groups[part[a]]), place == min(groups[part[a]])) for a, name in enumerate(names) for place in lines[name])
    docs = spark.createDataFrame(rows, "doc_id long, text string, first_id string")
    got = sorted((r.doc_id, r.line_no, r.first_id, r.first_line, r.copies, r.group_lines, r.kept) for r in fuzzy_lines(docs, cfg=LineConfig(split=split)).collect())
    assert got == expected and max(map(len, groups.values())) > 20


def test_fuzzy_lines_run_in_the_jvm(spark, corpus):
    """The operator's plans hold no Python."""
    plan = fuzzy_lines(corpus)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan
    bands = LineConfig().members()
    assert all(len(set(b)) == 4 for b in bands) and len(set(map(tuple, map(sorted, bands)))) == 12


def test_bpe_equals_the_library(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(3)
    letters = [chr(c) for a, b in ((1, 128), (160, 400), (0x370, 0x400), (0x300, 0x310), (0x4E00, 0x4E10), (0x2000, 0x2010), (0x1F600, 0x1F610)) for c in range(a, b)] + ["'s", "<|endoftext|>", "'LL", " ", "\n"]
    odd = spark.createDataFrame([(1000 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(600)], "doc_id long, text string")
    docs = corpus.select("doc_id", "text").unionByName(odd).where("doc_id is not null")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in round_trip_digests(docs, TOKENIZER).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("cfg", [PackConfig(), PackConfig(size=64, open_windows=2, merge=1)])
def test_packing(spark, corpus, cfg):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    docs = corpus.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed(docs, TOKENIZER, cfg=cfg).collect():
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids == own and zlib.crc32(own) == zlib.crc32(r.ids) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in pieces.items():
        assert [s for s, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))]).tolist()[:-1] and sum(n for _, n in own) == len(ids[i])
    assert set(pieces) == set(ids)
    padding = 0
    for own in sequences.values():
        assert [s for s, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))]).tolist()[:-1]
        total = sum(n for _, n in own)
        assert total <= cfg.size
        padding += cfg.size - total if total & (total - 1) else 0
    assert padding <= 0.25 * sum(map(len, ids.values()))


def test_secrets(spark):
    rng = random.Random(5)
    texts = [None, "", "password=abc token: 'abcdef' AKIA" + "A1" * 8 + " AKIAB12 " + "0f" * 12 + " " + "0f" * 11, "API_KEY = \"secret=token: abcdefgh\" é" + "ab12" * 9, prose(rng, 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan.secret_spans(docs).collect():
        base = [(s.start, s.end, s.kind) for s in r._spans if s.kind != "model"]
        assert base == [(s, e, scan.KINDS[k]) for s, k, e in scan.base_spans(r.text or "")]
        assert all(scan._suspects(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])).size for t in [r.text or ""] if base)
    masked = by_id(scan.redacted(docs))
    assert masked[0][0].text is None and masked[4][0].text == texts[4] and "0f0f" * 6 not in masked[2][0].text and "AKIAA1" not in masked[2][0].text


def test_secret_network():
    cfg = scan.SecretConfig()
    net = scan.trained(cfg)
    best = [(max(net.score(np.array(scan._windows(t, s, e, cfg)))), label) for t, s, e, label in scan.labelled_findings(scan.SecretConfig(seed=99, findings=600))]
    assert np.mean([p >= net.threshold for p, label in best if label]) > 0.9
    assert np.mean([p >= net.threshold for p, label in best if not label]) < 0.05


def test_toxicity(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(5, 60)) + (" vile" + rng.choice(("", "ness", "ly")) + " " + prose(rng, 9) if i % 5 == 2 else ""), "en" if i % 2 else None) for i in range(700)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 == 2)) for i in range(700)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxic_scores(docs, labels).where("pmod(crc32(cast(doc_id as string)), 5) = 0").collect()
    known = [r for r in got if r.doc_id < 700]
    assert np.mean([(r._score >= 0.5) == (r.doc_id % 5 == 2) for r in known]) > 0.97
    assert all(0 <= r._score <= 1 for r in got)


def test_nearest(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)
    x[100:140] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    wide, hits = x.astype(float), 0
    for q in range(0, 900, 20):
        score = wide @ wide[q]
        best = [j for j in np.lexsort((np.arange(900), -score)) if j != q][:20]
        assert [r for *_, r in got[q]] == list(range(1, 21)) and all(abs(s - score[j]) < 1e-9 for j, s, _ in got[q])
        hits += len({j for j, *_ in got[q]} & set(best))
    assert hits / (45 * 20) >= 0.9 and set(got) == set(range(0, 900, 20))


def test_nearest_in_double_precision(spark):
    """Scores are of the vectors as given: 0.1 * 6 isn't that of single precision, and large components stay finite."""
    vectors = spark.createDataFrame([(0, [0.1, 1.0]), (1, [6.0, 0.0]), (2, [1e200, 0.0]), (3, [-1e-200, 1e-9]), (4, [])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in nearest(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(2, 0.1 * 1e200), (1, 0.1 * 6.0), (3, 1e-9)]
    none = vectors.limit(0)
    assert nearest(none, none).count() == nearest(vectors, none).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = str(tmp_path / str(i))
        stage(spark, docs, sf).write.parquet(out)
        after = spark.read.parquet(out)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        if name == "exact_dedup":
            assert after.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "")).distinct().count() == after.count()
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.count()

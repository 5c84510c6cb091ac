"""What the corpus operators once left out."""

import random
import time

from pyspark.sql import functions as F

import corpus_pipeline
from frameweft.llm import secrets, toxicity
from frameweft.llm.fuzzy_lines import LineConfig, fuzzy_lines
from frameweft.llm.minhash_dedup import near_duplicates
from frameweft.llm.queries import op1_fuzzy_lines

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(4, 9))) for _ in range(n))


def test_fuzzy_lines_that_differ_in_a_word(spark, tmp_path):
    """Linked by edit similarity alone, at any length: one word of each line is another."""
    rng = random.Random(12)
    rows = []
    for i in range(200):
        line = words(rng, rng.randint(7, 40)).split(" ")
        rows.append((i, " ".join(line)))
        line[rng.randrange(len(line))] = words(rng, 1)[:4]
        rows.append((1000 + i, " ".join(line)))
    rows += [(5000, "short titel"), (5001, "short title")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.first_doc_id for r in op1_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert sum(found[1000 + i] == i for i in range(200)) >= 196 and all(found[i] == i for i in range(200))
    assert found[5001] == 5000


def test_pipeline_drops_near_duplicates_of_five_words(spark):
    """0.8 of the union of 5-word shingles links: a copy with 22 % appended goes, one with scattered edits stays."""
    rng = random.Random(13)
    base, other = words(rng, 400).split(" "), words(rng, 400).split(" ")
    edited = other[:]
    for i in range(20, 400, 38):
        edited[i] = "x" + edited[i]
    texts = [" ".join(base), " ".join(base) + " " + words(rng, 88), " ".join(other), " ".join(edited)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3]


def test_secrets_with_few_digits_are_found():
    """Random strings with no digit or one are scored, and a token with a run of hex digits in it is masked whole."""
    rng = random.Random(14)
    letters = LETTERS + LETTERS.upper()
    bodies = ["".join(rng.choice(letters) for _ in range(rng.randint(22, 36))) + rng.choice(("", "7")) for _ in range(200)]
    found = secrets.scan([f"{words(rng, 3)} ghp_{b} {words(rng, 2)}" for b in bodies])
    assert sum(bool(f) for f in found) > 180
    token = "Zq" + "0f3a91" * 4 + "XwKpTzRvLmQb"
    assert any(s == 4 and e == 4 + len(token) for s, _, e in secrets.scan([f"see {token} now"])[0])
    plain = ["Verantwortungsbereiche der Zusammenarbeit", "=" * 40, "in internationalisation/localisation", "write to firstname.familyname@example.com"]
    assert not any(secrets.scan(plain))


def test_toxicity_thresholds_cover_all_labels(spark):
    """A language without a row in the sample that is fitted gets its threshold from the labelled rows beyond it."""
    rng = random.Random(15)
    vile = lambda i: i % 3 == 0
    rows = [(i, words(rng, 12) + (" vile " if vile(i) else " kind ") + words(rng, 6)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(vile(i))) for i in range(600)], "doc_id long, toxic int")
    usable = docs.where("pmod(crc32(cast(doc_id as string)), 5) <> 0").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = {r.doc_id for r in usable.limit(200).collect()}
    docs = docs.withColumn("lang", F.when(F.col("doc_id").isin(sample), "en").otherwise("xx"))
    model = toxicity._fitted(docs, labels, toxicity.ToxicConfig(rows=200), "doc_id", "text", "lang")
    assert set(model.thresholds) == {None, "en", "xx"}


def test_near_duplicates_of_texts_under_one_id(spark):
    """Two texts with one id: each is compared as itself, and both links hold."""
    rng = random.Random(16)
    one, two = words(rng, 200), words(rng, 200)
    rows = [(1, one + " end"), (2, two + " end"), (7, one), (7, two), (8, words(rng, 50))]
    found = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, 1), (2, 1), (7, 1), (8, 8)}


def test_fuzzy_lines_compares_all_of_a_large_bucket(spark):
    """No line is left out for the size of its bucket, nor for few words in common: 300 lines of the same long words and
    unlike short ones share all buckets. Two pairs of these are alike, one by short words alone."""
    rng = random.Random(17)
    common = "measurement instrument calibration"
    lines = [common + " " + " ".join("".join(rng.choice(LETTERS) for _ in range(4)) for _ in range(30)) for _ in range(300)]
    near = lines[7].split(" ")
    for i in range(4, 27):  # a letter of most words: under a third of the words are in common, but 0.8 of the letters
        near[i] = "9" + near[i][1:]
    lines += [" ".join(near), lines[11] + " also", "x " + lines[13][:-20]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for split in (256, 40):
        found = {r.doc_id: r.first_id for r in fuzzy_lines(docs, cfg=LineConfig(split=split)).collect()}
        assert found == {i: i for i in range(300)} | {300: 7, 301: 11, 302: 13}


def test_fuzzy_lines_with_edits_between_the_levels(spark):
    """Lines of unequal numbers of words that are 15 to 60 edits apart, all within a fifth of the length."""
    rng = random.Random(18)
    base = words(rng, 90)
    far = base.split(" ")
    for i in range(3, 83, 10):
        far[i] = words(rng, 1)
    lines = [base, *(" ".join(far[:n] + base.split(" ")[n:]) + " " + words(rng, 1 + n // 20) for n in (20, 40, 60, 80))]
    found = fuzzy_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.first_id for r in found} == {0}


def test_fuzzy_lines_drops_unlike_pairs_by_counts(spark, monkeypatch):
    """Lines of the same long words that are made of other letters share all buckets, but their pairs aren't made: the
    counts of characters tell them apart. Those that are alike are found, with words moved, put in, taken out and changed."""
    import sys

    module, compared = sys.modules["frameweft.llm.fuzzy_lines"], []

    def counted(pairs, texts, cfg, label):
        compared.append((label, pairs.count()))
        return similar(pairs, texts, cfg, label)

    similar = module._similar
    monkeypatch.setattr(module, "_similar", counted)
    rng = random.Random(19)
    common = "measurement instrument calibration"
    lines = [f"{common} " + " ".join("".join(rng.choice(LETTERS[i % 13] + LETTERS[13 + i // 13]) for _ in range(4)) for _ in range(30)) for i in range(78)]
    near = lines[5].split(" ")
    near[4], near[9], near[20] = "zzzzz", "", near[20] + " zz"
    lines += [" ".join(near), lines[70] + " measurement"]
    found = {r.doc_id: r.first_id for r in fuzzy_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert found == {i: i for i in range(78)} | {78: 5, 79: 70}
    assert sum(n for label, n in compared if label != "first-links") < 300


def test_fuzzy_lines_of_many_words_are_compared_by_parts(spark):
    """Lines of 30,000 characters that differ every 30 words, of unlike words and of a passage over and over, are linked
    without a comparison of all characters with all, which takes seconds for a pair."""
    rng = random.Random(20)
    lines, first = [], []
    for text in (words(rng, 4000), " ".join([words(rng, 60)] * 67)):
        for i in range(9):
            copy = text.split(" ")
            for at in range(3 + i, len(copy), 30):
                copy[at] = rng.choice(("", rng.choice(copy), f"{copy[at]} {rng.choice(copy)}"))
            lines.append(" ".join(copy))
            first.append(len(lines) - 1 - i)
    lines.append(" ".join(sorted(lines[0].split(" "))))  # the same words, but another line
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r.first_id for r in fuzzy_lines(docs).collect()}
    assert found == dict(enumerate([*first, 18]))
    assert time.time() - began < 60

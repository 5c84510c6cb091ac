"""documents to packed sequences: toxicity, exact dedup, near-dedup, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameweft.llm.exact_dedup import drop_exact_duplicates
from frameweft.llm.minhash_dedup import drop_near_duplicates
from frameweft.llm.packing import packed
from frameweft.llm.secrets import redacted
from frameweft.llm.shared import fresh, materialize, release
from frameweft.llm.tokenizer_files import path_of
from frameweft.llm.toxicity import toxic_scores

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects. It is fitted on labelled rows of docs.

    Null and empty texts, and texts without letters, have no response and are kept; so are rows
    that repeat. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, toxic = fresh(docs, "_score"), fresh(docs, "_toxic")
    return toxic_scores(docs, labels, score=score, toxic=toxic).where(~F.col(toxic)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the documents with equal texts, white space aside: the one with the most code points,
    then the smallest doc_id. Null and empty texts are equal. Rows with a null doc_id stay."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of similar ones: 5-word shingles at 80 %, of which bands of 4 miss 5e-8.

    The smallest doc_id stays. Texts without words and rows with a null doc_id stay, too.
    """
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets, and counts the characters of what that leaves; n_chars of a null text is null."""
    return redacted(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with their token ids; a null or empty text is the end token alone."""
    return packed(docs, path_of("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: A fitted classifier and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES on documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)

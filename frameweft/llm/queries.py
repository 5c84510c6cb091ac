"""The queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip_digests
from .exact_dedup import exact_duplicates
from .fuzzy_lines import fuzzy_lines
from .hnsw import nearest
from .line_hash import repeated_units
from .minhash_dedup import NearConfig, near_duplicates
from .packing import packed
from .secrets import secret_spans
from .suffix_dedup import repeated_passages
from .tokenizer_files import path_of
from .toxicity import toxic_scores

TOKENIZER = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of documents, with the first line of its group of similar lines, by edit similarity alone."""
    return fuzzy_lines(_documents(spark, sf_dir)).withColumnRenamed("first_id", "first_doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic_scores(_documents(spark, sf_dir).select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_toxic").alias("rejected"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(_documents(spark, sf_dir), path_of(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words and 85 %; of 25 bands of 5 a pair at 85 % shares none with probability 4e-7."""
    return near_duplicates(_documents(spark, sf_dir), cfg=NearConfig(shingle=3, similar=85, bands=25, rows=5)).drop("row_hash")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(_documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("_spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("_spans").alias("spans"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(_documents(spark, sf_dir), path_of(TOKENIZER))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that documents repeat, by document."""
    return repeated_passages(_documents(spark, sf_dir)).withColumnRenamed("other_id", "other_doc_id")


def op9_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line and sentence of documents in a repeated passage of 30 words or more of whole ones, with the document that
    keeps it. A passage of 50 words that begins and ends within sentences holds so many of whole ones as a rule."""
    return repeated_units(_documents(spark, sf_dir), min_run=30).withColumnsRenamed({"first_id": "first_doc_id"})


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fuzzy_lines": op1_fuzzy_lines,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_hnsw_search": op4_hnsw_search,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_line_hash_dedup": op9_line_hash_dedup,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op9_line_hash_dedup": r"""
        with lines as (
            select doc_id, unnest(regexp_extract_all(text, '[^\n\x0b\x0c\r]+|[\n\x0b\x0c\r]+')) as line,
                   generate_subscripts(regexp_extract_all(text, '[^\n\x0b\x0c\r]+|[\n\x0b\x0c\r]+'), 1) as no
            from documents where doc_id is not null),
        pieces as (
            select doc_id, no, unnest(regexp_extract_all(line, '(?s)[ \t]*[^ \t]*?[.!?](?:[ \t]+|$)|[ \t]*[^ \t].*?[.!?](?:[ \t]+|$)|.+')) as piece,
                   generate_subscripts(regexp_extract_all(line, '(?s)[ \t]*[^ \t]*?[.!?](?:[ \t]+|$)|[ \t]*[^ \t].*?[.!?](?:[ \t]+|$)|.+'), 1) as part
            from lines),
        placed as (
            select *, coalesce(sum(length(piece)) over (partition by doc_id order by no, part rows between unbounded preceding and 1 preceding), 0) as before,
                   list_filter(string_split_regex(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
            from pieces),
        units as (
            select doc_id, (row_number() over (partition by doc_id order by no, part) - 1)::int as unit_no, len(words)::int as n_words, array_to_string(words, ' ') as unit,
                   (before + length(regexp_extract(piece, '^[\x20\x09-\x0D]*')))::int as start,
                   (before + length(piece) - length(regexp_extract(piece, '[\x20\x09-\x0D]*$')))::int as "end"
            from placed where len(words) > 0),
        ranked as (
            select *, count(*) over (partition by unit) as copies,
                   first_value(doc_id) over (partition by unit order by doc_id, unit_no) as first_doc_id,
                   first_value(unit_no) over (partition by unit order by doc_id, unit_no) as first_unit
            from units),
        runs as (
            select *, unit_no - row_number() over (partition by doc_id order by unit_no) as run from ranked where copies > 1),
        counted as (
            select *, (sum(n_words) over (partition by doc_id, run))::int as run_words from runs)
        select doc_id, unit_no, start, "end", n_words, doc_id = first_doc_id and unit_no = first_unit as kept, first_doc_id, first_unit, copies, run_words
        from counted where run_words >= 30""",
    "op10_exact_dedup": r"""
        with rows as (
            select doc_id, length(coalesce(text, '')) as chars,
                   translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') as body
            from documents)
        select doc_id,
               first_value(doc_id) over (partition by body order by chars desc, doc_id) as keep_id,
               count(*) over (partition by body) as group_size,
               doc_id = first_value(doc_id) over (partition by body order by chars desc, doc_id) as kept,
               sha256(body) as text_sha256
        from rows""",
}

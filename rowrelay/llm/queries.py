"""Registered queries on training text, with SQL where it can state the same result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowrelay.llm import ann, bpe, decontaminate, langid, licenses, lines, minhash, negatives, phrases, setjoin, shards, substrings, tokenfiles

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
VOCABULARY = 50_256  # ids of the rank file; the next one ends a document


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_line_dedup", lines.SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


@query("op2_decontaminate", decontaminate.SQL)
def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_interleave", shards.SQL)
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assignment(table(spark, sf_dir, "documents"))


@query("op4_minhash")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_languages")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


@query("op6_nearest")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_licenses")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_counts(table(spark, sf_dir, "documents"), RANKS, PATTERN, VOCABULARY)


@query("op9_substrings", substrings.SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


@query("op10_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, PATTERN)


@query("op11_hard_negatives", negatives.SQL)
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, shifted)


@query("op12_jaccard_join", setjoin.SQL)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.joined(table(spark, sf_dir, "documents"))


@query("op13_collocations", phrases.SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))

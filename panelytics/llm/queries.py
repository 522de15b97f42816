"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from panelytics.llm import decontaminate, licenses, lm_scoring, merkle, multi_index, pieces, sharding, simhash, token_counts, toxicity, url_filter, vector_codes, word_bpe
from panelytics.llm.common import table

RULES = [
    url_filter.rule("allow", "com/"),
    url_filter.rule("block", "example.com/en/"),
    url_filter.rule("allow", "www.example.com/en/"),
    url_filter.rule("block", "net/es/"),
    url_filter.rule("block", "net/fr/"),
]


def lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, folder, "documents"))


def urls(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), RULES)


def sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    encoded = pieces.encode_decode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.digests(encoded)


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.with_limit(counted, 1024)


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"), licenses.known_licenses(spark))


def contamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def toxic_spans(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.search(table(spark, folder, "embeddings"))


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audit(table(spark, folder, "documents"))


def byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return word_bpe.digests(word_bpe.encode_decode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm,
    "op2_url_filter": urls,
    "op3_sentencepiece": sentence_pieces,
    "op4_simhash": near_duplicates,
    "op5_token_counts": tokens,
    "op6_license_scan": license_scan,
    "op7_decontamination": contamination,
    "op8_toxicity": toxic_spans,
    "op9_nearest_neighbours": neighbours,
    "op10_sharding": shards,
    "op11_merkle_manifest": manifest,
    "op12_bpe": byte_pairs,
    "op13_vector_codes": codes,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {"op6_license_scan": licenses.scan_sql(), "op11_merkle_manifest": merkle.audit_sql(), "op13_vector_codes": vector_codes.compress_sql()}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

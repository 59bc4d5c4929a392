"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, html_wrappers, language_id, near_dedup, repetition, sharding, substring_dedup, token_files, warc
from .common import scratch, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch(spark, "warc"), chunk_bytes=16 << 10)


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"), 24)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_chunks", "n_repeated_chunks", "n_bytes", "removed_bytes", (done.removed_bytes > 0).alias("has_repeat"), "text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary())
    return token_files.checksums(token_files.read_token_files(spark, path))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_html_wrappers": op3_html_wrappers,
    "op4_sharding": op4_sharding,
    "op5_bpe": op5_bpe,
    "op6_minhash": op6_minhash,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
}
ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.ORACLE_SQL,
    "op3_html_wrappers": html_wrappers.ORACLE_SQL,
    "op6_minhash": near_dedup.ORACLE_SQL,
    "op7_decontamination": decontamination.ORACLE_SQL,
}

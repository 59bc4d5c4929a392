"""A corpus pipeline of the training-data operators; counted as part of foliodex.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliodex.llm import bpe, decontamination, near_dedup, queries, repetition, substring_dedup
from foliodex.llm.common import stored, table


def _of(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs whose id is among the verdicts' (a null id too)."""
    good = verdicts.select(F.col("doc_id").alias("_good")).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["_good"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return _of(docs, near_dedup.near_duplicates(docs, words=5, percent=80).where("kept"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the passages that another document has; a text of which nothing is left goes."""
    columns = docs.columns
    own = "_".join(["measures", *columns])  # a name that no column has
    done = substring_dedup.dedup_substrings(docs, measures=own)
    left = done.where((F.col(f"`{own}`.removed_bytes") == 0) | (F.length(F.trim("text")) > 0)).select([f"`{c}`" for c in columns])
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else left


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate."""
    return _of(docs, decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_decode(docs, queries.vocabulary())


STAGES = [
    ("quality rules", quality),
    ("minhash near-dedup", near_copies),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminate),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs

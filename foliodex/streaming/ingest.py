"""Incremental ingestion: new filing files become chunks and index tables, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, parse
from ..sources import files
from ..sources.staging import staged


def ingest(filings: DataFrame, root: str) -> DataFrame:
    """Parse and index filings (doc_name, source_filename, html), replacing earlier versions; a status row per filing.

    Of files that give one doc_name the first by name counts. A filing that has no chunks any more loses those of its earlier version.
    """
    first = filings.groupBy("doc_name").agg(F.min("source_filename").alias("source_filename"))
    filings = filings.join(first, ["doc_name", "source_filename"], "left_semi")
    chunks = parse.parse_filings(filings).persist()
    try:
        files.save(chunks, root, "chunks")
        counted = staged(index.tokenized(chunks), "terms")
        posts, stats = index.postings(counted), index.corpus_stats(counted)
        files.save(posts, root, "postings")
        files.save(stats, root, "corpus_stats")
        files.save(index.term_stats(posts, stats), root, "term_stats")
        meta = parse.filing_metadata(chunks).join(filings.select("doc_name", "source_filename"), "doc_name")
        files.save(meta, root, "filing_meta")
        status = filings.select("doc_name").join(chunks.groupBy("doc_name").agg(F.count("*").alias("n_chunks"), F.max("page_num").alias("pages")), "doc_name", "left")
        rows = status.select("doc_name", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "pages", F.when(F.col("n_chunks") > 0, "complete").otherwise("empty").alias("status"))
        files.save(rows, root, "ingest_status")
        empty = files.load(filings.sparkSession, root, "ingest_status").where("n_chunks = 0").join(filings.select("doc_name"), "doc_name", "left_semi")
        for name in ("chunks", "postings", "corpus_stats", "term_stats", "filing_meta", "vectors"):
            files.remove(filings.sparkSession, root, name, empty)
    finally:
        chunks.unpersist()
    return files.load(filings.sparkSession, root, "ingest_status").join(filings.select("doc_name"), "doc_name", "left_semi")


def stream_ingest(spark: SparkSession, folder: str, root: str, checkpoint: str):
    """Ingest the files that are new in a folder since the last run, then stop. Returns the finished query."""
    source = files.read_filings(spark, folder, stream=True)
    query = source.writeStream.foreachBatch(lambda df, _: ingest(df, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def embed_missing(spark: SparkSession, root: str, provider, model: str) -> DataFrame:
    """Vectors of chunks whose filings have none, made by provider.embed(chunks) -> (doc_name, chunk_index, embedding)."""
    chunks = files.load(spark, root, "chunks")
    try:
        have = files.load_vectors(spark, root, model).select("doc_name").distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        have = chunks.select("doc_name").limit(0)
    todo = chunks.join(have, "doc_name", "left_anti")
    vectors = provider.embed(todo).select("doc_name", "chunk_index", index.unit(F.col("embedding")).cast("array<float>").alias("embedding"), F.lit(model).alias("embedding_model"))
    files.save(vectors, root, "vectors")
    return files.load(spark, root, "vectors")

"""Operator 10, token-ID output: Parquet list columns of ids, in global id order.

Rows are range-partitioned by id and sorted, encoded, and written as one file a range: doc_id,
local_start (ids before it in the file) and n_tokens in delta encoding, ids as a dictionary-encoded list,
with fixed row groups and page rows, so that the page index lets a reader skip to a few documents. The
positions in the whole sequence need only the two narrow columns of each file: a file's base is
the sum of the totals of the files before it. A reader of positions never touches the ids.

Cases: a null text has no ids but the end id; rows of one id are ordered by text; null ids come
first; very long texts are one list; an empty table writes no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoding
from .common import arrow_map, pieces_of

FILE_SCHEMA = "doc_id long, local_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, row_group_bytes: int = 8 << 20, page_rows: int = 512) -> None:
    """Write the token files of docs into the folder `path`."""

    def run(batches):
        engine, before = encoding(vocabulary), 0
        for whole in batches:
            for batch in pieces_of(whole, text_col):
                end = np.array([end_id], np.uint32)
                raw = [np.concatenate((engine.encode_to_numpy(t or "", allowed_special="all"), end)) for t in batch.column(text_col).to_pylist()]
                counts = np.fromiter(map(len, raw), np.int64, len(raw))
                ends = before + np.cumsum(counts)
                flat = np.concatenate(raw).view(np.int32)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(ends - counts), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "local_start", "n_tokens", "ids"])
                before = int(ends[-1])

    rows = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))
    encoded = arrow_map(rows.repartitionByRange(id_col).sortWithinPartitions(id_col, text_col), run, FILE_SCHEMA)
    (
        encoded.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids; columns that are not used are not read."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # Spark names files by the number of their range, so names are in the order of ids
    named = files.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file"))
    ends = named.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    bases = ends.select("file", F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return named.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from rows of read_token_files."""

    def run(batches):
        for batch in batches:
            column = batch.column("ids")
            flat = np.asarray(column.flatten(), dtype="<u4")
            ends = np.cumsum(np.asarray(column.value_lengths()).astype(np.int64))
            view = memoryview(flat).cast("B") if len(flat) else memoryview(b"")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(tokens, run, "doc_id long, start long, n_tokens long, ids_crc32 long")

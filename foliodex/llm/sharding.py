"""Operator 4, sharding: contiguous shards of nearly equal bytes by global prefix sums.

Rows are put in one global order (range partitions, sorted within), each partition adds up its
sizes, the per-partition totals (one small row a partition) give every partition its offset, and
a row's shard follows from where its middle byte falls among equal targets. No row moves
after the one range shuffle of narrow columns, so a hot source or a large group of equal texts
costs nothing special; such a group is spread like any other rows.

Cases: a null text has no bytes; null ids come first; rows with the same id are ordered by the checksum of
their text and then arbitrarily, but each gets a slot of its own; an empty table gives an empty
one; fewer rows than shards leave some shards empty. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, scratch


def numbered_ranges(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """df in global order as a stored table, with part (its range) and place (1, 2, ... in it).

    The ranges are drawn from a sample, so they are fixed by writing them once.
    """
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)

    def number(batches):
        import numpy as np
        import pyarrow as pa

        done = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(done + 1, done + 1 + batch.num_rows))], [*batch.schema.names, "place"])
            done += batch.num_rows

    ranged = arrow_map(df.repartitionByRange(*by).sortWithinPartitions(*by), number, f"{fields}, place long").withColumn("part", F.spark_partition_id())
    path = scratch(df.sparkSession, label)
    ranged.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def byte_shards(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", per_row: int = 8) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    raw = F.encode(F.col(text_col), "utf-8")
    slim = docs.select(
        F.col(id_col).cast("long").alias(id_col),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + per_row).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).alias("text_crc32"),
    )
    rows = numbered_ranges(slim, [id_col, "text_crc32"], "ranges")
    within = rows.withColumn("so_far", F.sum("size").over(Window.partitionBy("part").orderBy("place")))
    # one row a partition: the window without keys below sees only these
    totals = rows.groupBy("part").agg(F.sum("size").alias("part_size"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("part_size").over(every), F.lit(0)).alias("offset"), F.sum("part_size").over(Window.partitionBy()).alias("total"))
    placed = within.join(F.broadcast(offsets), "part")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * (offset + so_far - size) + size) * {shards} div (2 * total)")).cast("int"))
    # slots: a shard's rows in earlier partitions, then the place within this one; at most partitions + shards rows
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    firsts = counts.select("shard", "part", (F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(firsts), ["shard", "part"]).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

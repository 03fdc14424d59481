"""Operator 10: contiguous shards of nearly equal size, from global prefix sums of per-partition totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, tasks


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the bytes and the rows that stand before each row in its partition."""
    done = rows = 0
    for b in batches:
        sizes = b.column("size").to_numpy()
        ends = done + np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - sizes), pa.array(rows + np.arange(len(sizes)))], [*b.schema.names, "before", "row"])
        if len(sizes):
            done, rows = int(ends[-1]), rows + len(sizes)


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the rows, ordered by (id, text crc32, size), into contiguous shards of nearly equal UTF-8 bytes.

    The size of a row is the bytes of its text (null: none) plus 1. Only (id, size, crc32) is ever shuffled: one range
    exchange orders the rows, each partition sums its own rows, and the totals, one row a partition, are summed to offsets.
    A row goes to the shard in which its middle byte falls, so a shard's size is off by one row's size at most.

    Null ids come first. Repeated ids stay repeated rows. An empty table gives an empty result. Other columns of docs are ignored.
    Returns id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in a shard), grown_shard (null)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    keys = ["doc_id", "text_crc32", "size"]
    ordered = rows.repartitionByRange(tasks(spark), *keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id())
    summed = materialise(ordered.mapInArrow(_running, "doc_id long, size long, text_crc32 long, pid int, before long, row long"))
    # one row a partition: its number does not grow with the rows of a partition
    totals = summed.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "pid",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes0"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows0"),
        F.sum("bytes").over(every).alias("total"),
    )
    placed = summed.join(F.broadcast(offsets), "pid").select(
        *keys,
        F.least(F.lit(shards - 1), F.expr(f"((2 * (bytes0 + before) + size) * {shards}) div (2 * total)")).cast("int").alias("shard"),
        (F.col("rows0") + F.col("row")).alias("place"),
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

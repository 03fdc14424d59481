"""Sinks: partitioned chunk tables written once a file, CSV exports, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_new(df: DataFrame, path: str, done: DataFrame | None, key: str = "source_file", partition: str | None = None) -> None:
    """Append the files that are not done yet."""
    rows = df if done is None else df.join(done.select(key), key, "left_anti")
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays are joined by '; '."""
    flat = [F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Dead letters as JSON lines by reason."""
    rejects.write.mode("append").partitionBy("reason").json(path)


def review_lines(proposals: DataFrame) -> DataFrame:
    """Proposed rewrites as lines to approve: '[ ] variant => canonical (n/m)'."""
    return proposals.select(F.format_string("[ ] %s => %s (%d/%d)", "variant", "canonical", "variant_count", "canonical_count").alias("value"))


def approved(lines: DataFrame) -> DataFrame:
    """The rewrites that were marked [x] in a review."""
    pattern = r"^\[[xX]\]\s*(.+?)\s*=>\s*(.+?)\s*\(\d+/\d+\)\s*$"
    return lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("variant"), F.regexp_extract("value", pattern, 2).alias("canonical"))

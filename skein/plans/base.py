"""The supplied tables read as the engine's entities, in Spark and, for the oracle, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts: a key with folders, a count of chunks, a length in seconds, a date for most, speakers."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "text", "lang", "source", "n_chars",
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("source_file"),
        F.expr("n_chars div 2000").alias("n_chunks"), (F.col("n_chars") / 16.0).alias("duration_sec"),
        F.when(F.col("doc_id") % 7 != 0, F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 900).cast("int"))).alias("session_date"),
        F.array("source", "lang").alias("speakers"),
    )


DOCS = """docs AS (
  SELECT doc_id, text, lang, source, n_chars, source || '/' || lang || '/' || doc_id AS source_file, n_chars // 2000 AS n_chunks, n_chars / 16.0::DOUBLE AS duration_sec,
    CASE WHEN doc_id % 7 <> 0 THEN DATE '2023-01-01' + CAST(doc_id % 900 AS INTEGER) END AS session_date, [source, lang] AS speakers
  FROM documents
)"""
#: The engine's tokenizer and word splitter in DuckDB.
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


def tokens(column: str) -> str:
    return TOKENS.format(column)


def words(column: str) -> str:
    return WORDS.format(column)

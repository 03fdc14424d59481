"""Registered queries that run the tables as streams: their files arrive in several batches, and results are read from the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.shared import shared_folder
from ..sources.stores import Stores
from ..streaming import ledger, thoughts
from .base import documents, table


def _arriving(df: DataFrame, files: int = 6, at_once: int = 2) -> DataFrame:
    """df as a stream: written as files, some of which make a batch."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", at_once).parquet(path)


def streamed_ingest(spark, sf_dir) -> DataFrame:
    """Documents ingested by source and language in batches; the ledger beside what the table holds of each file."""
    d = documents(spark, sf_dir).select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("source_file"), "doc_id", "text")
    stores = Stores(spark, shared_folder(spark), {"chunks": "source_file", "ledger": "source_file"})
    ledger.ingest(_arriving(d), stores, shared_folder(spark), lambda rows: rows.select("source_file", "doc_id", F.length("text").alias("n_chars")))
    held = stores.table("chunks").groupBy("source_file").agg(F.sum("n_chars").alias("n_chars"))
    return ledger.ledger(stores).join(held, "source_file", "left").select("source_file", "status", "attempts", "n_rows", "n_chars")


def streamed_plays(spark, sf_dir) -> DataFrame:
    """Views by user from files of which a third come again later: each event counts once."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    again = e.where("event_id % 3 = 0")
    stores = Stores(spark, shared_folder(spark), {"plays": "user_id"})
    return ledger.run_counts(_arriving(e.unionByName(again)), stores, shared_folder(spark), "user_id", event_id="event_id").select("user_id", "plays")


def streamed_answers(spark, sf_dir) -> DataFrame:
    """Assistants' turns with think blocks, cut into pieces of 37 characters that arrive out of order, as shown in the end."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    thought = F.concat(F.lit("<think>"), F.col("text"), F.when(F.col("turn") % 4 == 1, F.lit("\n</THINK>")).otherwise(F.lit("")), F.col("text"))
    whole = c.select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), thought.alias("answer"))
    cuts = whole.select("answer_id", "answer", F.ceil(F.length("answer") / 37).alias("n")).select("answer_id", "n", "answer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("seq"))
    pieces = cuts.select("answer_id", "seq", F.substring("answer", F.col("seq").cast("int") * 37 + 1, F.lit(37)).alias("piece"), (F.col("seq") == F.col("n") - 1).alias("last"))
    path, place = shared_folder(spark), shared_folder(spark)
    with thoughts.named_states(spark):
        thoughts.shown_stream(_arriving(pieces)).writeStream.format("parquet").option("path", path).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    shown = spark.read.schema("answer_id string, seq long, shown string").parquet(path).groupBy("answer_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "shown"))), lambda x: x["shown"]), "").alias("shown"))
    return whole.select("answer_id").join(shown, "answer_id", "left").select("answer_id", F.trim(F.coalesce("shown", F.lit(""))).alias("shown"))


SQL = {
    "streamed_ingest": "SELECT source || '/' || lang || '/' || doc_id AS source_file, 'ok' AS status, CAST(1 AS BIGINT) AS attempts, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1",
    "streamed_plays": "SELECT user_id, count(DISTINCT event_id) AS plays FROM events WHERE event_type = 'view' AND user_id IS NOT NULL GROUP BY 1",
    "streamed_answers": "SELECT conv_id || '-' || turn AS answer_id, CASE WHEN turn % 4 = 1 THEN trim(text, ' ') ELSE '' END AS shown FROM conversations WHERE role = 'assistant'",
}
QUERIES = {f.__name__: f for f in (streamed_ingest, streamed_plays, streamed_answers)}

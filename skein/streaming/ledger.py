"""Ingest as a stream into tables that change together with their ledger, and running counts in a keyed table.

Both write to Stores: a batch's rows and its ledger entries become readable in one step. A batch that is killed leaves its files in progress, with their tries
counted; when it comes again its rows replace those of the same files, so that a run with failures ends with the tables of one without."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..sources.stores import Stores

LEDGER = "source_file string, status string, attempts long, n_rows long, reason string, batch long"
#: Batches after which the parts of a table are written together.
COMPACT_EVERY = 16


def ledger(stores: Stores) -> DataFrame:
    """The ledger now: one row a file."""
    found = stores.table("ledger")
    return stores.spark.createDataFrame([], LEDGER) if found is None else found


def _entries(files: DataFrame, old: DataFrame, status: str, batch: int, more: int, counts: DataFrame | None = None, reason: str | None = None) -> DataFrame:
    """Entries of files with their tries so far and `more`."""
    known = files.join(old.select("source_file", "attempts"), "source_file", "left")
    sized = known.withColumn("n_rows", F.lit(None).cast("long")) if counts is None else known.join(counts, "source_file", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))
    return sized.select("source_file", F.lit(status).alias("status"), (F.coalesce("attempts", F.lit(0)) + more).cast("long").alias("attempts"), "n_rows", F.lit(reason).cast("string").alias("reason"), F.lit(batch).cast("long").alias("batch"))


def ingest(stream: DataFrame, stores: Stores, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, table: str = "chunks") -> None:
    """Ingest what has arrived (rows with source_file) into a table of stores and mark it in their table ledger.

    Files that are ok already are left out. A try is counted before rows are prepared; rows and the mark ok are committed together. Where preparing or writing
    fails, the batch's files are marked failed with the reason and the error goes on; the next run takes the batch up again."""

    def each(batch: DataFrame, number: int) -> None:
        old = ledger(stores)
        new = batch.where(F.col("source_file").isNotNull()).join(old.where("status = 'ok'").select("source_file"), "source_file", "left_anti")
        files = new.select("source_file").distinct()
        if files.isEmpty():
            return
        stores.change({"ledger": _entries(files, old, "in_progress", number, 1)}, files, ("ledger",))
        try:
            rows = prepare(new)
            counts = rows.groupBy("source_file").agg(F.count("*").alias("n_rows"))
            stores.change({table: rows, "ledger": _entries(files, ledger(stores), "ok", number, 0, counts)}, files)
        except Exception as error:
            reason = f"{type(error).__name__}: {error}"[:500]
            stores.change({"ledger": _entries(files, ledger(stores), "failed", number, 0, reason=reason)}, files, ("ledger",))
            raise
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            for name in stores.keys:
                stores.compact(name)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_counts(events: DataFrame, stores: Stores, checkpoint: str, key: str, kind: str = "view", event_id: str | None = None, table: str = "plays") -> DataFrame:
    """Count one kind of event by key, as a stream in update mode, into a keyed table of stores: (key, plays), what has arrived so far.

    A batch brings the new totals of the keys that it touches, which replace the old ones; the same batch again replaces them by themselves. With
    event_id an event counts once, in whatever files it stands; the state then holds every id, unless the stream has a watermark."""
    seen = events.where(F.col("event_type") == kind)
    once = seen.dropDuplicates([event_id]) if event_id else seen
    counts = once.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("plays"))

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            stores.change({table: batch}, batch.select(key), (table,))
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            stores.compact(table)

    counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = stores.table(table)
    return counts.sparkSession.createDataFrame([], counts.schema) if found is None else found

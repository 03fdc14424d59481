"""Index builds that can be run again: only rows that are new or have changed are made, each under an id that its key decides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import uuid5
from ..functions.text import summary_text
from ..sources.shared import kept
from ..sources.stores import Stores
from .vectors import embedded


def refresh(stores: Stores, table: str, rows: DataFrame, make: Callable[[DataFrame], DataFrame], prune: bool = False, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> int:
    """Bring a table of stores up to rows (its key, text and payload) and return how many rows were written.

    A row whose text is null or blank is left out. Rows whose key stands in the table with the same text are not made again; others go through make, get an
    id by their key and a digest of their text, and replace what their key had, all in one commit. With prune, keys that rows no longer have go too. A
    second run over the same rows writes nothing and commits nothing. Of several rows of a key the one with the smallest text counts."""
    key = stores.keys[table]
    good = rows.where(F.col(key).isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    # texts stay where they are: only keys and digests are compared, and those rows gathered by key whose key stands more than once
    digests = kept(good.select(key, F.sha2("text", 256).alias("digest")))
    repeated = kept(digests.groupBy(key).count().where("count > 1").select(key))
    chosen = kept(good.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*rows.columns), "text").alias("_r")).select("_r.*"))
    one = good.join(repeated, key, "left_anti").unionByName(chosen)
    marks = digests.join(repeated, key, "left_anti").unionByName(chosen.select(key, F.sha2("text", 256).alias("digest")))
    have = stores.table(table)
    changed = kept((marks if have is None else marks.join(have.select(key, "digest"), [key, "digest"], "left_anti")).select(key))
    gone = kept(have.select(key).join(marks.select(key), key, "left_anti")) if prune and have is not None else None
    count = changed.count()
    if not count and (gone is None or gone.isEmpty()):
        return 0
    new = (one if have is None else one.join(changed, key, "left_semi")).withColumn("digest", F.sha2("text", 256))
    made = make(new).withColumn("id", uuid5(namespace, F.col(key).cast("string")))
    stores.change({table: made}, changed if gone is None else changed.unionByName(gone), (table,))
    return count


def build_summaries(stores: Stores, files: DataFrame, embedder=None, prune: bool = False) -> int:
    """One vector a tagged file (source_file, title, topics, summary, other, tagged_at): files without a tag date are left out, as are those without any text."""
    text = summary_text(F.col("title"), F.col("topics"), F.col("summary"), F.col("other"))
    rows = files.where(F.col("tagged_at").isNotNull()).select("source_file", text.alias("text"), "title", "topics")
    return refresh(stores, "summaries", rows, lambda changed: embedded(changed, embedder=embedder), prune)

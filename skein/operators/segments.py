"""A full-text index that grows: immutable segments of postings, tombstones by source, compaction, and BM25 over what is live.

Document frequencies and mean lengths are merged at reading from the segments' rows, so that results equal those of an index built anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import token_count, tokens
from ..sources.stores import Stores
from .fulltext import bm25


class TextIndex:
    """Postings and lengths of documents (id, text, source_file) under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.stores = Stores(spark, path, {"postings": "source_file", "lengths": "source_file"})

    @staticmethod
    def _cut(docs: DataFrame) -> dict[str, DataFrame]:
        cut = docs.select("id", "source_file", tokens(F.col("text")).alias("toks")).select("id", "source_file", F.size("toks").alias("dl"), "toks")
        lengths = docs.select("id", "source_file", token_count(F.col("text")).alias("dl"))
        each = cut.select("id", "source_file", "dl", F.explode_outer("toks").alias("term")).where("term is not null")
        return {"postings": each.groupBy("term", "id", "source_file", "dl").agg(F.count("*").alias("tf")), "lengths": lengths}

    def add(self, docs: DataFrame, replace: bool = False) -> int:
        """Commit a segment of docs; with replace, their sources' earlier documents go in the same commit."""
        return self.stores.change(self._cut(docs), docs.select("source_file") if replace else None)

    def delete(self, sources: DataFrame) -> bool:
        """Hide all documents of the sources (first column); whether there were any."""
        return self.stores.delete(sources)

    def compact(self) -> None:
        for store in self.stores.keys:
            self.stores.compact(store)

    def postings(self) -> DataFrame:
        return self.stores.table("postings").select("term", "id", "tf", "dl")

    def stats(self) -> DataFrame:
        return self.stores.table("lengths").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def bm25(self, queries: DataFrame, k: int = 40) -> DataFrame:
        """(query_id, id, score, rank) over the live documents; an index without any finds nothing."""
        if self.stores.table("postings") is None:
            return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id long, score double, rank int")
        return bm25(queries, self.postings(), self.stats(), k)

"""Full text: mention counts by words, postings, and BM25."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import token_count, tokens
from ..sources.shared import kept

K1, B = 1.2, 0.75


def mentions(text: Column, term: str | Column) -> Column:
    """Whether a text has every word of the term; a term without words matches nothing."""
    asked = tokens(F.lit(term) if isinstance(term, str) else term)
    return (F.size(asked) > 0) & (F.size(F.array_except(asked, tokens(text))) == 0)


def count_mentions(df: DataFrame, term: str, speaker: str | None = None, text: str = "text", speakers: str = "speakers") -> DataFrame:
    found = df.where(mentions(F.col(text), term))
    if speaker:
        found = found.where(F.array_contains(speakers, speaker))
    return found.agg(F.count("*").alias("n"))


def top_elements(df: DataFrame, term: str, values: str, limit: int = 10, text: str = "text") -> DataFrame:
    """The most frequent elements of an array column over the rows that mention the term."""
    found = df.where(mentions(F.col(text), term)).select(F.explode(values).alias("value"))
    return found.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def top_groups(df: DataFrame, term: str, by: str, limit: int = 20, text: str = "text") -> DataFrame:
    found = df.where(mentions(F.col(text), term))
    return found.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def term_sums(df: DataFrame, terms: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Per group the rows that hold each single-word term, summed over the terms: a row with two of them counts twice."""
    each = df.select(by, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return each.join(terms.select(F.lower("term").alias("term")).distinct(), "term").groupBy(by).agg(F.count("*").alias("mentions"))


def postings(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(term, id, tf, dl): counts are made before anything is shuffled by term."""
    toks = df.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("toks")).select("id", F.size("toks").alias("dl"), "toks")
    # a word does not carry its text's words along for their number; explode() would have the text cut once more, to see whether it has any words
    each = toks.select("id", "dl", F.explode_outer("toks").alias("term")).where("term is not null")
    return each.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def asked_words(queries: DataFrame) -> DataFrame:
    """(query_id, term): the different words of each query (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def restricted(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The postings of the words asked for, written once. The semi-join sinks below the counts of postings, so that other words are not
    shuffled. The queries' words are broadcast only if Spark finds them small."""
    return kept(index.join(asked_words(queries).select("term").distinct(), "term", "left_semi"))


def bm25(queries: DataFrame, index: DataFrame, stats: DataFrame, k: int = 40) -> DataFrame:
    """(query_id, id, score, rank from 0) of the k best documents of each query (query_id, text): Okapi BM25, any word may match.

    index is postings(); stats one row (n, avgdl). What documents have of the words asked for is written, a row a document, and met by blocks of queries in
    Arrow batches: a common word does not make a row for each query and document that have it."""
    from . import word_scan

    asked = asked_words(queries)
    known = index.join(asked.select("term").distinct(), "term", "left_semi")
    said = kept(known.groupBy("id").agg(F.collect_list(F.struct("term", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))).alias("said")))
    df = said.select(F.explode("said.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = stats.select("n", F.coalesce("avgdl", F.lit(1.0))).first()
    weighed = kept(asked.join(df, "term").select("query_id", "term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))

    def value(entries: pa.StructArray) -> np.ndarray:
        tf, dl = (entries.field(c).to_numpy() for c in ("tf", "dl"))
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

    parts = [word_scan.best(said, word_scan.Asked(block, "idf"), value, lambda sums, _: np.round(sums, 6), k) for block in word_scan.asked_blocks(weighed)]
    return ranked(reduce(DataFrame.unionByName, parts), k)


def corpus_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents and their mean length in words."""
    return df.agg(F.count("*").alias("n"), F.avg(token_count(F.col(text))).alias("avgdl"))


def ranked(df: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query by score, ties by id, with ranks from 0.

    The limit stands on the bare row number, so that each task keeps k rows a query before anything is shuffled by query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)

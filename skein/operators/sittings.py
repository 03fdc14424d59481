"""What a reranker reads of catalog rows: a title alone says little, so that it is told in a sentence and followed by its sitting's details."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import lexical_scorer, top

#: Performers named at most, results where no scorer answers.
MOST_PERFORMERS, DEGRADED_K = 8, 4


def bodies(details: DataFrame, *by: str) -> DataFrame:
    """(by, sitting_key, body): the texts of details (sitting_key, id, text) of a sitting, in the order of their ids, a line each; blank ones aside."""
    told = details.where(F.col("sitting_key").isNotNull() & (F.col("text") != ""))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"])
    return told.groupBy(*by, "sitting_key").agg(F.array_join(parts, "\n").alias("body"))


def sentence() -> Column:
    """A title row's facts in words: kind and title, then place, day, season and performers as far as they are known."""
    known = lambda words, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(words), c.cast("string")))
    season = F.when(F.coalesce(F.col("season"), F.lit("")) != "", F.concat(F.lit("during "), F.col("season"), F.lit(" season")))
    who = F.when(F.size("performers") > 0, F.concat(F.lit("performed by "), F.array_join(F.slice("performers", 1, MOST_PERFORMERS), ", ")))
    rest = F.concat_ws(" ", known("at ", F.col("location")), known("on ", F.col("session_date")), season, who)
    lead = F.concat(F.coalesce(F.nullif(F.col("track_type"), F.lit("")), F.lit("track")), F.lit(": "), F.col("track_title"))
    return F.concat(lead, F.when(rest != "", F.concat(F.lit(", "), rest)).otherwise(F.lit("")))


def rerank_texts(pool: DataFrame, catalog: DataFrame) -> DataFrame:
    """The candidates (query_id, id, ...) with `read`, what a scorer reads of each.

    catalog: id, source_type, kind, text, sitting_key, track_title, track_type, location, session_date, season, performers. A title row of the catalog that has a
    title is told in a sentence, followed by its sitting's details: those among the query's own candidates, else those of the whole
    catalog, which only sittings asked for are gathered from. Every other row is its text. Displayed texts do not change."""
    rows = pool.join(catalog, "id")
    ours = F.coalesce(F.col("source_type") == "catalog", F.lit(False))
    titled = ours & (F.col("kind") == "track_title") & (F.coalesce(F.col("track_title"), F.lit("")) != "")
    details = catalog.where((F.col("source_type") == "catalog") & (F.col("kind") == "sitting_detail")).select("id", "sitting_key", "text")
    near = bodies(pool.select("query_id", "id").join(details, "id"), "query_id").withColumnRenamed("body", "_near")
    wanted = rows.where(titled).select("sitting_key").distinct()
    far = bodies(details.join(wanted, "sitting_key", "left_semi")).withColumnRenamed("body", "_far")
    joined = rows.join(near, ["query_id", "sitting_key"], "left").join(far, "sitting_key", "left")
    body = F.coalesce("_near", "_far")
    read = F.when(titled, F.concat(sentence(), F.when(body.isNotNull(), F.concat(F.lit(". "), body)).otherwise(F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    return joined.select(*pool.columns, read.alias("read"))


def rerank(pool: DataFrame, queries: DataFrame, catalog: DataFrame, k: int, scorer: Callable[[Column, Column], Column] | None = lexical_scorer) -> DataFrame:
    """(query_id, id, score, place) of the pool (query_id, id, score, place) by a score of query and what is read of a row, ties in the pool's order. Without a scorer,
    as when its service is down, the pool's own order holds, and DEGRADED_K rows a query whatever k was asked for."""
    if scorer is None:
        return pool.where(F.col("place") <= DEGRADED_K).select("query_id", "id", "score", "place")
    told = rerank_texts(pool.select("query_id", "id", F.col("place").alias("pool_place")), catalog).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    scored = told.select("query_id", "id", "pool_place", scorer(F.col("query"), F.col("read")).alias("score"))
    return top(scored, k, [F.desc("score"), F.col("pool_place")]).select("query_id", "id", "score", "place")

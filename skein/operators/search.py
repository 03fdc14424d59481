"""Retrieval pipelines over batches of queries: hybrid, quote, two-stage, catalog, multi-query and section search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import kept
from .filters import Filters, apply
from .fulltext import bm25, corpus_stats, postings
from .ranking import above_floor, arm_weights, fused_order, keep_best, lexical_scorer, rrf, top
from .vectors import embedded, nearest, nearest_within

#: Candidates of an arm, results at most and by default, files of a first stage, weights of the lexical arm by class.
CANDIDATES, MOST, DEFAULT_K, STAGE_FILES = 40, 40, 4, 6
LEXICAL_WEIGHT = {"thematic": 0.5, "name": 0.75, "quote": 0.85}


@dataclass
class Corpus:
    """What searches read: chunks (id, text, vector and facets), their postings and statistics, and a catalog of the same shape. Vectors that were written
    apart from the texts (id, source_file, vector) may stand beside chunks without them."""

    chunks: DataFrame
    index: DataFrame
    stats: DataFrame
    catalog: DataFrame | None = None
    vectors: DataFrame | None = None

    @classmethod
    def build(cls, chunks: DataFrame, catalog: DataFrame | None = None, embedder: Callable | None = None) -> Corpus:
        with_vectors = chunks if "vector" in chunks.columns else embedded(chunks, embedder=embedder)
        return cls(with_vectors, postings(chunks, "id"), corpus_stats(chunks), catalog)


def hybrid(corpus: Corpus, queries: DataFrame, filters: Filters | None = None, k: int = DEFAULT_K, bm25_weight: float = 0.5, include_catalog: bool = False, push_filters: bool = False, scorer: Callable[[Column, Column], Column] = lexical_scorer) -> DataFrame:
    """(query_id, id, score, place): dense and lexical arms of 40 each, fused by reciprocal ranks, filtered, cut, rescored.

    queries have query_id, text and vector. As a rule filters bear on the dense arm and again after the fusion, where a lexical
    row has no metadata of its own and so passes only a range of dates; push_filters applies them to both arms instead."""
    filters, k = filters or Filters(), min(k, MOST)
    dense_rows = apply(corpus.chunks, filters)
    arms = {"dense": nearest(queries, dense_rows.select("id", "vector"), CANDIDATES)}
    index = corpus.index.join(dense_rows.select("id"), "id", "left_semi") if push_filters and not filters.is_empty() else corpus.index
    arms["bm25"] = bm25(queries, index, corpus.stats, CANDIDATES)
    if include_catalog and corpus.catalog is not None:
        arms["catalog"] = nearest(queries, corpus.catalog.select("id", "vector"), CANDIDATES)
    fused = rrf(arms, arm_weights(bm25_weight))
    if not filters.is_empty() and not push_filters:
        dated_only = filters.date_range and Filters(date_range=filters.date_range) == Filters(**{**filters.__dict__, "year": None})
        kept = arms["dense"].select("query_id", "id").union(arms["catalog"].select("query_id", "id")) if "catalog" in arms else arms["dense"].select("query_id", "id")
        fused = fused if dated_only else fused.join(kept.distinct(), ["query_id", "id"], "left_semi")
    pool = top(fused, CANDIDATES * (2 if include_catalog else 1), fused_order())
    texts = corpus.chunks.select("id", "text")
    if include_catalog and corpus.catalog is not None:
        texts = texts.unionByName(corpus.catalog.select("id", "text"))
    return rerank(pool, queries, texts, k, scorer)


def rerank(pool: DataFrame, queries: DataFrame, texts: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = lexical_scorer) -> DataFrame:
    """The k best of the pool by a pluggable score of query and text, ties in the pool's order. The pool is written first, so that Spark sees when it is
    small and does not shuffle all texts."""
    both = kept(pool).join(texts, "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    scored = both.select("query_id", "id", scorer(F.col("query"), F.col("text")).alias("score"), F.col("place").alias("fused_place"))
    return top(scored, k, [F.desc("score"), F.col("fused_place")])


def find_quote(corpus: Corpus, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Hybrid search for words as they were said: a heavy lexical arm, no filters."""
    return hybrid(corpus, queries, None, k, LEXICAL_WEIGHT["quote"])


def summaries(queries: DataFrame, rows: DataFrame, k: int, filters: Filters | None = None, scorer: Callable[[Column, Column], Column] = lexical_scorer) -> DataFrame:
    """Search of one vector a file: filters before, none after."""
    found = nearest(queries, apply(rows, filters or Filters()).select("id", "vector"), CANDIDATES)
    return rerank(found.withColumn("place", F.col("rank") + 1), queries, rows.select("id", "text"), k, scorer)


def two_stage(corpus: Corpus, rows: DataFrame, queries: DataFrame, k: int = DEFAULT_K, files: int = STAGE_FILES) -> DataFrame:
    """Chunks of the files that a summary search finds first: each query meets the chunks of its files alone. A query without files is
    searched plainly. The catalog never takes part."""
    stage = summaries(queries, rows, files).select("query_id", F.col("id").alias("source_file"))
    placed = (corpus.chunks if corpus.vectors is None else corpus.vectors).select("id", "source_file", "vector")
    own = kept(stage.groupBy("query_id").agg(F.collect_set("source_file").alias("within")))
    inside = nearest_within(queries.join(own, "query_id"), placed, "source_file", CANDIDATES).select("query_id", "id", "score")
    plain = nearest(queries.join(own, "query_id", "left_anti"), placed, CANDIDATES)
    pool = top(inside.unionByName(plain.select("query_id", "id", "score")), CANDIDATES, [F.desc("score"), F.col("id")])
    return rerank(pool, queries, corpus.chunks.select("id", "text"), k)


def browse(catalog: DataFrame, filters: Filters, k: int) -> DataFrame:
    """Titles rather than details where there are any, newest first, undated last."""
    found = apply(catalog, filters)
    titles = found.where("kind = 'track_title'")
    chosen = titles.unionByName(found.where("kind <> 'track_title'").join(titles.limit(1).select(F.lit(1).alias("_t")), F.lit(True), "left_anti"))
    return chosen.orderBy(F.desc(F.coalesce("session_date", F.lit(""))), "id").limit(k)


def multi_query(corpus: Corpus, variants: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Variants (query_id, variant, text, vector) of a query searched in one plan; each id keeps its best row."""
    each = variants.withColumn("query_id", F.struct("query_id", "variant"))
    found = hybrid(corpus, each, None, MOST)
    lists = found.select("query_id.query_id", "query_id.variant", "id", "score", F.col("place").alias("rank"))
    return top(keep_best(lists), k, [F.desc("score"), F.col("variant"), F.col("rank"), F.col("id")])


def catalog_search(catalog: DataFrame, queries: DataFrame, k: int, filters: Filters | None = None) -> DataFrame:
    return summaries(queries, catalog, k, filters)


def cited(results: DataFrame, floor: float, abstain: bool = False) -> DataFrame:
    return above_floor(results, floor, abstain)


def as_results(found: DataFrame, chunks: DataFrame, fields: list[str]) -> DataFrame:
    """Hits (query_id, id, score) with their chunks as results: kind and source, score to four places, text, no null speakers, and a map of the
    fields that are known."""
    catalog = F.coalesce(F.col("source_type") == "catalog", F.lit(False))
    facts = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]), lambda _, v: v.isNotNull())
    return found.join(chunks, "id").select(
        "query_id", F.when(catalog, "catalog").otherwise("chunk").alias("result_type"), F.when(catalog, "catalog").otherwise("transcript").alias("source"), F.col("id").alias("chunk_id"), F.round("score", 4).alias("score"),
        F.coalesce("text", F.lit("")).alias("text"), "source_file", "start_sec", "end_sec", F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"), facts.alias("metadata"),
    )

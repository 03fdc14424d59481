"""Fusion and ranking: reciprocal ranks, keep-best merges, floors, min-max scales, composite scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

RRF_K = 60
#: Shares of a composite score.
WEIGHTS = {"semantic": 0.50, "mentions": 0.25, "duration": 0.15, "plays": 0.10}


def rrf(arms: dict[str, DataFrame], weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, arm, arm_rank): weighted reciprocal ranks of all arms (query_id, id, rank from 0) added by id.

    Arms in their order break ties, then ranks. One union and one aggregation, no outer joins."""
    parts = [df.select("query_id", "id", F.lit(i).alias("arm"), F.col("rank").alias("arm_rank"), (F.lit(weights[name]) / (k + F.col("rank") + 1)).alias("part")) for i, (name, df) in enumerate(arms.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.min(F.struct("arm", "arm_rank"))
    return every.groupBy("query_id", "id").agg(F.round(F.sum("part"), 8).alias("score"), best.alias("best")).select("query_id", "id", "score", "best.arm", "best.arm_rank")


def arm_weights(bm25_weight: float, catalog_weight: float | None = None) -> dict[str, float]:
    return {"dense": 1 - bm25_weight, "bm25": bm25_weight, "catalog": 1 - bm25_weight if catalog_weight is None else catalog_weight}


def fused_order() -> list[Column]:
    return [F.desc("score"), F.col("arm"), F.col("arm_rank"), F.col("id")]


def top(df: DataFrame, k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def keep_best(lists: DataFrame) -> DataFrame:
    """Of several variants' results (query_id, variant, id, score, rank) the best row of each id."""
    w = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "variant", "rank")
    return lists.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def above_floor(df: DataFrame, floor: float, abstain: bool = False, by: str = "query_id") -> DataFrame:
    """Rows scored strictly above floor; where none is, nothing if the query may abstain, else its best row. No floor at 0 or below."""
    if floor <= 0:
        return df
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    any_kept = F.max(F.col("score") > floor).over(Window.partitionBy(by))
    marked = df.withColumn("_best", best).withColumn("_any", any_kept)
    test = F.col("score") > floor
    return marked.where(test if abstain else test | (~F.col("_any") & (F.col("_best") == 1))).drop("_best", "_any")


def trim_relative(df: DataFrame, ratio: float, by: str = "query_id") -> DataFrame:
    """Rows scored at `ratio` of their query's best or more."""
    return df.withColumn("_top", F.max("score").over(Window.partitionBy(by))).where(F.col("score") >= ratio * F.col("_top")).drop("_top")


def min_max(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """df with the columns scaled 0 to 1 over each group; a constant tells nothing and is 0. Groups are summed up before they are joined, so
    that a large one is not gathered in a task."""
    bounds = df.groupBy(by).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: F.when(F.col(f"_hi_{c}") <= F.col(f"_lo_{c}"), F.lit(0.0)).otherwise((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))) for c in columns}
    return df.join(bounds, by).withColumns(scaled).select(*df.columns)


def composite(candidates: DataFrame, stats: DataFrame, k: int, key: str = "source_file") -> DataFrame:
    """The k best candidates (query_id, key, score) of each query by semantic score, mentions, duration and plays, each scaled
    over the query's candidates. Missing statistics are 0."""
    j = candidates.join(stats, key, "left")
    raw = {
        "semantic": F.col("score").cast("double"),
        "mentions": F.log1p(F.coalesce("mentions", F.lit(0)).cast("double")),
        "duration": F.log1p(F.coalesce("duration_sec", F.lit(0.0)).cast("double") / 60),
        "plays": F.log1p(F.coalesce("plays", F.lit(0)).cast("double")),
    }
    j = min_max(j.select("query_id", key, *[v.alias(n) for n, v in raw.items()]), list(raw), "query_id")
    total = sum((F.lit(w) * F.col(n) for n, w in WEIGHTS.items()), F.lit(0.0))
    scored = j.select("query_id", key, F.round(total, 4).alias("score"))
    return top(scored, k, [F.desc("score"), F.col(key)])


def lexical_scorer(query: Column, text: Column) -> Column:
    """The default reranker, a stand-in for a cross-encoder: the share of the query's words that a text has."""
    from ..functions.text import tokens

    asked = F.array_distinct(tokens(query))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(asked, tokens(text))), F.size(asked)), F.lit(0.0)), 4)


def lexical_nearest(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k texts (id, text) of the highest lexical score for each query (query_id, text), ties to the smaller id.

    Each text is cut once, where it is, and its words meet blocks of queries in Arrow batches. Texts that share no word score 0; those
    that can still be among the k have the smallest ids, of which twice k suffice."""
    from ..functions.text import tokens
    from . import word_scan
    from .fulltext import asked_words, ranked

    def share(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """counts / n to four places, half up."""
        return (counts.astype(np.int64) * 20_000 + n) // (2 * n) / 10_000

    said = texts.select("id", F.array_distinct(tokens(F.col("text"))).alias("said"))
    asked = asked_words(queries).withColumn("one", F.lit(1))
    shared = [word_scan.best(said, word_scan.Asked(block, "one"), lambda entries: np.ones(len(entries)), share, k) for block in word_scan.asked_blocks(asked)]
    first = texts.select("id").distinct().orderBy("id").limit(2 * k)
    none = queries.select("query_id").distinct().join(F.broadcast(first)).withColumn("score", F.lit(0.0))
    return ranked(reduce(DataFrame.unionByName, [*shared, none]).groupBy("query_id", "id").agg(F.max("score").alias("score")), k)

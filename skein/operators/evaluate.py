"""Measures of retrieval and of answers, over tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import tokens
from ..sources.shared import kept


def holders(passages: DataFrame, docs: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, id) of all documents (id, text) that hold a passage (query_id, text) word for word, found or not.

    Candidates are the documents that have the passage's rarest inner word (index is postings() of them); the first and the last word may be cut. A
    passage of fewer than three words is looked for by all of its words."""
    t = tokens(F.col("text"))
    each = passages.select("query_id", F.explode(F.array_distinct(F.when(F.size(t) > 2, F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(1)))).otherwise(t))).alias("term"))
    known = kept(index.join(each.select("term").distinct(), "term", "left_semi"))
    df = known.groupBy("term").agg(F.count("*").alias("df"))
    rarest = each.join(df, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    candidates = kept(known.join(rarest, "term").select("query_id", "id"))
    both = candidates.join(docs, "id").join(passages.select("query_id", F.col("text").alias("passage")), "query_id")
    return both.where(F.contains("text", "passage")).select("query_id", "id")


def first_hit(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, best_rank, worst_rank, n_found, n_expected): ranks, from 1, of the expected ids (query_id, id) among results
    (query_id, id, rank); best is the first of them, worst the last where all were found."""
    want = expected.groupBy("query_id").agg(F.count_distinct("id").alias("n_expected"))
    hits = results.join(expected.distinct(), ["query_id", "id"], "left_semi").groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    per = hits.groupBy("query_id").agg(F.min("rank").alias("best_rank"), F.max("rank").alias("_last"), F.count("*").alias("n_found"))
    j = want.join(per, "query_id", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return j.select("query_id", "best_rank", F.when(F.col("n_found") == F.col("n_expected"), F.col("_last")).alias("worst_rank"), "n_found", "n_expected")


def metrics(hits: DataFrame, by: str | None = None, at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """hit@k by the best rank, mean reciprocal ranks by the best and by the worst rank, and mean recall."""
    hit = [F.round(F.avg(F.coalesce((F.col("best_rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit_{k}") for k in at]
    mrr = [F.round(F.avg(F.coalesce(1 / F.col(c), F.lit(0.0))), 6).alias(n) for c, n in (("best_rank", "mrr_best"), ("worst_rank", "mrr_worst"))]
    recall = F.round(F.avg(F.col("n_found") / F.col("n_expected")), 6).alias("recall")
    grouped = hits.groupBy(by) if by else hits.groupBy()
    return grouped.agg(F.count("*").alias("n"), *hit, *mrr, recall)


def abstention(df: DataFrame, score: str, negative: str, floors: DataFrame) -> DataFrame:
    """For each floor: abstained are scores below it; precision and recall over true negatives, false abstentions over the others."""
    below = F.col(score) < F.col("floor")
    neg = F.col(negative)
    g = df.join(F.broadcast(floors)).groupBy("floor").agg(F.count_if(below & neg).alias("tp"), F.count_if(below & ~neg).alias("fp"), F.count_if(~below & neg).alias("fn"), F.count_if(~below & ~neg).alias("tn"))
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(fp, fp + tn).alias("false_abstention"))


def distribution(df: DataFrame, by: str, value: str, points: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact percentiles with linear interpolation, least and largest."""
    cols = [F.round(F.percentile(value, F.lit(p)), 6).alias(f"p{int(round(p * 100))}") for p in points]
    return df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.min(value), 6).alias("lowest"), F.round(F.max(value), 6).alias("highest"), *cols)


def retention(df: DataFrame, value: str, floors: DataFrame) -> DataFrame:
    return df.join(F.broadcast(floors)).groupBy("floor").agg(F.count_if(F.col(value) >= F.col("floor")).alias("kept"), F.count("*").alias("n"))


def latency(df: DataFrame, by: str, ms: str, recall: str) -> DataFrame:
    return df.groupBy(by).agg(F.round(F.median(ms), 6).alias("median_ms"), F.round(F.avg(ms), 6).alias("mean_ms"), F.round(F.avg(recall), 6).alias("mean_recall"))


def recall_share(found: Column, expected: Column) -> Column:
    return F.round(F.try_divide(F.size(F.array_intersect(F.array_distinct(found), F.array_distinct(expected))), F.size(F.array_distinct(expected))), 6)


def faithfulness(df: DataFrame) -> DataFrame:
    """Answers (query_id, positive, failed, abstained, supported, total): errors, abstentions, the mean share of supported sentences of
    positive queries, and the negative ones that were answered."""
    share = F.try_divide(F.col("supported"), F.col("total"))
    leak = ~F.col("positive") & ~F.col("abstained") & ~F.col("failed")
    return df.agg(F.count_if("failed").alias("failed"), F.count_if("abstained").alias("abstained"), F.round(F.avg(F.when(F.col("positive") & ~F.col("failed"), share)), 6).alias("faithfulness"), F.sort_array(F.collect_list(F.when(leak, F.col("query_id")))).alias("leaks"))

"""Registered queries of the retrieval plane, each with its oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import fulltext, ranking, search, vectors
from ..operators.filters import Filters, apply
from ..sources.shared import kept
from .base import DOCS, documents, table, tokens


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(v: DataFrame) -> DataFrame:
    return v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def _passages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _by_dot(q: DataFrame, v: DataFrame, k: int) -> DataFrame:
    """A second arm: the same vectors by their inner product."""
    return vectors.nearest(q, v, k, "dot")


def bm25_topk(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    found = fulltext.bm25(_passages(spark, sf_dir), fulltext.postings(d, "doc_id"), fulltext.corpus_stats(d), 10)
    return found.select("query_id", "id", F.round("score", 4).alias("score"))


def postings_summary(spark, sf_dir) -> DataFrame:
    p = fulltext.postings(documents(spark, sf_dir), "doc_id")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def cosine_topk(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vectors.nearest(_asked(v), v.select("id", "vector"), 10).select("query_id", "id", "score")


def filtered_cosine_topk(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vectors.nearest(_asked(v), v.where("label = 3").select("id", "vector"), 5).select("query_id", "id", "score")


def mean_pool(spark, sf_dir) -> DataFrame:
    pooled = vectors.mean_pool(_vectors(spark, sf_dir), "label", "vector")
    return pooled.select("label", F.round(F.element_at("vector", 1), 5).alias("x1"), F.round(vectors.norm(F.col("vector")), 5).alias("norm"))


def vector_guard(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    broken = F.when(F.col("id") % 10 == 0, F.slice("vector", 1, 63)).when(F.col("id") % 10 == 1, F.concat(F.slice("vector", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("vector"))
    return v.groupBy(vectors.is_good(broken, 64).alias("good")).agg(F.count("*").alias("n"))


def _arms(spark, sf_dir, third=False) -> dict[str, DataFrame]:
    v = _vectors(spark, sf_dir)
    q = _asked(v)
    arms = {"dense": vectors.nearest(q, v.select("id", "vector"), 40), "bm25": _by_dot(q, v.select("id", "vector"), 40)}
    if third:
        arms["catalog"] = vectors.nearest(q, v.where("label < 3").select("id", "vector"), 40)
    return arms


def rrf_fuse(spark, sf_dir) -> DataFrame:
    fused = ranking.rrf(_arms(spark, sf_dir), ranking.arm_weights(0.65))
    return ranking.top(fused, 10, ranking.fused_order()).select("query_id", "id", "score", "place")


def rrf_three_arm(spark, sf_dir) -> DataFrame:
    fused = ranking.rrf(_arms(spark, sf_dir, True), ranking.arm_weights(0.5))
    return ranking.top(fused, 10, ranking.fused_order()).select("query_id", "id", "score", "place")


def multi_query_merge(spark, sf_dir) -> DataFrame:
    a = _arms(spark, sf_dir)
    lists = a["dense"].withColumn("variant", F.lit(0)).unionByName(a["bm25"].withColumn("variant", F.lit(1)))
    return ranking.keep_best(lists).select("query_id", "id", "variant", "score")


def citation_floor(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return ranking.above_floor(vectors.nearest(_asked(v), v.where("id % 50 <> 0").select("id", "vector"), 10), 0.4).select("query_id", "id", "score")


def citation_floor_abstain(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return ranking.above_floor(vectors.nearest(_asked(v), v.where("id % 50 <> 0").select("id", "vector"), 10), 0.4, abstain=True).select("query_id", "id", "score")


def relevance_trim(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return ranking.trim_relative(vectors.nearest(_asked(v), v.where("id % 50 <> 0").select("id", "vector"), 10), 0.8).select("query_id", "id", "score")


def minmax_normalise(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    scaled = ranking.min_max(d.select("doc_id", "lang", F.col("n_chars").cast("double").alias("x")), ["x"], "lang")
    return scaled.select("doc_id", F.round("x", 6).alias("scaled"))


def best_rank(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    candidates = d.select(F.col("lang").alias("query_id"), "source_file", (F.col("doc_id") % 97 / 97.0).alias("score"))
    terms = spark.createDataFrame([("the",), ("de",), ("der",)], "term string")
    mentions = fulltext.term_sums(d, terms, "source_file")
    plays = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("plays"))
    stats = d.select("doc_id", "source_file", "duration_sec").join(mentions, "source_file", "left").join(plays, "doc_id", "left")
    return ranking.composite(candidates, stats.drop("doc_id"), 10).select("query_id", "source_file", "score", "place")


def metadata_filter(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).withColumnRenamed("lang", "primary_language").withColumn("topics", F.col("speakers"))
    f = Filters(primary_language="en", topics=["src1", "src2", "src3"], date_range=("2023-02-01", "2024-06-30"))
    return apply(d, f).select("doc_id")


def post_filter(spark, sf_dir) -> DataFrame:
    """After a fusion rows without a date pass a date range; any other filter drops what cannot prove membership."""
    d = documents(spark, sf_dir).withColumnRenamed("lang", "primary_language")
    return apply(d, Filters(date_range=("2023-02-01", "2023-06-30")), lenient_dates=True).select("doc_id")


def hybrid_search(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source_file")
    q = vectors.embedded(_passages(spark, sf_dir))
    return search.hybrid(search.Corpus.build(d), q, k=10).select("query_id", "id", "score", "place")


def quote_search(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source_file")
    return search.find_quote(search.Corpus.build(d), vectors.embedded(_passages(spark, sf_dir)), 10).select("query_id", "id", "score", "place")


def two_stage_search(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_file"))
    v = kept(vectors.embedded(d).select("id", "source_file", "vector"))
    rows = vectors.mean_pool(v, "source_file", "vector").select(F.col("source_file").alias("id"), "vector", F.col("source_file").alias("text"))
    corpus = search.Corpus(d, fulltext.postings(d, "id"), fulltext.corpus_stats(d), vectors=v)
    return search.two_stage(corpus, rows, vectors.embedded(_passages(spark, sf_dir)), 10).select("query_id", "id", "score", "place")


def multi_query_search(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source_file")
    p = _passages(spark, sf_dir)
    variants = p.withColumn("variant", F.lit(0)).unionByName(p.select("query_id", F.array_join(F.reverse(F.split("text", " ")), " ").alias("text")).withColumn("variant", F.lit(1)))
    return search.multi_query(search.Corpus.build(d), vectors.embedded(variants), 10).select("query_id", "id", "score")


def catalog_browse(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    rows = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "track_title").otherwise("sitting_detail").alias("kind"), F.date_format("session_date", "yyyy-MM-dd").alias("session_date"), F.col("lang").alias("primary_language"))
    return search.browse(rows, Filters(primary_language="fr"), 20).select("id", "kind", "session_date")


def rerank_lexical(spark, sf_dir) -> DataFrame:
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return ranking.lexical_nearest(_passages(spark, sf_dir), texts, 3).select("query_id", "id", "score")


_COS = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6)"
_DOT = "round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6)"


def _arm(score: str, k: int, where: str = "true") -> str:
    return f"""(SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, {score} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND {where})) WHERE rank < {k})"""


def _rrf(parts: list[tuple[str, float]]) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, id, {i} AS arm, rank, {w}::DOUBLE / (60 + rank + 1) AS part FROM {a}" for i, (a, w) in enumerate(parts))
    return f"""WITH u AS ({union}), f AS (SELECT query_id, id, round(sum(part), 8) AS score, min((arm, rank)) AS best FROM u GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, id) AS INTEGER) AS place FROM f) WHERE place <= 10"""


_NEAR10 = _arm(_COS, 10, "c.vec_id % 50 <> 0")
SQL = {
    "bm25_topk": f"""WITH t AS (SELECT doc_id, {tokens('text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id AS query_id, unnest(list_distinct({tokens('text')})) AS term FROM benchmark),
r AS (SELECT query_id, doc_id AS id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), s GROUP BY 1, 2)
SELECT query_id, id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM r) WHERE k <= 10""",
    "postings_summary": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY 1",
    "cosine_topk": f"SELECT query_id, id, score FROM {_arm(_COS, 10)}",
    "filtered_cosine_topk": f"SELECT query_id, id, score FROM {_arm(_COS, 5, 'c.label = 3')}",
    "mean_pool": "WITH m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) SELECT label, round(max(x) FILTER (pos = 1), 5) AS x1, round(sqrt(sum(x * x)), 5) AS norm FROM m GROUP BY 1",
    "vector_guard": "SELECT vec_id % 10 > 1 AS good, count(*) AS n FROM embeddings GROUP BY 1",
    "rrf_fuse": _rrf([(_arm(_COS, 40), 0.35), (_arm(_DOT, 40), 0.65)]),
    "rrf_three_arm": _rrf([(_arm(_COS, 40), 0.5), (_arm(_DOT, 40), 0.5), (_arm(_COS, 40, "c.label < 3"), 0.5)]),
    "multi_query_merge": f"""WITH u AS (SELECT *, 0 AS variant FROM {_arm(_COS, 40)} UNION ALL SELECT *, 1 FROM {_arm(_DOT, 40)})
SELECT query_id, id, variant, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, variant, rank) AS n FROM u) WHERE n = 1""",
    "citation_floor": f"""WITH r AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM {_NEAR10}) SELECT query_id, id, score FROM r WHERE score > 0.4 OR (top <= 0.4 AND rank = 0)""",
    "citation_floor_abstain": f"SELECT query_id, id, score FROM {_NEAR10} WHERE score > 0.4",
    "relevance_trim": f"SELECT query_id, id, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM {_NEAR10}) WHERE score >= 0.8::DOUBLE * top",
    "minmax_normalise": "SELECT doc_id, round(CASE WHEN hi <= lo THEN 0.0::DOUBLE ELSE (n_chars - lo) / (hi - lo)::DOUBLE END, 6) AS scaled FROM (SELECT *, min(n_chars) OVER (PARTITION BY lang) AS lo, max(n_chars) OVER (PARTITION BY lang) AS hi FROM documents)",
    "best_rank": f"""WITH {DOCS}, m AS (SELECT source_file, count(*) AS mentions FROM (SELECT source_file, unnest(list_distinct({tokens('text')})) AS w FROM docs) WHERE w IN ('the', 'de', 'der') GROUP BY 1),
p AS (SELECT user_id AS doc_id, count(*) AS plays FROM events WHERE event_type = 'view' GROUP BY 1),
r AS (SELECT lang AS query_id, source_file, doc_id % 97 / 97.0::DOUBLE AS semantic, ln(1 + coalesce(mentions, 0)) AS mentions, ln(1 + duration_sec / 60) AS duration, ln(1 + coalesce(plays, 0)) AS plays FROM docs LEFT JOIN m USING (source_file) LEFT JOIN p USING (doc_id)),
x AS (SELECT query_id, source_file, {', '.join(f"CASE WHEN max({c}) OVER w <= min({c}) OVER w THEN 0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END AS {c}" for c in ("semantic", "mentions", "duration", "plays"))} FROM r WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT query_id, source_file, round(0.5::DOUBLE * semantic + 0.25::DOUBLE * mentions + 0.15::DOUBLE * duration + 0.1::DOUBLE * plays, 4) AS score FROM x)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_file) AS INTEGER) AS place FROM s) WHERE place <= 10""",
    "metadata_filter": f"WITH {DOCS} SELECT doc_id FROM docs WHERE lang = 'en' AND list_has_any(speakers, ['src1', 'src2', 'src3']) AND session_date BETWEEN DATE '2023-02-01' AND DATE '2024-06-30'",
    "post_filter": f"WITH {DOCS} SELECT doc_id FROM docs WHERE session_date IS NULL OR session_date BETWEEN DATE '2023-02-01' AND DATE '2023-06-30'",
    "catalog_browse": f"WITH {DOCS} SELECT doc_id AS id, 'track_title' AS kind, strftime(session_date, '%Y-%m-%d') AS session_date FROM docs WHERE lang = 'fr' AND doc_id % 3 = 0 ORDER BY coalesce(strftime(session_date, '%Y-%m-%d'), '') DESC, id LIMIT 20",
    "rerank_lexical": f"""WITH q AS (SELECT item_id AS query_id, list_distinct({tokens('text')}) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct({tokens('text')}) AS t FROM documents),
s AS (SELECT query_id, doc_id AS id, round(len(list_intersect(w, t)) / len(w)::DOUBLE, 4) AS score FROM q, d)
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 3""",
}
QUERIES = {f.__name__: f for f in (
    bm25_topk, postings_summary, cosine_topk, filtered_cosine_topk, mean_pool, vector_guard, rrf_fuse, rrf_three_arm, multi_query_merge, citation_floor, citation_floor_abstain, relevance_trim, minmax_normalise,
    best_rank, metadata_filter, post_filter, hybrid_search, quote_search, two_stage_search, multi_query_search, catalog_browse, rerank_lexical,
)}

"""Registered queries of query understanding and measurement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate, fulltext, models, understanding as U
from .base import documents, table, tokens


def _queries(spark, sf_dir) -> DataFrame:
    """Queries made of events and part names: dates, counts, kinds."""
    e = table(spark, sf_dir, "events")
    kinds = ["how many {t} about rain", "suggest sittings about {t}", "{n} sittings on {t} from 2015", "best sittings on {t}", "top {n} discourses about {t} 2010 and 2014", "summary of the sitting on {t}", "{t} 2012-03-26 to 2010-01-07", "hello ji", "who is Kabir", "what is {t}"]
    text = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("event_id") % 10 + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{t}"), F.col("event_type")), F.lit("{n}"), (F.col("event_id") % 70).cast("string"))
    return e.select(F.col("event_id").alias("query_id"), text.alias("text"))


def date_signals(spark, sf_dir) -> DataFrame:
    return _queries(spark, sf_dir).select("query_id", U.date_signal(F.col("text")).alias("d")).select("query_id", "d.start", "d.end").where("start is not null")


def vocabulary_signals(spark, sf_dir) -> DataFrame:
    vocabulary = table(spark, sf_dir, "events").select(F.lit("event_type").alias("field"), F.col("event_type").alias("value")).distinct()
    return U.vocabulary_signals(_queries(spark, sf_dir), vocabulary)


def list_intent(spark, sf_dir) -> DataFrame:
    return _queries(spark, sf_dir).select("query_id", U.list_count(F.col("text")).alias("n"))


def best_intent(spark, sf_dir) -> DataFrame:
    return _queries(spark, sf_dir).select("query_id", U.best_count(F.col("text")).alias("n")).where("n is not null")


def router_class(spark, sf_dir) -> DataFrame:
    return _queries(spark, sf_dir).groupBy(U.router_class(F.col("text")).alias("class")).agg(F.count("*").alias("n"))


def query_plans(spark, sf_dir) -> DataFrame:
    return _queries(spark, sf_dir).select("query_id", U.plan(F.col("text")).alias("p")).select("query_id", "p.intent", "p.class", "p.n")


def verbatim_topics(spark, sf_dir) -> DataFrame:
    return _queries(spark, sf_dir).where(U.wants_verbatim(F.col("text"))).select("query_id", U.without_verbatim(F.col("text")).alias("topic"))


def quote_detection(spark, sf_dir) -> DataFrame:
    q = _queries(spark, sf_dir).withColumn("text", F.when(F.col("query_id") % 4 == 0, F.lit("मन ही मनुष्य का मित्र है और मन ही मनुष्य का शत्रु है यह बात याद रखो ye kab kaha")).otherwise(F.col("text")))
    return q.groupBy(U.quote_parts(F.col("text"))["is_quote"].alias("is_quote")).agg(F.count("*").alias("n"))


def _ranked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = documents(spark, sf_dir)
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = fulltext.restricted(fulltext.postings(d, "doc_id"), passages)
    found = fulltext.bm25(passages, index, fulltext.corpus_stats(d), 10).select("query_id", "id", (F.col("rank") + 1).alias("rank"))
    return found, evaluate.holders(passages, d.select(F.col("doc_id").alias("id"), "text"), index)


def quote_hits(spark, sf_dir) -> DataFrame:
    found, expected = _ranked(spark, sf_dir)
    return evaluate.metrics(evaluate.first_hit(found, expected))


def hit_ranks(spark, sf_dir) -> DataFrame:
    found, expected = _ranked(spark, sf_dir)
    return evaluate.first_hit(found, expected).select("query_id", F.col("best_rank").cast("int").alias("best_rank"), F.col("worst_rank").cast("int").alias("worst_rank"), "n_found", "n_expected")


def _scores(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 101 / 100.0).alias("score"), (F.col("quality") == 0).alias("negative"), "quality")


def abstention_matrix(spark, sf_dir) -> DataFrame:
    return evaluate.abstention(_scores(spark, sf_dir), "score", "negative", spark.createDataFrame([(0.03,), (0.25,), (0.5,), (0.75,)], "floor double"))


def floor_retention(spark, sf_dir) -> DataFrame:
    return evaluate.retention(_scores(spark, sf_dir), "score", spark.createDataFrame([(0.03,), (0.5,), (0.75,)], "floor double"))


def percentile_distribution(spark, sf_dir) -> DataFrame:
    return evaluate.distribution(table(spark, sf_dir, "events"), "event_type", "value")


def latency_summary(spark, sf_dir) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "events").select("event_type", "value", (F.col("user_id") % 11 / 10.0).alias("recall")), "event_type", "value", "recall")


def recall_shares(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", evaluate.recall_share(F.array("source", "lang"), F.array(F.lit("src1"), F.lit("en"), F.lit("src1"))).alias("recall"))


def faithfulness_summary(spark, sf_dir) -> DataFrame:
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("positive"), (F.col("doc_id") % 17 == 0).alias("failed"), (F.col("doc_id") % 5 == 0).alias("abstained"), (F.col("doc_id") % 4).alias("supported"), F.lit(4).alias("total"))
    f = evaluate.faithfulness(a)
    return f.select("failed", "abstained", "faithfulness", F.size("leaks").cast("long").alias("n_leaks"))


def context_blocks(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), F.col("role").alias("source_file"), "text")
    return models.context_blocks(c)


def grounded_answers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    verdicts = F.array(*[(F.col("turn") % k == 0) for k in (2, 3, 5)])
    return c.select("conv_id", "turn", models.grounded(F.lit("One is so. Two is not! Three may be?"), verdicts).alias("answer"))


_T = "replace(replace(list_extract(['how many {t} about rain', 'suggest sittings about {t}', '{n} sittings on {t} from 2015', 'best sittings on {t}', 'top {n} discourses about {t} 2010 and 2014', 'summary of the sitting on {t}', '{t} 2012-03-26 to 2010-01-07', 'hello ji', 'who is Kabir', 'what is {t}'], CAST(event_id % 10 + 1 AS INTEGER)), '{t}', event_type), '{n}', CAST(event_id % 70 AS VARCHAR))"
_N = "CAST(greatest(1, least(50, event_id % 70)) AS INTEGER)"
_BM25 = f"""t AS (SELECT doc_id, {tokens('text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id AS query_id, unnest(list_distinct({tokens('text')})) AS term FROM benchmark),
r AS (SELECT query_id, doc_id AS id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), s GROUP BY 1, 2),
f AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 10),
e AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark m, documents d WHERE contains(d.text, m.text)),
h AS (SELECT query_id, min(rank) AS b, CASE WHEN count(rank) = count(*) THEN max(rank) END AS w, count(rank) AS n_found, count(*) AS n_expected FROM e LEFT JOIN f USING (query_id, id) GROUP BY 1)"""
SQL = {
    "date_signals": "SELECT event_id AS query_id, CASE event_id % 10 WHEN 2 THEN '2015-01-01' WHEN 4 THEN '2010-01-01' ELSE '2010-01-07' END AS start, CASE event_id % 10 WHEN 2 THEN '2015-12-31' WHEN 4 THEN '2014-12-31' ELSE '2012-03-26' END AS \"end\" FROM events WHERE event_id % 10 IN (2, 4, 6)",
    "vocabulary_signals": "SELECT event_id AS query_id, 'event_type' AS field, event_type AS value FROM events WHERE event_id % 10 NOT IN (7, 8)",
    "list_intent": f"SELECT event_id AS query_id, CASE event_id % 10 WHEN 1 THEN 10 WHEN 2 THEN {_N} WHEN 4 THEN {_N} END AS n FROM events",
    "best_intent": f"SELECT event_id AS query_id, CASE event_id % 10 WHEN 3 THEN 10 ELSE {_N} END AS n FROM events WHERE event_id % 10 IN (3, 4)",
    "router_class": "SELECT CASE event_id % 10 WHEN 0 THEN 'analytic' WHEN 7 THEN 'chitchat' WHEN 8 THEN 'name' ELSE 'thematic' END AS class, count(*) AS n FROM events GROUP BY 1",
    "query_plans": f"""SELECT event_id AS query_id, CASE event_id % 10 WHEN 3 THEN 'best' WHEN 4 THEN 'best' WHEN 1 THEN 'list' WHEN 2 THEN 'list' WHEN 5 THEN 'verbatim' ELSE 'answer' END AS intent,
  CASE event_id % 10 WHEN 0 THEN 'analytic' WHEN 7 THEN 'chitchat' WHEN 8 THEN 'name' ELSE 'thematic' END AS class, CASE event_id % 10 WHEN 1 THEN 10 WHEN 2 THEN {_N} WHEN 3 THEN 10 WHEN 4 THEN {_N} END AS n FROM events""",
    "verbatim_topics": "SELECT event_id AS query_id, 'sitting on ' || event_type AS topic FROM events WHERE event_id % 10 = 5",
    "quote_detection": "SELECT event_id % 4 = 0 AS is_quote, count(*) AS n FROM events GROUP BY 1",
    "quote_hits": f"WITH {_BM25} SELECT count(*) AS n, " + ", ".join(f"round(avg(coalesce((b <= {k})::INT, 0)), 6) AS hit_{k}" for k in (1, 5, 10)) + ", round(avg(coalesce(1 / b::DOUBLE, 0)), 6) AS mrr_best, round(avg(coalesce(1 / w::DOUBLE, 0)), 6) AS mrr_worst, round(avg(n_found / n_expected::DOUBLE), 6) AS recall FROM h",
    "hit_ranks": f"WITH {_BM25} SELECT query_id, CAST(b AS INTEGER) AS best_rank, CAST(w AS INTEGER) AS worst_rank, n_found, n_expected FROM h",
    "abstention_matrix": """WITH s AS (SELECT doc_id % 101 / 100.0::DOUBLE AS score, quality = 0 AS neg, floor FROM labels, (SELECT unnest([0.03::DOUBLE, 0.25, 0.5, 0.75]) AS floor)),
g AS (SELECT floor, count(*) FILTER (score < floor AND neg) AS tp, count(*) FILTER (score < floor AND NOT neg) AS fp, count(*) FILTER (score >= floor AND neg) AS fn, count(*) FILTER (score >= floor AND NOT neg) AS tn FROM s GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS false_abstention FROM g""",
    "floor_retention": "SELECT floor, count(*) FILTER (doc_id % 101 / 100.0::DOUBLE >= floor) AS kept, count(*) AS n FROM labels, (SELECT unnest([0.03::DOUBLE, 0.5, 0.75]) AS floor) GROUP BY 1",
    "percentile_distribution": "SELECT event_type, count(*) AS n, round(min(value), 6) AS lowest, round(max(value), 6) AS highest, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{int(round(p * 100))}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM events GROUP BY 1",
    "latency_summary": "SELECT event_type, round(median(value), 6) AS median_ms, round(avg(value), 6) AS mean_ms, round(avg(user_id % 11 / 10.0::DOUBLE), 6) AS mean_recall FROM events GROUP BY 1",
    "recall_shares": "SELECT doc_id, round(((source = 'src1')::INT + (lang = 'en')::INT) / 2.0::DOUBLE, 6) AS recall FROM documents",
    "faithfulness_summary": "SELECT count(*) FILTER (doc_id % 17 = 0) AS failed, count(*) FILTER (doc_id % 5 = 0) AS abstained, round(avg(CASE WHEN quality = 1 AND doc_id % 17 <> 0 THEN doc_id % 4 / 4.0::DOUBLE END), 6) AS faithfulness, count(*) FILTER (quality <> 1 AND doc_id % 5 <> 0 AND doc_id % 17 <> 0) AS n_leaks FROM labels",
    "context_blocks": "SELECT conv_id AS query_id, string_agg('[' || turn || '] SOURCE: ' || role || chr(10) || 'TEXT: ' || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1",
    "grounded_answers": "SELECT conv_id, turn, CASE WHEN turn % 2 <> 0 AND turn % 3 <> 0 AND turn % 5 <> 0 THEN 'One is so. Two is not! Three may be?' ELSE concat_ws(' ', CASE WHEN turn % 2 = 0 THEN 'One is so.' END, CASE WHEN turn % 3 = 0 THEN 'Two is not!' END, CASE WHEN turn % 5 = 0 THEN 'Three may be?' END) END AS answer FROM conversations",
}
QUERIES = {f.__name__: f for f in (
    date_signals, vocabulary_signals, list_intent, best_intent, router_class, query_plans, verbatim_topics, quote_detection, quote_hits, hit_ranks, abstention_matrix, floor_retention, percentile_distribution, latency_summary, recall_shares,
    faithfulness_summary, context_blocks, grounded_answers,
)}

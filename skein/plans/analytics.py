"""Registered queries of the analytics plane, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import recency
from ..operators import corpus, fulltext, tables
from ..operators.corpus import majority_state
from ..streaming.events import play_counts
from .base import DOCS, documents, table, tokens

TERM = "the and"


def count_mentions(spark, sf_dir) -> DataFrame:
    return fulltext.count_mentions(documents(spark, sf_dir), TERM)


def count_mentions_by_speaker(spark, sf_dir) -> DataFrame:
    return fulltext.count_mentions(documents(spark, sf_dir), TERM, speaker="src3")


def top_speakers(spark, sf_dir) -> DataFrame:
    return fulltext.top_elements(documents(spark, sf_dir), TERM, "speakers", 10)


def list_sources(spark, sf_dir) -> DataFrame:
    return fulltext.top_groups(documents(spark, sf_dir), TERM, "source", 20)


def terms_sum_by_source(spark, sf_dir) -> DataFrame:
    terms = spark.createDataFrame([("the",), ("and",), ("de",), ("der",)], "term string")
    return fulltext.term_sums(documents(spark, sf_dir), terms, "source")


def semi_join_files(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    files = d.groupBy("source").agg(F.sum("n_chars").alias("c")).orderBy(F.desc("c"), "source").limit(5).select("source")
    return d.join(F.broadcast(files), "source", "left_semi").where(fulltext.mentions(F.col("text"), "the")).groupBy("source").agg(F.count("*").alias("n"))


def facet_values(spark, sf_dir) -> DataFrame:
    return corpus.facet(documents(spark, sf_dir), "speakers")


def facet_union(spark, sf_dir) -> DataFrame:
    a, b = corpus.facet(documents(spark, sf_dir), "source"), corpus.facet(table(spark, sf_dir, "events"), "event_type")
    return a.union(b).distinct().orderBy("value")


def facet_years(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).where("session_date is not null")
    return d.select(F.year("session_date").cast("string").alias("value")).distinct().orderBy(F.desc("value"))


def facet_coverage(spark, sf_dir) -> DataFrame:
    return tables.reconcile(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key"), "key")


def key_intersection(spark, sf_dir) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return c.subtract(o).withColumn("side", F.lit("left_only")).union(c.intersect(o).withColumn("side", F.lit("both")))


def corpus_summary(spark, sf_dir) -> DataFrame:
    return corpus.summary(documents(spark, sf_dir))


def corpus_version(spark, sf_dir) -> DataFrame:
    return corpus.version(documents(spark, sf_dir), "n_chunks", "session_date")


def corpus_tree(spark, sf_dir) -> DataFrame:
    return corpus.tree(documents(spark, sf_dir), "", 2)


def corpus_subtree(spark, sf_dir) -> DataFrame:
    return corpus.tree(documents(spark, sf_dir), "src1", 2)


def url_tree(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    key = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    rows = p.select(key.alias("source_file"), F.lit(1).cast("long").alias("n_chunks"), F.length("html").cast("double").alias("duration_sec"), F.lit(None).cast("date").alias("session_date"))
    return corpus.tree(rows, "", 2)


def majority_states(spark, sf_dir) -> DataFrame:
    n = corpus.tree(documents(spark, sf_dir), "", 1)
    return n.select("path", majority_state(F.col("remembered"), F.col("written"), F.col("failed")).alias("state"), F.round(corpus.lit_ratio(F.col("remembered"), F.col("n_files")), 6).alias("lit"))


def visible_nodes(spark, sf_dir) -> DataFrame:
    nodes = corpus.tree(documents(spark, sf_dir), "", 2)
    opened = nodes.where("name in ('src1', 'src2')").select("path")
    return corpus.visible(nodes, opened, 2).select("path", "depth", "n_files")


def _turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turn_index"), F.col("text").alias("title"), F.col("role").alias("mode"), (F.col("conv_id") * 100 + F.col("turn")).alias("created_at"), "role", "text")


def thread_rollup(spark, sf_dir) -> DataFrame:
    return corpus.threads(_turns(spark, sf_dir))


def next_turn_index(spark, sf_dir) -> DataFrame:
    t = _turns(spark, sf_dir)
    new = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") + 5).alias("conversation_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("created_at"))
    return corpus.next_turn(t, new).select("conversation_id", "created_at", "turn_index")


def last_turns(spark, sf_dir) -> DataFrame:
    return corpus.last_turns(_turns(spark, sf_dir))


def recency_buckets(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(recency(F.to_date("ts"), F.lit("2024-01-30").cast("date")).alias("bucket")).agg(F.count("*").alias("n"))


def plays_by_user(spark, sf_dir) -> DataFrame:
    return play_counts(table(spark, sf_dir, "events"), "user_id")


def event_props(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"))


_MATCH = f"list_has_all({tokens('text')}, ['the', 'and'])"
_STATE = "CASE WHEN n_chunks > 0 AND session_date IS NOT NULL THEN 'remembered' ELSE 'written' END"
_TREE = f"""SELECT array_to_string(p[1:k], '/') AS path, p[k] AS name, CAST(k AS INTEGER) AS depth, bool_and(k = len(p)) AS is_leaf, count(*) AS n_files, CAST(sum(n_chunks) AS BIGINT) AS n_chunks,
  round(sum(duration_sec), 1) AS duration_sec, count(*) FILTER (s = 'remembered') AS remembered, count(*) FILTER (s = 'written') AS written, count(*) FILTER (s = 'failed') AS failed
FROM (SELECT *, {_STATE} AS s, string_split(source_file, '/') AS p, unnest(generate_series(1, least(2, len(string_split(source_file, '/'))))) AS k FROM docs) GROUP BY 1, 2, 3"""
_TURNS = "t AS (SELECT conv_id AS conversation_id, turn AS turn_index, text AS title, role AS mode, conv_id * 100 + turn AS created_at, role, text FROM conversations)"

SQL = {
    "count_mentions": f"SELECT count(*) AS n FROM documents WHERE {_MATCH}",
    "count_mentions_by_speaker": f"SELECT count(*) AS n FROM documents WHERE {_MATCH} AND source = 'src3'",
    "top_speakers": f"SELECT value, count(*) AS n FROM (SELECT unnest([source, lang]) AS value FROM documents WHERE {_MATCH}) GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "list_sources": f"SELECT source AS value, count(*) AS n FROM documents WHERE {_MATCH} GROUP BY 1 ORDER BY n DESC, value LIMIT 20",
    "terms_sum_by_source": f"SELECT source, count(*) AS mentions FROM (SELECT source, unnest(list_distinct({tokens('text')})) AS w FROM documents) WHERE w IN ('the', 'and', 'de', 'der') GROUP BY 1",
    "semi_join_files": f"SELECT source, count(*) AS n FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 ORDER BY sum(n_chars) DESC, source LIMIT 5) AND list_has_all({tokens('text')}, ['the']) GROUP BY 1",
    "facet_values": "SELECT DISTINCT value FROM (SELECT unnest([source, lang]) AS value FROM documents) WHERE value <> ''",
    "facet_union": "SELECT source AS value FROM documents UNION SELECT event_type FROM events",
    "facet_years": f"WITH {DOCS} SELECT DISTINCT CAST(year(session_date) AS VARCHAR) AS value FROM docs WHERE session_date IS NOT NULL",
    "facet_coverage": """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS matched, count(*) FILTER (y IS NULL) AS left_only, count(*) FILTER (x IS NULL) AS right_only,
  round(100.0::DOUBLE * count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*) FILTER (x IS NOT NULL), 2) AS pct FROM j""",
    "key_intersection": "SELECT key, 'left_only' AS side FROM (SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT key, 'both' FROM (SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders)",
    "corpus_summary": f"WITH {DOCS}, s AS (SELECT *, {_STATE} AS s FROM docs) SELECT count(*) AS n_files, CAST(sum(n_chunks) AS BIGINT) AS n_chunks, round(sum(duration_sec), 1) AS duration_sec, count(*) FILTER (s = 'remembered') AS remembered, count(*) FILTER (s = 'written') AS written, count(*) FILTER (s = 'failed') AS failed, min(session_date) AS first_date, max(session_date) AS last_date FROM s",
    "corpus_version": f"WITH {DOCS} SELECT left(sha256(count(*) || '|' || CAST(sum(n_chunks) AS BIGINT) || '|' || max(session_date)), 16) AS version FROM docs",
    "corpus_tree": f"WITH {DOCS} {_TREE}",
    "corpus_subtree": f"WITH {DOCS}, nodes AS ({_TREE.replace('least(2,', 'least(3,')}) SELECT path, name, CAST(depth - 1 AS INTEGER) AS depth, is_leaf, n_files, n_chunks, duration_sec, remembered, written, failed FROM nodes WHERE starts_with(path, 'src1/')",
    "url_tree": r"""WITH x AS (SELECT string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS p, length(html) AS n FROM pages), e AS (SELECT *, unnest(generate_series(1, least(2, len(p)))) AS k FROM x)
SELECT array_to_string(p[1:k], '/') AS path, p[k] AS name, CAST(k AS INTEGER) AS depth, bool_and(k = len(p)) AS is_leaf, count(*) AS n_files, count(*) AS n_chunks, round(CAST(sum(n) AS DOUBLE), 1) AS duration_sec,
  CAST(0 AS BIGINT) AS remembered, count(*) FILTER (len(p) > 1) AS written, count(*) FILTER (len(p) = 1) AS failed FROM e GROUP BY 1, 2, 3""",
    "majority_states": f"WITH {DOCS}, s AS (SELECT source AS path, count(*) FILTER ({_STATE} = 'remembered') AS r, count(*) AS n FROM docs GROUP BY 1) SELECT path, CASE WHEN n - r >= r THEN 'written' ELSE 'remembered' END AS state, round(r / n, 6) AS lit FROM s",
    "visible_nodes": f"WITH {DOCS}, nodes AS ({_TREE}) SELECT path, depth, n_files FROM nodes WHERE depth = 1 OR starts_with(path, 'src1/') OR starts_with(path, 'src2/')",
    "thread_rollup": f"WITH {_TURNS} SELECT conversation_id, arg_min(title, turn_index) AS title, arg_min(mode, turn_index) AS mode, max(created_at) AS last_at, count(*) AS n_turns FROM t GROUP BY 1",
    "next_turn_index": f"""WITH {_TURNS}, m AS (SELECT conversation_id, max(turn_index) AS last FROM t GROUP BY 1), n AS (SELECT conv_id + 5 AS conversation_id, conv_id * 100 + turn AS created_at FROM conversations WHERE role = 'user')
SELECT conversation_id, created_at, coalesce(last + 1, 0) + row_number() OVER (PARTITION BY conversation_id ORDER BY created_at) - 1 AS turn_index FROM n LEFT JOIN m USING (conversation_id)""",
    "last_turns": f"""WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_index DESC) AS k FROM t)
SELECT conversation_id, string_agg(role || ': ' || CASE WHEN role = 'assistant' THEN left(text, 400) ELSE text END, chr(10) ORDER BY turn_index) AS context FROM r WHERE k <= 3 GROUP BY 1""",
    "recency_buckets": """SELECT CASE WHEN a <= 0 THEN 'Today' WHEN a = 1 THEN 'Yesterday' WHEN a <= 6 THEN 'Previous 7 days' WHEN a <= 29 THEN 'Previous 30 days' ELSE 'Older' END AS bucket, count(*) AS n
FROM (SELECT date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') AS a FROM events) GROUP BY 1""",
    "plays_by_user": "SELECT user_id, count(*) AS plays FROM events WHERE event_type = 'view' GROUP BY 1",
    "event_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (
    count_mentions, count_mentions_by_speaker, top_speakers, list_sources, terms_sum_by_source, semi_join_files, facet_values, facet_union, facet_years, facet_coverage, key_intersection, corpus_summary,
    corpus_version, corpus_tree, corpus_subtree, url_tree, majority_states, visible_nodes, thread_rollup, next_turn_index, last_turns, recency_buckets, plays_by_user, event_props,
)}

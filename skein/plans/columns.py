"""Registered queries of single functions and small operators over the supplied tables, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates, text as T
from ..operators import chunking, cleaning, corpus, filters, search, understanding
from .base import DOCS, documents, table, tokens, words


def token_estimates_chars(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.token_estimate_chars(F.col("text")).cast("long").alias("tokens"))


def mixed_tokens(spark, sf_dir) -> DataFrame:
    each = documents(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("w"), "doc_id")
    made = each.withColumn("w", F.when(F.col("doc_id") % 2 == 0, F.concat("w", F.lit("कर"))).otherwise(F.col("w")))
    return made.groupBy(T.mixed_script(F.col("w")).alias("mixed")).agg(F.count("*").alias("n"))


def file_names(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.safe_name(F.concat_ws("/", "source_file", F.translate("text", "\n", " ")), 60).alias("name"))


def topic_words(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.topic_terms(F.col("text"), ["the", "and", "de", "der", "le"]), " ").alias("terms"))


def shown_answers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    thought = F.concat(F.lit("<think>"), F.col("text"), F.when(F.col("turn") % 2 == 0, F.lit("\n</THINK>")).otherwise(F.lit("")), F.col("text"))
    return c.select("conv_id", "turn", T.without_thoughts(thought).alias("answer"))


def dates_in_spans(spark, sf_dir) -> DataFrame:
    """Month and day of each order within the camp of its winter."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    found = dates.year_in_span(F.month("d"), F.dayofmonth("d"), F.make_date(F.lit(1994), F.lit(11), F.lit(1)), F.make_date(F.lit(1995), F.lit(2), F.lit(10)))
    return o.select("o_orderkey", F.date_format(found, "yyyy-MM-dd").alias("day"))


def event_spans(spark, sf_dir) -> DataFrame:
    """Event folders made of orders' dates, with and without years, read again."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")).withColumn("e", F.date_add("d", 5))
    name = F.concat((F.col("o_orderkey") % 30 + 1).cast("string"), F.lit(" new delhi "), F.date_format("d", "d MMM"), F.lit(" - "), F.date_format("e", "d MMMM"), F.when(F.col("o_orderkey") % 3 > 0, F.date_format("e", " yyyy")).otherwise(F.lit("")))
    span = dates.event_span(name, F.when(F.col("o_orderkey") % 2 == 0, F.year("e")))
    day = lambda c: F.date_format(f"span.{c}", "yyyy-MM-dd").alias(c)
    return o.select("o_orderkey", span.alias("span")).select("o_orderkey", "span.seq", "span.location", day("start"), day("end"), "span.warning")


def lit_shares(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    state = corpus.track_state(F.col("source_file"), F.col("n_chunks"), F.col("session_date"))
    counted = d.groupBy("source").agg(F.count_if(state == "remembered").alias("remembered"), F.count("*").alias("n"))
    return counted.select("source", F.round(corpus.lit_ratio(F.col("remembered"), F.col("n")), 6).alias("share"))


def failed_files(spark, sf_dir) -> DataFrame:
    loose = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("source_file"))
    return corpus.failed_files(documents(spark, sf_dir).withColumn("source_file", loose))


def parents(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).select(F.col("source_file").alias("path"))
    nodes = d.select(F.explode(F.array(F.substring_index("path", "/", 1), F.substring_index("path", "/", 2))).alias("path")).where("path not like '%/fr'").distinct()
    return corpus.nearest_ancestor(d, nodes.withColumn("depth", F.size(F.split("path", "/"))))


def point_lookup(spark, sf_dir) -> DataFrame:
    return corpus.has(documents(spark, sf_dir), "doc_id", 7).unionByName(corpus.has(documents(spark, sf_dir), "doc_id", -7))


def recent_threads(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turn_index"), F.col("text").alias("title"), F.col("role").alias("mode"), (F.col("conv_id") * 100 + F.col("turn")).alias("created_at"))
    return corpus.history(corpus.threads(c), 7).select("conversation_id", "last_at", "n_turns")


def map_nodes(spark, sf_dir) -> DataFrame:
    g = documents(spark, sf_dir).groupBy("source").agg(F.sum("n_chunks").alias("n_chunks"), F.count("*").alias("n_files"), F.sum("duration_sec").alias("s"))
    return g.select("source", F.round(corpus.node_radius(F.col("n_chunks"), F.col("n_files"), F.col("source") == "src0"), 6).alias("radius"), corpus.duration_text(F.col("s") * 50).alias("long"), corpus.duration_text(F.col("n_files") * 1.0).alias("short"))


def usable_texts(spark, sf_dir) -> DataFrame:
    """Cleaned texts that lost words, gained some or are the same."""
    d = documents(spark, sf_dir).withColumn("w", T.words(F.col("text")))
    kept = F.when(F.col("doc_id") % 3 == 0, F.slice("w", 1, F.floor(F.size("w") * 0.8).cast("int"))).when(F.col("doc_id") % 3 == 1, F.concat("w", F.slice("w", 1, F.floor(F.size("w") * 0.3).cast("int")))).otherwise(F.col("w"))
    return d.select("doc_id", cleaning.usable(F.array_join(kept, " "), F.col("text")).alias("usable"))


def clean_cells(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.lit(" NaN ")).otherwise(F.concat(F.lit(" é "), F.replace("text", F.lit("\n"), F.lit("  _x000D_\n\n_x000D_")))).alias("cell"))
    return cleaning.clean_cells(d, ["cell"]).select("doc_id", F.md5("cell").alias("digest"), F.length("cell").alias("length"))


def spelling_proposals(spark, sf_dir) -> DataFrame:
    each = documents(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("phrase"))
    counted = each.groupBy(F.lower("phrase").alias("key"), "phrase").agg(F.count("*").alias("count"))
    return cleaning.proposals(counted)


def phrase_rewrites(spark, sf_dir) -> DataFrame:
    out = cleaning.rewrite_phrases(documents(spark, sf_dir).select("doc_id", "text"), "text", {"the": "THE", "de": "DE"})
    return out.select("doc_id", F.md5("text").alias("digest"))


def windows_of_text(spark, sf_dir) -> DataFrame:
    each = documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.character_windows(F.col("text"), 1000)).alias("number", "part"))
    return each.select("doc_id", F.col("number").cast("long").alias("number"), F.md5("part").alias("digest"))


def lexical_weights(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "name").when(F.col("event_id") % 3 == 1, "quote").otherwise("thematic").alias("class"))
    return e.groupBy(understanding.lexical_weight(F.col("class")).cast("double").alias("weight")).agg(F.count("*").alias("n"))


def signal_filters(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 50).alias("query_id"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 3 == 0, "topics").when(F.col("event_id") % 3 == 1, "location").otherwise("topics").alias("field"), F.col("event_type").alias("value"), (F.col("event_id") % 3 == 2).alias("is_soft"))
    return filters.signal_filters(rows).select("query_id", "field", F.array_join("values", "|").alias("values"))


def result_rows(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    chunks = d.select(F.col("doc_id").alias("id"), "text", "source_file", F.lit(0.0).alias("start_sec"), F.col("duration_sec").alias("end_sec"), F.when(F.col("doc_id") % 2 == 0, F.col("speakers")).alias("speakers"), F.when(F.col("doc_id") % 3 == 0, "catalog").alias("source_type"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("primary_language"), F.col("session_date"))
    found = d.select((F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").alias("id"), (F.col("doc_id") / 7.0).alias("score"))
    r = search.as_results(found, chunks, ["primary_language", "session_date"])
    facts = F.array_join(F.transform(F.sort_array(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return r.select("query_id", "chunk_id", "result_type", "source", "score", F.md5("text").alias("digest"), F.array_join("speakers", "|").alias("speakers"), facts.alias("metadata"))


_DAY = "CAST(o_orderdate AS DATE)"
_NO_MARK = r"""regexp_replace({0}, '[^\p{{L}}\p{{N}}._-]+', '_', 'g')"""
SQL = {
    "token_estimates_chars": "SELECT doc_id, CAST(greatest(1, floor(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents",
    "mixed_tokens": f"SELECT regexp_matches(w, '[ऀ-ॿ]') AND regexp_matches(w, '[A-Za-z]') AS mixed, count(*) AS n FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN w || 'कर' ELSE w END AS w FROM (SELECT doc_id, unnest({words('text')}) AS w FROM documents)) GROUP BY 1",
    "file_names": f"WITH {DOCS}, n AS (SELECT doc_id, source_file || '/' || replace(text, chr(10), ' ') AS t FROM docs), f AS (SELECT doc_id, t, {_NO_MARK.format('t')} AS x FROM n) SELECT doc_id, CASE WHEN length(x) > 60 THEN left(x, 50) || '-' || left(sha1(t), 8) ELSE x END AS name FROM f",
    "topic_words": rf"""WITH t AS (SELECT doc_id, {tokens('text')} AS w FROM documents), e AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM t),
k AS (SELECT doc_id, t, min(i) AS i FROM e WHERE t NOT IN ('the', 'and', 'de', 'der', 'le') AND NOT regexp_full_match(t, '\p{{N}}+') AND (length(t) >= 3 OR regexp_matches(t, '[ऀ-ॿ]')) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k) SELECT d.doc_id, coalesce(string_agg(t, ' ' ORDER BY i), '') AS terms FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND n <= 8 GROUP BY 1""",
    "shown_answers": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE '' END AS answer FROM conversations WHERE role = 'assistant'",
    "dates_in_spans": f"""WITH o AS (SELECT o_orderkey, strftime({_DAY}, '%m-%d') AS d FROM orders) SELECT o_orderkey, CASE WHEN d >= '11-01' THEN '1994-' || d WHEN d <= '02-10' THEN '1995-' || d ELSE CAST(TRY_CAST('1994-' || d AS DATE) AS VARCHAR) END AS day FROM o""",
    "event_spans": f"""WITH o AS (SELECT o_orderkey AS k, {_DAY} AS d, {_DAY} + 5 AS e FROM orders), y AS (SELECT *, CASE WHEN k % 3 > 0 OR k % 2 = 0 THEN 1 END AS known FROM o)
SELECT k AS o_orderkey, CAST(k % 30 + 1 AS INTEGER) AS seq, 'NEW DELHI' AS location, CASE WHEN known = 1 THEN strftime(d, '%Y-%m-%d') END AS start, CASE WHEN known = 1 THEN strftime(e, '%Y-%m-%d') END AS "end", CASE WHEN known IS NULL THEN 'no year' END AS warning FROM y""",
    "lit_shares": f"WITH {DOCS} SELECT source, round(count(*) FILTER (n_chunks > 0 AND session_date IS NOT NULL) / count(*)::DOUBLE, 6) AS share FROM docs GROUP BY 1",
    "failed_files": "SELECT 'x' || doc_id AS source_file FROM documents WHERE doc_id % 9 = 0",
    "parents": f"WITH {DOCS} SELECT source_file AS key, CASE WHEN lang = 'fr' THEN source ELSE source || '/' || lang END AS parent FROM docs",
    "point_lookup": "SELECT count(*) > 0 AS found FROM documents WHERE doc_id = 7 UNION ALL SELECT count(*) > 0 FROM documents WHERE doc_id = -7",
    "recent_threads": "SELECT conv_id AS conversation_id, max(conv_id * 100 + turn) AS last_at, count(*) AS n_turns FROM conversations GROUP BY 1 ORDER BY last_at DESC LIMIT 7",
    "map_nodes": f"""WITH {DOCS}, g AS (SELECT source, sum(n_chunks) AS c, count(*) AS f, sum(duration_sec) * 50 AS s FROM docs GROUP BY 1),
t AS (SELECT *, CASE WHEN s < 60 THEN CAST(floor(s + 0.5) AS BIGINT) || 's' WHEN s < 3600 THEN CAST(floor(s / 60 + 0.5) AS BIGINT) || ' min' WHEN s < 360000 THEN printf('%.1f', s / 3600) || ' hours' ELSE format('{{:,}}', CAST(floor(s / 3600 + 0.5) AS BIGINT)) || ' hours' END AS long FROM g)
SELECT source, round(CASE WHEN source = 'src0' THEN 14 ELSE least(22, 2.2::DOUBLE + sqrt(CASE WHEN c > 0 THEN c ELSE f END) * 0.7::DOUBLE) END, 6) AS radius, long, CASE WHEN f < 60 THEN f || 's' WHEN f < 3600 THEN CAST(floor(f / 60.0 + 0.5) AS BIGINT) || ' min' ELSE printf('%.1f', f / 3600.0) || ' hours' END AS short FROM t""",
    "usable_texts": f"""WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents), n AS (SELECT doc_id, len(w) AS r, len(list_distinct(w)) AS u, CASE doc_id % 3 WHEN 0 THEN CAST(floor(len(w) * 0.8::DOUBLE) AS BIGINT) WHEN 1 THEN len(w) + CAST(floor(len(w) * 0.3::DOUBLE) AS BIGINT) ELSE len(w) END AS c FROM w)
SELECT doc_id, CASE WHEN r < 50 THEN true WHEN c / r::DOUBLE > 1.15::DOUBLE THEN false WHEN c / r::DOUBLE >= 0.85::DOUBLE THEN true ELSE u / r::DOUBLE < 0.10::DOUBLE END AS usable FROM n""",
    "clean_cells": r"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN nfc_normalize(' e' || chr(769) || ' ' || replace(text, chr(10), '  _x000D_' || chr(10) || chr(10) || '_x000D_')) END AS x FROM documents),
d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(x, '_x000D_', chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS x FROM c) SELECT doc_id, md5(x) AS digest, length(x) AS length FROM d""",
    "spelling_proposals": f"""WITH c AS (SELECT lower(w) AS key, w AS phrase, count(*) AS count FROM (SELECT unnest({words('text')}) AS w FROM documents) GROUP BY ALL),
r AS (SELECT *, first_value(phrase) OVER o AS canonical, first_value(count) OVER o AS canonical_count, row_number() OVER o AS n FROM c WINDOW o AS (PARTITION BY key ORDER BY count DESC, phrase DESC))
SELECT key, phrase AS variant, canonical, count AS variant_count, canonical_count FROM r WHERE n > 1 AND canonical_count >= 5 AND canonical_count >= 4 * count""",
    "phrase_rewrites": f"SELECT doc_id, md5(array_to_string(list_transform({words('text')}, lambda w: CASE w WHEN 'the' THEN 'THE' WHEN 'de' THEN 'DE' ELSE w END), ' ')) AS digest FROM documents",
    "windows_of_text": "SELECT doc_id, number, md5(substr(text, number * 1000 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS number FROM documents)",
    "lexical_weights": "SELECT CASE event_id % 3 WHEN 0 THEN 0.75::DOUBLE WHEN 1 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS weight, count(*) AS n FROM events GROUP BY 1",
    "signal_filters": """WITH e AS (SELECT user_id % 50 AS query_id, event_id AS n, CASE event_id % 3 WHEN 0 THEN 'topics' ELSE 'location' END AS field, event_type AS value FROM events WHERE event_id % 3 < 2),
f AS (SELECT query_id, field, value, min(n) AS first, max(n) AS last FROM e GROUP BY ALL)
SELECT query_id, field, CASE WHEN field = 'topics' THEN string_agg(value, '|' ORDER BY first) ELSE arg_max(value, last) END AS values FROM f GROUP BY 1, 2""",
    "result_rows": f"""WITH {DOCS} SELECT doc_id % 10 AS query_id, doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'catalog' ELSE 'chunk' END AS result_type, CASE WHEN doc_id % 3 = 0 THEN 'catalog' ELSE 'transcript' END AS source, round(doc_id / 7.0::DOUBLE, 4) AS score, md5(text) AS digest,
CASE WHEN doc_id % 2 = 0 THEN source || '|' || lang ELSE '' END AS speakers, concat_ws(',', CASE WHEN doc_id % 5 > 0 THEN 'primary_language=' || lang END, 'session_date=' || strftime(session_date, '%Y-%m-%d')) AS metadata FROM docs""",
}
QUERIES = {f.__name__: f for f in (
    token_estimates_chars, mixed_tokens, file_names, topic_words, shown_answers, dates_in_spans, event_spans, lit_shares, failed_files, parents, point_lookup, recent_threads, map_nodes, usable_texts, clean_cells,
    spelling_proposals, phrase_rewrites, windows_of_text, lexical_weights, signal_filters, result_rows,
)}

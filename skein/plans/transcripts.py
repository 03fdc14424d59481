"""Registered queries over transcripts: words aligned to segments, folders read to facts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import MONTHS
from ..operators import cleaning, followup, paths, sittings
from .base import DOCS, documents, table


def aligned_segments(spark, sf_dir) -> DataFrame:
    """Conversations as transcripts, a turn a segment; cleaned texts write some words in capitals and end with one more. Every turn keeps its times."""
    t = table(spark, sf_dir, "conversations")
    segment = F.struct("text", (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 2).alias("end"), F.col("role").alias("speaker"))
    files = t.groupBy(F.col("conv_id").cast("string").alias("source_file")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", segment.alias("s")))), lambda x: x["s"]).alias("segments"))
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), " ")
    cleaned = F.concat(F.regexp_replace(whole, r"(?<!\S)(the|of|and|in)(?!\S)", "CLEAN"), F.lit(" amen"))
    each = cleaning.aligned(files.withColumn("cleaned", cleaned)).select("source_file", F.explode("segments").alias("s"))
    return each.select("source_file", F.col("s.start").alias("start_sec"), F.col("s.end").alias("end_sec"), F.col("s.speaker").alias("speaker"), F.col("s.text").alias("text"))


def word_changes(spark, sf_dir) -> DataFrame:
    """Of each turn how many words differ from the turn with some words in capitals."""
    t = table(spark, sf_dir, "conversations")
    new = F.regexp_replace("text", r"(?<!\S)(the|of|and|in)(?!\S)", "CLEAN")
    return t.select("conv_id", "turn", cleaning.word_changes(F.col("text"), new).alias("c")).select("conv_id", "turn", "c.changed", "c.deleted", "c.inserted")


def parsed_paths(spark, sf_dir) -> DataFrame:
    """Paths of ten shapes made of documents' ids, read again: whole ones, with what pipelines add, without years, over a year's end, with junk, bad and missing parts."""
    d = documents(spark, sf_dir).select("doc_id")
    month = lambda shift: F.element_at(F.array(*[F.lit(m) for m in MONTHS]), ((F.col("doc_id") + shift) % 12 + 1).cast("int"))
    d = d.withColumns({"y": F.col("doc_id") % 20 + 1995, "m": month(0), "next": month(1), "d": F.col("doc_id") % 20 + 1, "s": F.col("doc_id") % 4 + 1, "h": F.col("doc_id") % 12 + 1, "t": F.col("doc_id") % 60 + 1})
    f = lambda text, *columns: F.format_string(text, *[F.col(c) if c.isidentifier() else F.expr(c) for c in columns])
    shapes = [
        f("Live Masters %d/01 NOIDA %d - %d %s %d/%d %s - %d$ - %d PM/%d PRAVACHAN.wav", "y", "d", "d + 3", "m", "y", "d + 1", "m", "s", "h", "t"),
        f("Live Masters %d_isolation/NOIDA %d - %d %s %d_isolation/%d %s - %d$ - 1030 AM_isolation/04 X_model-1/turbo/%d SAMBODHAN (2).json", "y", "d", "d + 3", "m", "y", "d + 1", "m", "s", "t"),
        f("Dagshai %d/01 %s - %d/DAGSHAI %d - %d %s CAMP/%d %s 12 NOON/%d Song %d.wav", "y", "m", "y", "d", "d + 3", "m", "d", "m", "t", "doc_id"),
        f("Live Masters %d/DELHI 30 DEC %d - 2 JAN %d/1 JAN - 6 PM/%d QUES-01.wav", "y", "y", "y + 1", "t"),
        f("Live Masters %d/17 NEW YEAR DELHI 30 DEC - 2 JAN %d/31 DEC/%d MEDITATION & PRAVACHAN.wav", "y", "y", "t"),
        f("Live Masters %d/JUNK/%d %s - %d AM/%d MEDITATION KI.wav", "y", "d", "m", "h", "t"),
        f("song %d.wav", "doc_id"),
        f("Live Masters %d/NOIDA %d - %d %s %d/32 %s - 25 PM/%d A.wav", "y", "d", "d + 3", "m", "y", "m", "t"),
        f("Live Masters %d/NOIDA %d - %d %s %d/%d %s/%d SAMBODHAN - RISHI JI.wav", "y", "d", "d + 3", "m", "y", "d", "next", "t"),
        f("/deep/A %d/B %d/01 X 1 - 3 MAR/4 APR - 3$/%d COMPLETE SITTING.wav", "y", "y + 1", "t"),
    ]
    path = F.element_at(F.array(*shapes), (F.col("doc_id") % 10 + 1).cast("int"))
    facts = paths.parse(d.select("doc_id", path.alias("path")))
    day = lambda c: F.col(f"facts.{c}").cast("string").alias(c)
    plain = [F.col(f"facts.{c}").alias(c) for c in ("collection", "year", "event_seq", "location", "session_seq", "session_time", "track_no", "track_title", "track_type", "season", "primary_speaker")]
    return facts.select("doc_id", *plain, day("event_start"), day("event_end"), day("session_date"), F.size("facts.parse_warnings").alias("n_warnings"))


def sitting_texts(spark, sf_dir) -> DataFrame:
    """Documents as a catalog, a third of them titles and six a sitting; the candidates of each language miss every fourth, so that some titles take their details from the whole catalog."""
    d = documents(spark, sf_dir)
    title = F.col("doc_id") % 3 == 0
    catalog = d.select(
        F.col("doc_id").alias("id"), F.lit("catalog").alias("source_type"), F.when(title, "track_title").otherwise("sitting_detail").alias("kind"), "text", F.concat(F.lit("s"), F.expr("doc_id div 6").cast("string")).alias("sitting_key"),
        F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("track_title"), F.when(F.col("doc_id") % 2 == 0, "bhajan").alias("track_type"), F.col("source").alias("location"), F.date_format("session_date", "yyyy-MM-dd").alias("session_date"),
        F.lit(None).cast("string").alias("season"), F.array("source", "lang").alias("performers"),
    )
    pool = d.where("doc_id % 4 <> 1").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"))
    return sittings.rerank_texts(pool, catalog).select("query_id", "id", F.md5("read").alias("read_md5"), F.length("read").cast("long").alias("n_chars"))


def _digest(prompt: str) -> str:
    """A model that answers with its prompt's digest, in quotes, so that every prompt is held to its letters."""
    return f' "{hashlib.md5(prompt.encode()).hexdigest()}" '


def followups(spark, sf_dir) -> DataFrame:
    """Each conversation's last user turn as a follow-up to the turns before it."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").cast("long").alias("turn_index"), "role", "text")
    last = t.where("role = 'user'").groupBy("conversation_id").agg(F.max("turn_index").alias("at"), F.max_by("text", "turn_index").alias("text")).withColumn("query_id", F.col("conversation_id"))
    before = t.join(last.select("conversation_id", "at"), "conversation_id").where("turn_index < at").drop("at")
    return followup.standalone(last.select("query_id", "conversation_id", "text"), before, _digest).select("query_id", "rewritten")


_KINDS = "CASE doc_id % 10 {} END"


def _case(*values: str) -> str:
    return _KINDS.format(" ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)))


_SPAN = ("make_date(y, m, d)", "make_date(y, m, d + 3)")
SQL = {
    "aligned_segments": """SELECT CAST(conv_id AS VARCHAR) AS source_file, turn * 2.0::DOUBLE AS start_sec, turn * 2.0::DOUBLE + 2 AS end_sec, role AS speaker,
  array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN w IN ('the', 'of', 'and', 'in') THEN 'CLEAN' ELSE w END), ' ') || CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN ' amen' ELSE '' END AS text
FROM conversations""",
    "sitting_texts": f"""WITH {DOCS}, d AS (SELECT *, 's' || doc_id // 6 AS k FROM docs), near AS (SELECT lang, k, string_agg(text, chr(10) ORDER BY doc_id) AS body FROM d WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 1 AND text <> '' GROUP BY 1, 2),
far AS (SELECT k, string_agg(text, chr(10) ORDER BY doc_id) AS body FROM d WHERE doc_id % 3 <> 0 AND text <> '' GROUP BY 1),
r AS (SELECT d.lang AS query_id, doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN coalesce(text, '') ELSE CASE WHEN doc_id % 2 = 0 THEN 'bhajan' ELSE 'track' END || ': Title ' || doc_id || ', at ' || source || coalesce(' on ' || strftime(session_date, '%Y-%m-%d'), '') || ' performed by ' || source || ', ' || d.lang || coalesce('. ' || coalesce(near.body, far.body), '') END AS read
  FROM d LEFT JOIN near ON near.lang = d.lang AND near.k = d.k LEFT JOIN far ON far.k = d.k WHERE doc_id % 4 <> 1)
SELECT query_id, id, md5(read) AS read_md5, length(read) AS n_chars FROM r""",
    "followups": """WITH l AS (SELECT conv_id, max(turn) AS at, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1),
b AS (SELECT c.conv_id, c.turn, c.role || ': ' || CASE WHEN c.role = 'assistant' THEN left(c.text, 400) ELSE c.text END AS line FROM conversations c JOIN l USING (conv_id) WHERE c.turn < l.at AND trim(c.text) <> '' QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) <= 3),
x AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS context FROM b GROUP BY 1)
SELECT l.conv_id AS query_id, CASE WHEN context IS NULL THEN text ELSE md5('Turns so far:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Write the question as one search query that needs no turn before it, in the same language, with the person or topic by name. Reply with the query alone.') END AS rewritten FROM l LEFT JOIN x USING (conv_id)""",
    "word_changes": "SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w IN ('the', 'of', 'and', 'in'))) AS INTEGER) AS changed, CAST(0 AS INTEGER) AS deleted, CAST(0 AS INTEGER) AS inserted FROM conversations",
    "parsed_paths": f"""WITH k AS (SELECT doc_id, CAST(doc_id % 20 + 1995 AS INTEGER) AS y, CAST(doc_id % 12 + 1 AS INTEGER) AS m, CAST((doc_id + 1) % 12 + 1 AS INTEGER) AS nm, CAST(doc_id % 20 + 1 AS INTEGER) AS d, CAST(doc_id % 4 + 1 AS INTEGER) AS s, doc_id % 12 + 1 AS h, CAST(doc_id % 60 + 1 AS INTEGER) AS t FROM documents),
r AS (SELECT doc_id, {_case(*["'Live Masters'"] * 2, "'Dagshai'", *["'Live Masters'"] * 3, "NULL", *["'Live Masters'"] * 2, "'B'")} AS collection, {_case(*["y"] * 6, "NULL", "y", "y", "y + 1")} AS year, {_case("1", "NULL", "NULL", "NULL", "17", "NULL", "NULL", "NULL", "NULL", "1")} AS event_seq,
  {_case("'NOIDA'", "'NOIDA'", "'DAGSHAI'", "'DELHI'", "'NEW YEAR DELHI'", "NULL", "NULL", "'NOIDA'", "'NOIDA'", "'X'")} AS location, {_case("s", "s", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "3")} AS session_seq,
  {_case("printf('%02d:00', h % 12 + 12)", "'10:30'", "'12:00'", "'18:00'", "NULL", "printf('%02d:00', h % 12)", "NULL", "NULL", "NULL", "NULL")} AS session_time, {_case(*["t"] * 6, "NULL", *["t"] * 3)} AS track_no,
  {_case("'PRAVACHAN'", "'SAMBODHAN (2)'", "'Song ' || doc_id", "'QUES-01'", "'MEDITATION & PRAVACHAN'", "'MEDITATION KI'", "'song ' || doc_id", "'A'", "'SAMBODHAN - RISHI JI'", "'COMPLETE SITTING'")} AS track_title,
  {_case("'discourse'", "'address'", "'bhajan'", "'qa'", "'combined'", "'bhajan'", "'bhajan'", "'bhajan'", "'address'", "'session'")} AS track_type, CASE WHEN doc_id % 10 = 8 THEN 'Rishi ji' ELSE 'Swami ji' END AS primary_speaker,
  {_case(*[_SPAN[0]] * 3, "make_date(y, 12, 30)", "make_date(y - 1, 12, 30)", "NULL", "NULL", _SPAN[0], _SPAN[0], "make_date(y + 1, 3, 1)")} AS event_start, {_case(*[_SPAN[1]] * 3, "make_date(y + 1, 1, 2)", "make_date(y, 1, 2)", "NULL", "NULL", _SPAN[1], _SPAN[1], "make_date(y + 1, 3, 3)")} AS event_end,
  {_case("make_date(y, m, d + 1)", "make_date(y, m, d + 1)", "make_date(y, m, d)", "make_date(y + 1, 1, 1)", "make_date(y - 1, 12, 31)", "make_date(y, m, d)", "NULL", "NULL", "make_date(y, nm, d)", "make_date(y + 1, 4, 4)")} AS session_date, CAST({_case("0", "0", "0", "0", "0", "2", "4", "2", "0", "1")} AS INTEGER) AS n_warnings FROM k)
SELECT * REPLACE (CAST(event_start AS VARCHAR) AS event_start, CAST(event_end AS VARCHAR) AS event_end, CAST(session_date AS VARCHAR) AS session_date),
  CASE WHEN month(coalesce(session_date, event_start)) <= 2 THEN 'winter' WHEN month(coalesce(session_date, event_start)) <= 5 THEN 'summer' WHEN month(coalesce(session_date, event_start)) <= 9 THEN 'monsoon' WHEN coalesce(session_date, event_start) IS NOT NULL THEN 'post-monsoon' END AS season FROM r""",
}
QUERIES = {f.__name__: f for f in (aligned_segments, word_changes, parsed_paths, sitting_texts, followups)}

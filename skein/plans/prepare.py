"""Registered queries of the preparation plane: text functions, chunkers, guards, tables, catalog, folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates, ids, text as T
from ..operators import audit, catalog, chunking, cleaning, models, tables
from .base import DOCS, documents, table, words


def token_estimates(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def unique_ratios(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.round(T.unique_ratio(F.col("text")), 6).alias("ratio"))


def sentence_split(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


def titles(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.short_title(F.col("text")).alias("title"))


def languages(spark, sf_dir) -> DataFrame:
    mixed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.repeat(F.lit("कैसे हैं आप सब लोग आज "), F.expr("cast(doc_id % 60 as int)")), F.col("text"))).otherwise(F.col("text"))
    return documents(spark, sf_dir).groupBy(T.language(mixed).alias("language")).agg(F.count("*").alias("n"))


def repetition_scores(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.round(T.repetition(F.col("text")), 6).alias("score"))


def loop_collapse(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(T.collapse_loops(F.col("text"))).alias("digest"), F.length(T.collapse_loops(F.col("text"))).alias("length"))


def normalised_texts(spark, sf_dir) -> DataFrame:
    out = cleaning.normalised(F.col("text"), {"the": "THE"}, {"de": "DE"}, ["lorem"], ["ipsum"])
    found = documents(spark, sf_dir).select("doc_id", out.alias("x"))
    return found.select("doc_id", F.md5("x.text").alias("digest"), F.col("x.counts.loanwords").cast("long").alias("loanwords"), F.col("x.counts.loops").cast("long").alias("loops"))


def array_dedupe(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("values", F.array("source", F.upper("source"), "lang", F.lit(" "), F.concat(F.lit(" "), F.col("lang"))))
    return audit.array_dedupe_plan(d, "doc_id", ["values"]).select("doc_id", "field", "before", "after", F.array_join("values", ",").alias("values"))


def array_dedupe_summary(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("values", F.array("source", F.upper("source"), "lang"))
    return audit.dedupe_summary(audit.array_dedupe_plan(d, "doc_id", ["values", "speakers"]))


def chunk_audit(spark, sf_dir) -> DataFrame:
    return audit.totals(audit.measured(documents(spark, sf_dir)))


def chunk_audit_files(spark, sf_dir) -> DataFrame:
    return audit.by_file(audit.measured(documents(spark, sf_dir)), "source").select("source", "most_chars", "most_tokens", "flagged")


def dead_letters(spark, sf_dir) -> DataFrame:
    _, rejects = chunking.guarded(documents(spark, sf_dir))
    return rejects.select("doc_id", "reason", "head")


def sentence_chunks(spark, sf_dir) -> DataFrame:
    return chunking.sentence_chunks(documents(spark, sf_dir), "doc_id")


def catalog_chunks(spark, sf_dir) -> DataFrame:
    return chunking.sentence_chunks(documents(spark, sf_dir), "doc_id", rewind_always=False)


def _segments(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    s = F.struct(F.col("text"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 9).alias("end"), F.col("role").alias("speaker"))
    return c.groupBy(F.col("conv_id").cast("string").alias("source_file")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", s.alias("s")))), lambda x: x["s"]).alias("segments"))


def segment_chunks(spark, sf_dir) -> DataFrame:
    return chunking.segment_chunks(_segments(spark, sf_dir))


def section_groups(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("source_file"), F.col("turn").cast("int").alias("idx"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), "text", (F.col("turn") * 10.0).alias("start_sec"), (F.col("turn") * 10.0 + 9).alias("end_sec"))
    return chunking.sections(rows, 300)


def chunk_ids(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", ids.chunk_id(F.col("source_file"), F.lit(0), F.col("text")).alias("chunk_id"))


def file_rollup(spark, sf_dir) -> DataFrame:
    """A file's length, speakers and number of chunks."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.max(F.col("turn") * 10 + 9).alias("end_sec"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("speakers"), F.count("*").alias("chunks"))


def joined_texts(spark, sf_dir) -> DataFrame:
    """A file's chunks as one text, undated ones last."""
    c = table(spark, sf_dir, "conversations").withColumn("start", F.when(F.col("turn") % 3 != 1, F.col("turn")))
    order = F.sort_array(F.collect_list(F.struct(F.col("start").isNull().alias("late"), F.col("start"), F.col("turn"), F.col("text").alias("t"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(order, lambda s: s["t"]), " ").alias("text"))


def upsert_first_wins(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    return tables.insert_absent(o.where("key % 3 = 0").groupBy("key").agg(F.min("value").alias("value")), o, ["key"], [F.col("value")])


def upsert_last_wins(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    return tables.upsert(o.where("value % 2 = 0").groupBy("key").agg(F.min("value").alias("value")), o.where("value % 5 = 1"), ["key"], [F.col("value")])


def delete_by_source(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    return tables.delete(d, d.where("n_chars > 8000"), ["source", "lang"]).groupBy("source").agg(F.count("*").alias("n"))


def resume_work(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).select("source_file", "doc_id")
    ledger = d.where("doc_id % 4 <> 0").select("source_file", F.when(F.col("doc_id") % 4 == 1, "failed").otherwise("ok").alias("status"))
    return tables.resume(d, ledger, "source_file").select("doc_id")


def ledger_counts(spark, sf_dir) -> DataFrame:
    return tables.ledger_counts(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status")))


def ledger_attempts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("event_id").alias("ts"))
    ledger = runs.where("key < 50").select("key", F.lit("in_progress").alias("status"), F.lit(1).alias("attempts"), F.lit(-1).cast("long").alias("last_ts")).distinct()
    return tables.attempt(ledger, runs).select("key", "status", F.col("attempts").cast("long").alias("attempts"), "last_ts")


def _tracks(spark, sf_dir) -> DataFrame:
    """Orders as sittings, lines as their tracks, parts' brands as performers."""
    l, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("o_orderkey").alias("sitting"), F.to_date("o_orderdate").alias("session_date"), ((F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")) * 100 + F.ascii("l_returnflag")).alias("track_no"), F.array("p_brand", "p_type").alias("performers"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(F.lit(" ")).alias("detail"), F.col("o_orderpriority").alias("location"))


def catalog_collapse(spark, sf_dir) -> DataFrame:
    c = tables.collapse(_tracks(spark, sf_dir), "sitting", "track_no", ["session_date", "location"], ["performers"], ["detail"])
    return c.select("sitting", "n", "session_date", "location", F.array_join("performers", "|").alias("performers"), "detail")


def track_dedupe_last(spark, sf_dir) -> DataFrame:
    t = _tracks(spark, sf_dir).select("session_date", "sitting", "track_no")
    return tables.last_of(t, ["session_date"], [F.col("sitting"), F.col("track_no")])


def key_reconciliation(spark, sf_dir) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("k"))
    return tables.reconcile(o, l, "k")


def ambiguous_keys(spark, sf_dir) -> DataFrame:
    return tables.unambiguous(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("value")), "key", "value")


def optional_enrichment(spark, sf_dir) -> DataFrame:
    """Facets of a date and, where a sequence is given, that sequence alone."""
    chunks = documents(spark, sf_dir).where("session_date is not null").select("doc_id", "session_date", (F.col("doc_id") % 3).cast("int").alias("seq"))
    facets = chunks.where("doc_id % 5 = 0").select("session_date", F.when(F.col("doc_id") % 2 == 0, F.col("seq")).alias("seq"), F.col("doc_id").alias("track"))
    return tables.enrich_optional(chunks, facets, ["session_date"], "seq").select("doc_id", "track")


def join_keys(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    seq = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 4)
    return d.select("doc_id", ids.dated_key(F.col("session_date"), seq, F.col("doc_id") % 11).alias("join_key"))


def seasons(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).groupBy(dates.season(F.col("session_date")).alias("season")).agg(F.count("*").alias("n"))


def duration_decode(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.duration_seconds(F.round(F.col("o_totalprice") / 1000, 2)).alias("seconds"))


def performers_split(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(T.names(F.concat_ws(", ", F.concat(F.col("p_brand"), F.lit(" Ji")), F.col("p_type"), F.upper("p_brand"))), "|").alias("names"))


def catalog_tracks(spark, sf_dir) -> DataFrame:
    """Sitting cells made of orders' dates and read again."""
    o = table(spark, sf_dir, "orders")
    cell = F.concat(F.date_format("o_orderdate", "d MMM"), F.lit(" - "), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit("$ - "), F.lit("630 AM"))
    rows = o.select(F.year("o_orderdate").alias("CampYear"), F.lit("Pitampura, Delhi").alias("CampPlace"), cell.alias("Sitting"), (F.col("o_custkey") % 30).alias("TrackNo"), F.col("o_orderpriority").alias("Content"), F.round(F.col("o_totalprice") / 10000, 2).alias("Duration"), F.lit("Suman Ji, SUMAN, Richa").alias("Chorus"), F.lit("").alias("DetailContents"))
    t = catalog.tracks(rows)
    return t.select("join_key", "sitting_key", "session_time", "location", "duration_sec", F.array_join("performers", "|").alias("performers"), "warning")


def path_facts(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    path = F.format_string("Dagshai %d/%d APR %d$ 630 AM/%02d. Song %d.json", F.col("doc_id") % 20 + 1995, F.col("doc_id") % 28 + 1, F.col("doc_id") % 4 + 1, F.col("doc_id") % 60 + 1, F.col("doc_id"))
    return d.select("doc_id", catalog.path_facts(path).alias("f")).select("doc_id", "f.event_id", "f.year", "f.location", "f.session_date", "f.session_seq", "f.session_time", "f.track_no", "f.track_title", "f.track_type")


def running_prefix_slice(spark, sf_dir) -> DataFrame:
    return tables.slice_until(documents(spark, sf_dir).select("doc_id", "n_chars"), "n_chars", [F.col("n_chars"), F.col("doc_id")], 200_000)


def strided_sample(spark, sf_dir) -> DataFrame:
    return tables.strided(documents(spark, sf_dir).select("doc_id", "n_chars"), [F.col("n_chars"), F.col("doc_id")], 25)


def backfill_changes(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    return tables.date_changes(d, "session_date", F.coalesce("session_date", F.lit("2020-01-01").cast("date")))


def changed_seasons(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("season", F.lit("winter"))
    return tables.changed(d, {"season": dates.season(F.col("session_date"))}).select("doc_id", "new_season")


def store_sizes(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    return audit.sizes_compared(d, d.where("doc_id % 9 <> 0").withColumn("speakers", F.when(F.col("doc_id") % 4 == 0, F.array("source")).otherwise(F.col("speakers"))), "doc_id", "speakers")


def missing_chunks(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    return audit.missing(d, d.where("doc_id % 3 <> 0"), "doc_id", "source")


def sampled_presence(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id")
    return audit.sampled_presence(d, {"index": d, "store": d.where("doc_id >= 0")}, "doc_id", 50)


def stale_outputs(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    outputs, inputs = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("stem")).agg(F.min("o_orderdate").alias("mtime")), o.select(F.col("o_custkey").alias("stem"), F.col("o_orderdate").alias("mtime"))
    stamped = [x.select("stem", F.unix_timestamp(F.col("mtime").cast("timestamp")).alias("mtime")) for x in (outputs, inputs)]
    return audit.stale(*stamped)


def tags_denormalised(spark, sf_dir) -> DataFrame:
    """A file's labels on all its chunks: a join at read time, broadcast only if Spark finds the labels small."""
    d, l = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").groupBy("source", "quality").agg(F.count("*").alias("n"))


def tag_objects(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    chatty = F.concat(F.lit("Sure: "), F.to_json(F.struct(F.when(F.col("doc_id") % 5 == 0, "party").otherwise("satsang").alias("event_type"), F.lit("hindi").alias("primary_language"), F.array("lang", F.upper("lang"), "source").alias("topics"))), F.lit(" done"))
    return d.select("doc_id", models.parsed_tags(chatty).alias("t")).select("doc_id", "t.event_type", F.array_join("t.topics", "|").alias("topics"), F.array_contains(models.tag_errors(F.col("t")), "event_type").alias("bad_type"))


def chunk_headers(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", T.chunk_header(F.col("source_file"), F.lit(0.0), F.col("duration_sec"), F.col("speakers"), [F.col("lang")]).alias("header"))


def summary_texts(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    blank = F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.col("text"))
    return d.select("doc_id", T.summary_text(F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("speakers")), blank, F.col("lang")).alias("text"))


def packed_paragraphs(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(T.packed_paragraphs(F.col("text"), 400)).alias("pack")).groupBy("doc_id").agg(F.count("*").alias("packs"), F.sum(F.length("pack")).alias("chars"))


def entity_surfaces(spark, sf_dir) -> DataFrame:
    lines = documents(spark, sf_dir).select("source_file", F.lit(0).alias("pos"), "text")
    return cleaning.surfaces(lines, ["the", "der"], ["and", "of"]).groupBy("phrase").agg(F.sum("count").alias("n"))


def store_parity(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("key"))
    return audit.parity(d.where("key % 10 <> 3"), d.where("key % 10 <> 7"))


_MARKS = """',।॥.!?;:"''()[]{}—–-'"""


def _half_up(x: str) -> str:
    """A double rounded half up to two places by its decimal digits, as Spark does; DuckDB's round() of a double makes 77.19 of 77.195."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE)"


def _loops(lines: str) -> str:
    """CTEs from tokens of lines (doc_id, ln, line) to n: each token with its run's length and its place in the run."""
    return f"""tk AS (SELECT doc_id, ln, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM (SELECT doc_id, ln, {words('line')} AS w FROM {lines})),
tb AS (SELECT *, trim(t, {_MARKS}) AS bare FROM tk),
ts AS (SELECT *, CASE WHEN bare <> '' AND bare = lag(bare) OVER (PARTITION BY doc_id, ln ORDER BY i) THEN 0 ELSE 1 END AS new FROM tb),
tr AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, ln ORDER BY i) AS run FROM ts),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, ln, run) AS len, row_number() OVER (PARTITION BY doc_id, ln, run ORDER BY i) AS k FROM tr),
j AS (SELECT doc_id, ln, string_agg(t, ' ' ORDER BY i) AS short FROM n WHERE len < 6 OR k <= 3 GROUP BY 1, 2)"""


def _lines(source: str, text: str) -> str:
    return f"(SELECT doc_id, generate_subscripts(l, 1) AS ln, unnest(l) AS line FROM (SELECT doc_id, string_split({text}, chr(10)) AS l FROM {source}))"


def _tidy(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, ',(?:[ \\t]*,)+', ',', 'g'), '[ \\t]+([,।॥])', '\\1', 'g')"


_MAPPED = f"""m AS (SELECT doc_id, ln, string_agg(CASE WHEN trim(w, {_MARKS}) IN ('the', 'de') THEN replace(w, trim(w, {_MARKS}), upper(trim(w, {_MARKS}))) ELSE w END, ' ' ORDER BY i) AS line,
  count(*) FILTER (trim(w, {_MARKS}) = 'the') AS loanwords FROM (SELECT doc_id, ln, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT doc_id, ln, {words('line')} AS w FROM al)) GROUP BY 1, 2),
mt AS (SELECT doc_id, string_agg(coalesce(m.line, ''), chr(10) ORDER BY ln) AS text, CAST(coalesce(sum(loanwords), 0) AS BIGINT) AS loanwords FROM al LEFT JOIN m USING (doc_id, ln) GROUP BY 1)"""
_EXCISED = "regexp_replace(regexp_replace(text, '\\s*\\(\\s*([A-Za-z][A-Za-z0-9 ''\\-/&.]*)\\s*\\)', '', 'g'), '(?:lorem)(?:[\\s,]+(?:ipsum)){0,8}[\\s,]*', ' ', 'g')"
_STATE_SQL = words("text")
def _ranges(always: bool) -> str:
    """Chunks of sentences step by step: where a range ends, and where the next begins."""
    at = "CAST(greatest(r.e - {}, r.b + 1) AS BIGINT)".format("2" if always else "CASE WHEN r.e - r.b > 2 THEN 2 ELSE 0 END")
    reach = lambda a: f"coalesce(list_min(list_filter(range({a} + 1, n + 1), lambda e: c[e + 1] - c[{a} + 1] >= 450)), n)"
    end = "CASE WHEN x >= a + 2 AND c[x + 1] - c[a + 1] > 700 THEN x - 1 ELSE x END"
    return rf"""WITH RECURSIVE p AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?।॥])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS p FROM documents
), z AS (SELECT doc_id, p, list_transform(p, lambda s: greatest(1, CAST(round_even(len({words('s')}) * 1.3::DOUBLE, 0) AS BIGINT))) AS z FROM p
), d AS MATERIALIZED (SELECT doc_id, p, len(p) AS n, list_transform(range(0, len(p) + 1), lambda i: coalesce(list_sum(list_slice(z, 1, i)), 0)) AS c FROM z
), r AS (
  SELECT doc_id, 0 AS idx, a AS b, {end} AS e FROM (SELECT doc_id, n, c, CAST(0 AS BIGINT) AS a, {reach('0')} AS x FROM d WHERE n > 0)
  UNION ALL
  SELECT doc_id, idx, a, {end} FROM (SELECT *, {reach('a')} AS x FROM (SELECT r.doc_id, r.idx + 1 AS idx, {at} AS a, d.n, d.c FROM r JOIN d ON d.doc_id = r.doc_id WHERE r.e < d.n))
), t AS (SELECT r.*, array_to_string(p[b + 1 : e], ' ') AS text FROM r JOIN d USING (doc_id))
SELECT doc_id AS id, CAST(idx AS INTEGER) AS idx, text, CAST(b AS INTEGER) AS sentence_start, CAST(e AS INTEGER) AS sentence_end, CAST(len({words('text')}) AS INTEGER) AS word_count FROM t"""


SQL = {
    "sentence_chunks": _ranges(True),
    "catalog_chunks": _ranges(False),
    "section_groups": """WITH RECURSIVE o AS (SELECT conv_id, turn, greatest(length(text) // 4, 1) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
p AS (
  SELECT *, 0 AS section, t AS held FROM o WHERE k = 1
  UNION ALL
  SELECT o.*, CASE WHEN p.held + o.t > 300 THEN p.section + 1 ELSE p.section END, CASE WHEN p.held + o.t > 300 THEN o.t ELSE p.held + o.t END FROM p JOIN o ON o.conv_id = p.conv_id AND o.k = p.k + 1
) SELECT CAST(conv_id AS VARCHAR) AS source_file, CAST(section AS INTEGER) AS section, count(*) AS n_chunks, CAST(sum(t) AS BIGINT) AS tokens, min(turn) * 10.0::DOUBLE AS start_sec, max(turn) * 10.0::DOUBLE + 9 AS end_sec, list(conv_id || '-' || turn ORDER BY turn) AS chunk_ids FROM p GROUP BY conv_id, section""",
    "loop_collapse": f"WITH al AS {_lines('documents', 'text')}, {_loops('al')} SELECT doc_id, md5(text) AS digest, length(text) AS length FROM (SELECT doc_id, string_agg(coalesce(short, ''), chr(10) ORDER BY ln) AS text FROM al LEFT JOIN j USING (doc_id, ln) GROUP BY 1)",
    "normalised_texts": f"""WITH al AS {_lines('documents', 'text')}, {_MAPPED}, xl AS {_lines('mt', _tidy(_EXCISED))}, {_loops('xl')}, c AS (SELECT doc_id, count(*) AS loops FROM n WHERE k = 1 AND len >= 6 GROUP BY 1),
f AS (SELECT doc_id, {_tidy("string_agg(coalesce(short, ''), chr(10) ORDER BY ln)")} AS text FROM xl LEFT JOIN j USING (doc_id, ln) GROUP BY 1)
SELECT doc_id, md5(f.text) AS digest, loanwords, coalesce(loops, 0) AS loops FROM f JOIN mt USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "chunk_ids": """WITH d AS (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '/' || lang || '/' || doc_id || '|0|' || substr(sha256(text), 1, 16))) AS h FROM documents)
SELECT doc_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS chunk_id FROM d""",
    "performers_split": "SELECT p_partkey, p_brand || CASE WHEN upper(p_type) = upper(p_brand) THEN '' ELSE '|' || CASE WHEN p_type IN (upper(p_type), lower(p_type)) THEN upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) ELSE p_type END END AS names FROM part",
    "packed_paragraphs": r"""WITH p AS (SELECT doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n|\n'), lambda x: trim(x)), lambda x: x <> ''), lambda x: [length(x)]) AS l FROM documents),
r AS (SELECT doc_id, list_reduce(l, lambda s, e: CASE WHEN s[2] > 0 AND s[2] + 1 + e[1] <= 400 THEN [s[1], s[2] + 1 + e[1], s[3] + 1 + e[1]] ELSE [s[1] + 1, e[1], s[3] + e[1]] END, CAST([0, 0, 0] AS BIGINT[])) AS s FROM p WHERE len(l) > 0)
SELECT doc_id, s[1] AS packs, s[3] AS chars FROM r""",
    "entity_surfaces": f"""WITH t AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM (SELECT doc_id, {words('text')} AS w FROM documents)),
w AS (SELECT t, lag(t) OVER o AS a, lag(t, 2) OVER o AS b FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, t IN ('the', 'der') AS s, length(a) >= 3 AND a NOT IN ('the', 'der', 'and', 'of') AS na, length(b) >= 3 AND b NOT IN ('the', 'der', 'and', 'of') AS nb FROM w)
SELECT phrase, count(*) AS n FROM (SELECT a || ' ' || t AS phrase FROM g WHERE s AND na UNION ALL SELECT b || ' ' || a || ' ' || t FROM g WHERE s AND na AND nb) GROUP BY 1""",
    "token_estimates": f"SELECT doc_id, CAST(greatest(1, round_even(len({_STATE_SQL}) * 1.3::DOUBLE, 0)) AS INTEGER) AS tokens FROM documents",
    "unique_ratios": f"SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_distinct(w)) / len(w)::DOUBLE END, 6) AS ratio FROM (SELECT doc_id, {_STATE_SQL} AS w FROM documents)",
    "sentence_split": r"SELECT doc_id, count(*) AS n, max(length(s)) AS longest FROM (SELECT doc_id, trim(s, ' ' || chr(10)) AS s FROM (SELECT doc_id, unnest(string_split(regexp_replace(trim(text), '([.!?।॥])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents)) WHERE s <> '' GROUP BY 1",
    "titles": "SELECT conv_id, turn, CASE WHEN length(l) > 80 THEN rtrim(left(l, 79)) || '…' ELSE l END AS title FROM (SELECT conv_id, turn, trim(string_split(trim(text), chr(10))[1]) AS l FROM conversations)",
    "languages": r"SELECT CASE WHEN d / nullif(d + l, 0)::DOUBLE >= 0.2 THEN 'hindi' ELSE 'english' END AS language, count(*) AS n FROM (SELECT length(regexp_replace(t, '[^ऀ-ॿ]', '', 'g')) AS d, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS l FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN repeat('कैसे हैं आप सब लोग आज ', doc_id % 60) || text ELSE text END AS t FROM documents)) GROUP BY 1",
    "repetition_scores": "SELECT doc_id, round(CASE WHEN len(p) < 2 THEN 0.0 ELSE 1 - len(list_distinct(p)) / len(p)::DOUBLE END, 6) AS score FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)",
    "array_dedupe": "SELECT doc_id, 'values' AS field, CAST(5 AS INTEGER) AS before, CAST(2 AS INTEGER) AS after, source || ',' || lang AS values FROM documents",
    "array_dedupe_summary": "SELECT 'values' AS field, count(*) AS n_rows, count(*) AS removed FROM documents",
    "chunk_audit": f"""WITH m AS (SELECT length(text) AS chars, len({_STATE_SQL}) AS n, round(CASE WHEN len({_STATE_SQL}) = 0 THEN 1.0 ELSE len(list_distinct({_STATE_SQL})) / len({_STATE_SQL})::DOUBLE END, 6) AS r, ceil(length(text) / 4.0) AS t FROM documents)
SELECT count(*) AS n, count(*) FILTER (n >= 50 AND r < 0.15) AS loops, count(*) FILTER (chars > 6000) AS over_char, count(*) FILTER (t > 8192) AS over_token, count(*) FILTER (n >= 50 AND r < 0.15 AND chars > 6000) AS loop_and_long,
  count(*) FILTER (NOT (n >= 50 AND r < 0.15) AND chars > 6000) AS long_alone, CAST(max(chars) AS INTEGER) AS most_chars, min(r) FILTER (n >= 50) AS least_ratio FROM m""",
    "chunk_audit_files": f"""WITH m AS (SELECT source, length(text) AS chars, len({_STATE_SQL}) AS n, len(list_distinct({_STATE_SQL})) / nullif(len({_STATE_SQL}), 0)::DOUBLE AS r FROM documents)
SELECT source, CAST(max(chars) AS INTEGER) AS most_chars, CAST(max(ceil(chars / 4.0)) AS BIGINT) AS most_tokens, count(*) FILTER ((n >= 50 AND r < 0.15) OR chars > 6000) AS flagged FROM m GROUP BY 1 HAVING flagged > 0""",
    "dead_letters": f"""SELECT doc_id, CASE WHEN n >= 50 AND d / n::DOUBLE < 0.15 THEN 'asr_loop' ELSE 'single_token' END AS reason, replace(left(text, 200), chr(10), ' ') AS head FROM (SELECT doc_id, text, len({_STATE_SQL}) AS n, len(list_distinct({_STATE_SQL})) AS d FROM documents) WHERE d <= 1 OR (n >= 50 AND d / n::DOUBLE < 0.15)""",
    "file_rollup": "SELECT conv_id, max(turn * 10 + 9) AS end_sec, string_agg(DISTINCT role, ',' ORDER BY role) AS speakers, count(*) AS chunks FROM conversations GROUP BY 1",
    "joined_texts": "SELECT conv_id, string_agg(text, ' ' ORDER BY CASE WHEN turn % 3 <> 1 THEN turn END NULLS LAST, turn) AS text FROM conversations GROUP BY 1",
    "upsert_first_wins": "SELECT o_custkey AS key, min(o_orderkey) AS value FROM orders GROUP BY 1",
    "upsert_last_wins": "WITH a AS (SELECT o_custkey AS key, min(o_orderkey) AS value FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS key, max(o_orderkey) AS value FROM orders WHERE o_orderkey % 5 = 1 GROUP BY 1) SELECT coalesce(a.key, b.key) AS key, coalesce(b.value, a.value) AS value FROM a FULL JOIN b ON a.key = b.key",
    "delete_by_source": "SELECT source, count(*) AS n FROM documents WHERE (source, lang) NOT IN (SELECT (source, lang) FROM documents WHERE n_chars > 8000) GROUP BY 1",
    "resume_work": "SELECT doc_id FROM documents WHERE doc_id % 4 < 2",
    "ledger_counts": "SELECT s AS status, (SELECT count(*) FROM orders WHERE (o_orderstatus = 'F' AND s = 'failed') OR (o_orderstatus <> 'F' AND s = 'ok')) AS n FROM (SELECT unnest(['ok', 'failed', 'in_progress']) AS s)",
    "ledger_attempts": "SELECT user_id AS key, arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END, event_id) AS status, count(*) + CASE WHEN user_id < 50 THEN 1 ELSE 0 END AS attempts, max(event_id) AS last_ts FROM events GROUP BY user_id",
    "catalog_collapse": """WITH t AS (SELECT o_orderkey AS sitting, CAST(o_orderdate AS DATE) AS d, (l_linenumber * 10000000 + l_partkey) * 100 + ascii(l_returnflag) AS k, [p_brand, p_type] AS p, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS detail, o_orderpriority AS loc FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
e AS (SELECT sitting, unnest(p) AS v, k * 10 + generate_subscripts(p, 1) AS pos FROM t), f AS (SELECT sitting, v, min(pos) AS pos FROM e GROUP BY 1, 2), g AS (SELECT sitting, string_agg(v, '|' ORDER BY pos) AS performers FROM f GROUP BY 1)
SELECT sitting, count(*) AS n, arg_min(d, k) AS session_date, arg_min(loc, k) AS location, any_value(performers) AS performers, arg_min(detail, k) FILTER (detail IS NOT NULL) AS detail FROM t JOIN g USING (sitting) GROUP BY 1""",
    "track_dedupe_last": "WITH t AS (SELECT CAST(o_orderdate AS DATE) AS session_date, o_orderkey AS sitting, (l_linenumber * 10000000 + l_partkey) * 100 + ascii(l_returnflag) AS track_no FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT session_date, sitting, track_no FROM (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY sitting DESC, track_no DESC) AS n FROM t) WHERE n = 1",
    "key_reconciliation": """WITH a AS (SELECT p_partkey AS k FROM part WHERE p_size > 20), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS matched, count(*) FILTER (y IS NULL) AS left_only, count(*) FILTER (x IS NULL) AS right_only, round(100.0::DOUBLE * count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*) FILTER (x IS NOT NULL), 2) AS pct FROM j""",
    "ambiguous_keys": "SELECT l_orderkey AS key, min(l_returnflag) AS value FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1",
    "optional_enrichment": f"WITH {DOCS}, c AS (SELECT doc_id, session_date, CAST(doc_id % 3 AS INTEGER) AS seq FROM docs WHERE session_date IS NOT NULL), f AS (SELECT session_date, CASE WHEN doc_id % 2 = 0 THEN seq END AS seq, doc_id AS track FROM c WHERE doc_id % 5 = 0) SELECT c.doc_id, f.track FROM c JOIN f ON c.session_date = f.session_date AND (f.seq IS NULL OR f.seq = c.seq)",
    "join_keys": f"WITH {DOCS} SELECT doc_id, CASE WHEN session_date IS NOT NULL THEN session_date || '|' || coalesce(CAST(CASE WHEN doc_id % 5 <> 0 THEN doc_id % 4 END AS VARCHAR), '') || '|' || (doc_id % 11) END AS join_key FROM docs",
    "seasons": f"WITH {DOCS} SELECT CASE WHEN month(session_date) <= 2 THEN 'winter' WHEN month(session_date) <= 5 THEN 'summer' WHEN month(session_date) <= 9 THEN 'monsoon' WHEN session_date IS NOT NULL THEN 'post-monsoon' END AS season, count(*) AS n FROM docs GROUP BY 1",
    "duration_decode": f"SELECT o_orderkey, CASE WHEN s < 60 THEN CAST(m * 60 + s AS INTEGER) END AS seconds FROM (SELECT o_orderkey, floor(x) AS m, round_even((x - floor(x)) * 100, 0) AS s FROM (SELECT o_orderkey, {_half_up('o_totalprice / 1000')} AS x FROM orders))",
    "running_prefix_slice": "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS c FROM documents) WHERE c - n_chars < 200000",
    "strided_sample": "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r IN (SELECT floor(i * (n - 1) / 24) FROM (SELECT unnest(generate_series(0, 24)) AS i, (SELECT count(*) FROM documents) AS n))",
    "backfill_changes": f"WITH {DOCS} SELECT count(*) FILTER (session_date IS NULL) AS gained, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS moved FROM docs",
    "changed_seasons": f"WITH {DOCS} SELECT doc_id, CASE WHEN month(session_date) <= 5 THEN 'summer' WHEN month(session_date) <= 9 THEN 'monsoon' WHEN session_date IS NOT NULL THEN 'post-monsoon' END AS new_season FROM docs WHERE session_date IS NULL OR month(session_date) > 2",
    "store_sizes": "SELECT CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 4 = 0 THEN 'under' ELSE 'same' END AS state, count(*) AS n FROM documents GROUP BY 1",
    "missing_chunks": "SELECT source, count(*) AS missing FROM documents WHERE doc_id % 3 = 0 GROUP BY 1",
    "sampled_presence": 'SELECT least(50, count(*)) AS n, least(50, count(*)) AS "index", least(50, count(*)) AS store FROM documents',
    "stale_outputs": "WITH o AS (SELECT o_custkey AS stem, min(epoch(o_orderdate)) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), i AS (SELECT o_custkey AS stem, max(epoch(o_orderdate)) AS m FROM orders GROUP BY 1) SELECT stem, round((i.m - o.m) / 3600.0::DOUBLE, 6) AS hours FROM o JOIN i USING (stem) WHERE i.m - o.m > 2",
    "tags_denormalised": "SELECT source, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "tag_objects": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'party' ELSE 'satsang' END AS event_type, lang || '|' || source AS topics, doc_id % 5 = 0 AS bad_type FROM documents",
    "chunk_headers": f"WITH {DOCS} SELECT doc_id, 'File: ' || source_file || ' | 00:00:00-' || printf('%02d:%02d:%02d', CAST(floor(duration_sec) AS BIGINT) // 3600, CAST(floor(duration_sec) AS BIGINT) % 3600 // 60, CAST(floor(duration_sec) AS BIGINT) % 60) || ' | Speakers: ' || source || ', ' || lang || ' | ' || lang AS header FROM docs",
    "summary_texts": "SELECT doc_id, concat_ws(chr(10), source, CASE WHEN doc_id % 3 <> 0 THEN 'Topics: ' || source || ', ' || lang END, CASE WHEN doc_id % 2 = 0 OR trim(text) = '' THEN lang ELSE trim(text) END) AS text FROM documents",
    "store_parity": "SELECT doc_id AS key, CASE WHEN doc_id % 10 = 7 THEN 'key_only' ELSE 'file_only' END AS side FROM documents WHERE doc_id % 10 IN (3, 7)",
    "path_facts": """SELECT doc_id, 'Dagshai ' || y AS event_id, CAST(y AS INTEGER) AS year, 'DAGSHAI' AS location, make_date(y, 4, doc_id % 28 + 1) AS session_date, CAST(doc_id % 4 + 1 AS INTEGER) AS session_seq, '06:30' AS session_time, CAST(doc_id % 60 + 1 AS INTEGER) AS track_no, 'Song ' || doc_id AS track_title, 'bhajan' AS track_type FROM (SELECT doc_id, doc_id % 20 + 1995 AS y FROM documents)""",
    "catalog_tracks": f"""WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 + 1 AS q, o_custkey % 30 AS k, {_half_up('o_totalprice / 10000')} AS u FROM orders)
SELECT d || '|' || q || '|' || k AS join_key, d || '|' || q || '|' AS sitting_key, '06:30' AS session_time, 'DELHI' AS location, CASE WHEN round_even((u - floor(u)) * 100, 0) < 60 THEN CAST(floor(u) * 60 + round_even((u - floor(u)) * 100, 0) AS INTEGER) END AS duration_sec, 'Suman|Richa' AS performers, CAST(NULL AS VARCHAR) AS warning FROM x""",
}
QUERIES = {f.__name__: f for f in (
    token_estimates, unique_ratios, sentence_split, titles, languages, repetition_scores, loop_collapse, normalised_texts, array_dedupe, array_dedupe_summary, chunk_audit, chunk_audit_files, dead_letters, sentence_chunks, catalog_chunks,
    segment_chunks, section_groups, chunk_ids, file_rollup, joined_texts, upsert_first_wins, upsert_last_wins, delete_by_source, resume_work, ledger_counts, ledger_attempts, catalog_collapse, track_dedupe_last, key_reconciliation, ambiguous_keys,
    optional_enrichment, join_keys, seasons, duration_decode, performers_split, catalog_tracks, path_facts, running_prefix_slice, strided_sample, backfill_changes, changed_seasons, store_sizes, missing_chunks, sampled_presence, stale_outputs,
    tags_denormalised, tag_objects, chunk_headers, summary_texts, packed_paragraphs, entity_surfaces, store_parity,
)}

"""Registered queries over structures that are built first and then searched: section trees, inverted lists of vectors, segments of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import builds, ranking, section_trees, vector_index
from ..operators.segments import TextIndex
from ..sources.shared import shared_folder
from ..sources.stores import Stores
from . import retrieval
from .base import documents, table, tokens

#: Tokens of a section in the query over conversations.
_SECTION = 200


def _chunks(spark, sf_dir) -> DataFrame:
    """Turns as chunks of their conversations: two seconds a turn, the role as speaker."""
    t = table(spark, sf_dir, "conversations")
    return t.select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("source_file"), F.col("turn").cast("long").alias("idx"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), "text",
        (F.col("turn") * 2.0).alias("start_sec"), (F.col("turn") * 2.0 + 2).alias("end_sec"), F.array("role").alias("speakers"),
    )


def section_nodes(spark, sf_dir) -> DataFrame:
    n = section_trees.build(_chunks(spark, sf_dir), _SECTION)
    return n.select("source_file", "node_id", "chunk_count", "title", "start_sec", "end_sec", F.concat_ws(",", "speakers").alias("speakers"), F.concat_ws(",", "chunk_ids").alias("chunk_ids"), F.md5("text").alias("text_md5"))


def section_search(spark, sf_dir) -> DataFrame:
    """Files ranked by their outlines' titles, then nodes, then the chosen nodes' texts, from trees that were written and read again."""
    path = shared_folder(spark)
    section_trees.write(section_trees.build(_chunks(spark, sf_dir), _SECTION), path)
    outlines, texts = section_trees.read(spark, path)
    q = retrieval._passages(spark, sf_dir)
    titles = outlines.groupBy(F.col("source_file").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "title"))), lambda x: x["title"]), " ").alias("text"))
    ranked = ranking.lexical_nearest(q, titles, section_trees.CANDIDATE_FILES).select("query_id", F.col("id").alias("source_file"), (F.col("rank") + 1).alias("place"))
    found = section_trees.search(outlines, texts, q, ranked)
    return found.select("query_id", "place", "chunk_id", "score", "start_sec", "end_sec", F.element_at("metadata", "section_title").alias("title"))


def indexed_cosine_topk(spark, sf_dir) -> DataFrame:
    v = retrieval._vectors(spark, sf_dir)
    path = shared_folder(spark)
    vector_index.build(v, path, ("label",))
    return vector_index.search(spark, path, retrieval._asked(v), 10).select("query_id", "id", "score")


def indexed_filtered_topk(spark, sf_dir) -> DataFrame:
    v = retrieval._vectors(spark, sf_dir)
    path = shared_folder(spark)
    vector_index.build(v, path, ("label",))
    return vector_index.search(spark, path, retrieval._asked(v), 5, where="label = 3").select("query_id", "id", "score")


def segmented_bm25(spark, sf_dir) -> DataFrame:
    """Three segments, one source deleted and added again, one segment replaced: the same rows as from an index built at once."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_file"))
    index = TextIndex(spark, shared_folder(spark))
    for i in range(3):
        index.add(d.where(F.crc32(F.col("source_file").cast("binary")) % 3 == i))
    index.delete(spark.createDataFrame([("src0",)], "source_file string"))
    index.add(d.where("source_file = 'src0'"))
    index.add(d.where("source_file = 'src1'"), replace=True)
    found = index.bm25(retrieval._passages(spark, sf_dir), 10)
    return found.select("query_id", "id", F.round("score", 4).alias("score"))


def summary_builds(spark, sf_dir) -> DataFrame:
    """A summary index built, run again, and run after titles of every tenth file changed and every eleventh file went: what each run wrote and what is held."""
    d = documents(spark, sf_dir)
    tagged = F.when(F.col("doc_id") % 5 != 0, F.lit("2024-01-01"))
    files = d.select("doc_id", "source_file", F.concat(F.lit("File "), F.col("doc_id").cast("string")).alias("title"), F.array("source").alias("topics"), "text", tagged.alias("tagged_at"))
    files = files.select("doc_id", "source_file", "title", "topics", F.col("text").alias("summary"), F.lit(None).cast("string").alias("other"), "tagged_at")
    later = files.where("doc_id % 11 <> 0").withColumn("title", F.when(F.col("doc_id") % 10 == 1, F.concat("title", F.lit(" again"))).otherwise(F.col("title")))
    stores = Stores(spark, shared_folder(spark), {"summaries": "source_file"})
    wrote = [builds.build_summaries(stores, f.drop("doc_id"), prune=True) for f in (files, files, later)]
    held = stores.table("summaries")
    facts = held.agg(F.count("*").alias("held"), F.count_distinct("id").alias("ids"), F.count_if(F.col("title").endswith("again")).alias("changed"))
    return facts.select(*[F.lit(w).cast("long").alias(f"run{i + 1}") for i, w in enumerate(wrote)], "held", "ids", "changed")


def store_deletes(spark, sf_dir) -> DataFrame:
    """Sources deleted from chunks, facts and ledger at once, their ledger entries reset: what each table holds after, and whether anything went."""
    d = documents(spark, sf_dir).select("doc_id", F.col("source").alias("source_file"), "n_chars")
    sources = d.select("source_file").distinct()
    stores = Stores(spark, shared_folder(spark), {"chunks": "source_file", "facts": "source_file", "ledger": "source_file"})
    stores.change({"chunks": d, "facts": sources.withColumn("tagged_at", F.lit("2024-01-01")), "ledger": sources.withColumn("status", F.lit("ok"))})
    gone = sources.where("source_file in ('src0', 'src3')")
    went = stores.delete(gone, {"facts": gone.withColumn("tagged_at", F.lit(None).cast("string")), "ledger": gone.withColumn("status", F.lit("pending"))})
    again = stores.delete(spark.createDataFrame([("no such source",)], "source_file string"))
    chunks = stores.table("chunks").groupBy("source_file").agg(F.count("*").alias("n_chunks"), F.sum("n_chars").alias("n_chars"))
    rows = stores.table("ledger").join(stores.table("facts"), "source_file").join(chunks, "source_file", "left")
    return rows.select("source_file", "status", "tagged_at", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.lit(went).alias("went"), F.lit(again).alias("went_again"))


_SECTIONS = f"""ordered AS (
  SELECT 'conv/' || conv_id AS source_file, conv_id, turn, role, text, greatest(length(coalesce(text, '')) // 4, 1) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations
), placed AS (
  SELECT *, 1 AS section, t AS held FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.*, CASE WHEN p.held + o.t > {_SECTION} THEN p.section + 1 ELSE p.section END, CASE WHEN p.held + o.t > {_SECTION} THEN o.t ELSE p.held + o.t END FROM placed p JOIN ordered o ON o.conv_id = p.conv_id AND o.k = p.k + 1
), nodes AS (
  SELECT source_file, lpad(CAST(section AS VARCHAR), 4, '0') AS node_id, min(turn) * 2.0::DOUBLE AS start_sec, max(turn) * 2.0::DOUBLE + 2 AS end_sec,
    string_agg(conv_id || '-' || turn, ',' ORDER BY turn) AS chunk_ids, count(*) AS n, regexp_replace(string_agg(coalesce(text, ''), chr(10) ORDER BY turn), '^\\s+|\\s+$', '', 'g') AS text, list(role ORDER BY turn) AS roles
  FROM placed GROUP BY source_file, section
), titled AS (SELECT *, regexp_replace(left(text, 60), '^\\s+|\\s+$', '', 'g') AS title FROM nodes)"""
_SHARE = "round(len(list_intersect(q.w, {0})) / len(q.w)::DOUBLE, 4)"
SQL = {
    "section_nodes": f"""WITH RECURSIVE {_SECTIONS}
SELECT source_file, node_id, CAST(sum(n) OVER (PARTITION BY source_file) AS BIGINT) AS chunk_count, title, start_sec, end_sec, array_to_string(list_filter(roles, lambda r, i: list_position(roles, r) = i), ',') AS speakers, chunk_ids, md5(text) AS text_md5 FROM titled""",
    "section_search": f"""WITH RECURSIVE {_SECTIONS}, q AS (SELECT item_id AS query_id, list_distinct({tokens('text')}) AS w FROM benchmark),
files AS (SELECT source_file, {tokens("string_agg(title, ' ' ORDER BY node_id)")} AS t FROM titled GROUP BY 1),
candidates AS (SELECT * FROM (SELECT q.query_id, q.w, f.source_file, row_number() OVER (PARTITION BY q.query_id ORDER BY {_SHARE.format('f.t')} DESC, f.source_file) AS file_place FROM q, files f) WHERE file_place <= {section_trees.CANDIDATE_FILES}),
chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY s DESC, node_id) AS node_place FROM (SELECT q.query_id, q.w, q.file_place, t.*, {_SHARE.format(tokens('t.title'))} AS s FROM candidates q JOIN titled t USING (source_file)) WHERE s > 0),
scored AS (SELECT q.*, {_SHARE.format(tokens('q.text'))} AS score FROM chosen q)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_place, node_place, source_file, node_id) AS INTEGER) AS place, source_file || '#' || node_id AS chunk_id, score, start_sec, end_sec, title FROM scored) WHERE place <= {section_trees.DEFAULT_K}""",
    "indexed_cosine_topk": retrieval.SQL["cosine_topk"],
    "indexed_filtered_topk": retrieval.SQL["filtered_cosine_topk"],
    "segmented_bm25": retrieval.SQL["bm25_topk"],
    "summary_builds": """WITH f AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0), l AS (SELECT doc_id FROM f WHERE doc_id % 11 <> 0)
SELECT (SELECT count(*) FROM f) AS run1, CAST(0 AS BIGINT) AS run2, count(*) FILTER (doc_id % 10 = 1) AS run3, count(*) AS held, count(*) AS ids, count(*) FILTER (doc_id % 10 = 1) AS changed FROM l""",
    "store_deletes": """SELECT source AS source_file, CASE WHEN source IN ('src0', 'src3') THEN 'pending' ELSE 'ok' END AS status, CASE WHEN source IN ('src0', 'src3') THEN NULL ELSE '2024-01-01' END AS tagged_at,
  count(*) FILTER (source NOT IN ('src0', 'src3')) AS n_chunks, CAST(coalesce(sum(n_chars) FILTER (source NOT IN ('src0', 'src3')), 0) AS BIGINT) AS n_chars, count(*) FILTER (source IN ('src0', 'src3')) >= 0 AS went, FALSE AS went_again FROM documents GROUP BY source""",
}
QUERIES = {f.__name__: f for f in (section_nodes, section_search, indexed_cosine_topk, indexed_filtered_topk, segmented_bm25, summary_builds, store_deletes)}

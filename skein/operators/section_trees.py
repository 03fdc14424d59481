"""Section trees: a file's chunks grouped to sections with titles and summaries, kept as tables, and a search that goes from files to the
nodes of their trees and reads the text of chosen nodes alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import json_object
from .models import call
from .ranking import lexical_scorer, top

#: Tokens of a section at most, characters a token, characters of a title that stands in for a model's, files a query reasons over, results.
SECTION_TOKENS, TOKEN_CHARS, TITLE_CHARS, CANDIDATE_FILES, DEFAULT_K = 2000, 4, 60, 6, 8
NODE_SCHEMA = "node_id string, title string, summary string, source_file string, start_sec double, end_sec double, speakers array<string>, chunk_ids array<string>, text string"
TREE_SCHEMA = "source_file string, model string, chunk_count long, doc_description string, nodes array<struct<" + ", ".join(":".join(f.split(" ", 1)) for f in NODE_SCHEMA.split(", ")) + ">>"


def numbered_sections(rows: DataFrame, most: int = SECTION_TOKENS) -> DataFrame:
    """rows (source_file, idx, text, ...) with the number of their section, from 1: consecutive chunks of a file up to `most` tokens, never none.

    A file's rows come in order to one task, which keeps two numbers of the file it reads and nothing else, however long it is."""
    size = F.greatest(F.floor(F.length(F.coalesce("text", F.lit(""))) / TOKEN_CHARS), F.lit(1)).cast("long")
    ordered = rows.withColumn("_size", size).repartition("source_file").sortWithinPartitions("source_file", "idx")
    schema = ordered.drop("_size").schema.add("section", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, section, held = None, 0, 0
        for b in batches:
            numbers = []
            for f, t in zip(b.column("source_file").to_pylist(), b.column("_size").to_pylist(), strict=True):
                if f != file:
                    file, section, held = f, 1, t
                elif held + t > most:
                    section, held = section + 1, t
                else:
                    held += t
                numbers.append(section)
            kept = [n for n in b.schema.names if n != "_size"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(numbers, pa.int32())], [*kept, "section"])

    return ordered.mapInArrow(run, schema)


def build(chunks: DataFrame, most: int = SECTION_TOKENS, titler: Callable[[str], str] | None = None, summariser: Callable[[str], str] | None = None, describer: Callable[[str], str] | None = None, model: str = "none") -> DataFrame:
    """One row a node: its file's facts (source_file, model, chunk_count, doc_description) and its own (node_id, title, summary, times, speakers in
    order, chunk_ids, text).

    chunks: source_file, idx, chunk_id, text, start_sec, end_sec, speakers. Models are functions from text to text; a title that is missing or blank is the
    text's beginning, a missing summary or description is empty. An outline of titles and summaries is what the describer reads."""
    placed = numbered_sections(chunks.where(F.col("source_file").isNotNull()), most)
    inside = F.sort_array(F.collect_list(F.struct("idx", F.col("chunk_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("speakers", F.array().cast("array<string>")).alias("who"))))
    grouped = placed.groupBy("source_file", "section").agg(inside.alias("c"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))
    part = lambda name: F.transform("c", lambda x: x[name])
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    nodes = grouped.select(
        "source_file", F.lpad(F.col("section").cast("string"), 4, "0").alias("node_id"), "start_sec", "end_sec", F.array_distinct(F.flatten(part("who"))).alias("speakers"),
        part("id").alias("chunk_ids"), strip(F.array_join(part("text"), "\n")).alias("text"),
    )
    begins = strip(F.substring("text", 1, TITLE_CHARS))
    title = F.coalesce(F.nullif(F.trim(call(titler)(F.col("text"))), F.lit("")), begins) if titler else begins
    summary = F.coalesce(F.trim(call(summariser)(F.col("text"))), F.lit("")) if summariser else F.lit("")
    nodes = nodes.withColumn("title", title).withColumn("summary", summary)
    line = F.concat(F.lit("- "), "title", F.lit(": "), "summary")
    outline = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", line.alias("line")))), lambda x: x["line"]), "\n")
    files = nodes.groupBy("source_file").agg(outline.alias("outline"), F.sum(F.size("chunk_ids")).alias("chunk_count"))
    described = F.coalesce(F.trim(call(describer)(F.col("outline"))), F.lit("")) if describer else F.lit("")
    facts = files.select("source_file", F.lit(model).alias("model"), "chunk_count", described.alias("doc_description"))
    return nodes.join(facts, "source_file").select("source_file", "model", "chunk_count", "doc_description", "node_id", "title", "summary", "start_sec", "end_sec", "speakers", "chunk_ids", "text")


def write(nodes: DataFrame, path: str) -> None:
    """Keep trees as two tables: outlines, which every search reads, and texts, ordered by file so that a search reads only those of chosen nodes."""
    nodes.drop("text").repartitionByRange("source_file").sortWithinPartitions("source_file", "node_id").write.mode("overwrite").parquet(f"{path}/outlines")
    nodes.select("source_file", "node_id", "text").repartitionByRange("source_file").sortWithinPartitions("source_file", "node_id").write.mode("overwrite").parquet(f"{path}/texts")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The outlines and the texts that write left."""
    return spark.read.parquet(f"{path}/outlines"), spark.read.parquet(f"{path}/texts")


def split(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.drop("text"), nodes.select("source_file", "node_id", "text")


def from_json(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Nodes of trees kept as JSON, one file a tree. A file that cannot be read, or that names no source, counts as none."""
    trees = spark.read.schema(TREE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", glob).option("recursiveFileLookup", True).json(path)
    each = trees.where(F.col("source_file").isNotNull()).select("source_file", "model", "chunk_count", F.coalesce("doc_description", F.lit("")).alias("doc_description"), F.explode("nodes").alias("n"))
    texts = [F.coalesce(F.col(f"n.{c}"), F.lit("")).alias(c) for c in ("title", "summary")]
    lists = [F.coalesce(F.col(f"n.{c}"), F.array().cast("array<string>")).alias(c) for c in ("speakers", "chunk_ids")]
    return each.select("source_file", "model", "chunk_count", "doc_description", "n.node_id", *texts, "n.start_sec", "n.end_sec", *lists, F.coalesce("n.text", F.lit("")).alias("text"))


def tree_name(source_file: Column) -> Column:
    """A tree's file name without its ending: characters other than letters, digits, - _ . as _, 120 at most."""
    return F.substring(F.regexp_replace(source_file, r"[^\p{L}\p{N}\-_.]", "_"), 1, 120)


def candidate_files(outlines: DataFrame, queries: DataFrame, ranked: DataFrame | None = None, pinned: DataFrame | None = None, most: int = CANDIDATE_FILES) -> DataFrame:
    """(query_id, source_file, file_place): whose trees a query reasons over. Files pinned by the caller (query_id, source_file) win; else those that a search
    of summaries ranked (query_id, source_file, place), if they have trees; a query left without takes the first files with trees, so many at most."""
    known = outlines.select("source_file").distinct()
    chosen = None
    if pinned is not None:
        chosen = pinned.join(known, "source_file", "left_semi").select("query_id", "source_file", F.row_number().over(Window.partitionBy("query_id").orderBy("source_file")).alias("file_place")).distinct()
        queries = queries.join(pinned.select("query_id").distinct(), "query_id", "left_anti")
    if ranked is not None:
        found = ranked.join(queries.select("query_id"), "query_id", "left_semi").join(known, "source_file", "left_semi")
        placed = top(found.select("query_id", "source_file", F.col("place").alias("p")), most, [F.col("p"), F.col("source_file")]).select("query_id", "source_file", F.col("place").alias("file_place"))
        chosen = placed if chosen is None else chosen.unionByName(placed)
        queries = queries.join(placed.select("query_id").distinct(), "query_id", "left_anti")
    first = known.orderBy("source_file").limit(most).agg(F.sort_array(F.collect_list("source_file")).alias("f"))  # one row of so many names
    rest = queries.select("query_id").join(F.broadcast(first)).select("query_id", F.posexplode("f").alias("p", "source_file")).select("query_id", "source_file", (F.col("p") + 1).alias("file_place"))
    return rest if chosen is None else chosen.unionByName(rest)


def selection_prompt(query: Column, description: Column, sections: Column) -> Column:
    """What a model is asked that is to choose sections (an array of node_id, title, summary) of one file."""
    lines = F.array_join(F.transform(sections, lambda n: F.concat(F.lit("["), n["node_id"], F.lit("] "), F.trim(n["title"]), F.lit(" — "), F.trim(n["summary"]))), "\n")
    about = F.coalesce(F.nullif(description, F.lit("")), F.lit("(no description)"))
    return F.concat(
        F.lit("Choose the sections of a transcript that answer a question. Judge by relevance, not by shared words alone.\n\nTranscript: "), about, F.lit("\n\nSections:\n"), lines,
        F.lit("\n\nQuestion: "), query, F.lit('\n\nReply only with JSON {"node_ids": ["0001", ...]}, the most relevant first; {"node_ids": []} if none fits.'),
    )


def chosen_nodes(reply: Column, valid: Column) -> Column:
    """The node ids of a model's reply that a tree (an array of its ids) has, in its order, each once; none where the reply holds no such object."""
    ids = F.from_json(json_object(reply), "node_ids array<string>", {"mode": "PERMISSIVE"})["node_ids"]
    known = F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.trim(i)), lambda i: F.array_contains(valid, i))
    return F.array_distinct(known)


def select_nodes(files: DataFrame, outlines: DataFrame, queries: DataFrame, reasoner: Callable[[str], str] | None = None) -> DataFrame:
    """(query_id, source_file, node_id, file_place, node_place): nodes that a reasoner, given the prompt, lists for each candidate file; by default those that
    share words with the query, most first."""
    told = files.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    if reasoner is None:
        scored = told.join(outlines.select("source_file", "node_id", "title", "summary"), "source_file").withColumn("s", lexical_scorer(F.col("query"), F.concat_ws(" ", "title", "summary"))).where("s > 0")
        order = Window.partitionBy("query_id", "source_file").orderBy(F.desc("s"), "node_id")
        return scored.select("query_id", "source_file", "node_id", "file_place", F.row_number().over(order).alias("node_place"))
    trees = outlines.join(files.select("source_file").distinct(), "source_file", "left_semi").groupBy("source_file", "doc_description").agg(F.sort_array(F.collect_list(F.struct("node_id", "title", "summary"))).alias("sections"))
    asked = told.join(trees, "source_file").withColumn("reply", call(reasoner)(selection_prompt(F.col("query"), F.col("doc_description"), F.col("sections"))))
    ids = chosen_nodes(F.col("reply"), F.transform("sections", lambda s: s["node_id"]))
    return asked.select("query_id", "source_file", "file_place", F.posexplode(ids).alias("p", "node_id")).select("query_id", "source_file", "node_id", "file_place", (F.col("p") + 1).alias("node_place"))


def search(outlines: DataFrame, texts: DataFrame, queries: DataFrame, ranked: DataFrame | None = None, pinned: DataFrame | None = None, k: int = DEFAULT_K, files: int = CANDIDATE_FILES, reasoner: Callable[[str], str] | None = None, scorer: Callable[[Column, Column], Column] = lexical_scorer) -> DataFrame:
    """Results of a batch of queries (query_id, text), files first, then nodes of their trees, then the chosen nodes' texts: query_id, place, result_type,
    chunk_id (file#node), score, text, source_file, start_sec, end_sec, speakers, metadata. Nothing outside of the chosen nodes is scored; a query whose files
    offer nothing has no rows."""
    chosen = select_nodes(candidate_files(outlines, queries, ranked, pinned, files), outlines, queries, reasoner)
    pool = chosen.join(texts, ["source_file", "node_id"]).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    scored = pool.select("query_id", "source_file", "node_id", "text", "file_place", "node_place", F.round(scorer(F.col("query"), F.col("text")), 4).alias("score"))
    best = top(scored, k, [F.desc("score"), F.col("file_place"), F.col("node_place"), F.col("source_file"), F.col("node_id")])
    facts = outlines.select("source_file", "node_id", "title", "summary", "start_sec", "end_sec", "speakers")
    meta = F.create_map(F.lit("backend"), F.lit("sections"), F.lit("section_title"), F.col("title"), F.lit("section_summary"), F.col("summary"), F.lit("node_id"), F.col("node_id"))
    return best.join(facts, ["source_file", "node_id"]).select(
        "query_id", "place", F.lit("chunk").alias("result_type"), F.concat("source_file", F.lit("#"), "node_id").alias("chunk_id"), "score", "text", "source_file", "start_sec", "end_sec", "speakers", meta.alias("metadata")
    )

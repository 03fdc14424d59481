"""Shells around model calls: what goes in, how answers are read and checked, and deterministic defaults where there is no model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import dedupe, json_object, sentences

# The keys of a tag object, its closed vocabularies, and the caps of its lists.
TAG_SCHEMA = (
    "event_type string, primary_language string, topics array<string>, people_named array<string>, places_named array<string>, scriptures_referenced array<string>, "
    "timing_clues array<string>, location_clues array<string>, summary_hindi string, summary_english string"
)
EVENT_TYPES = ("satsang", "bhajan", "meditation", "qa", "discourse", "mixed", "unknown")
LANGUAGES = ("hindi", "sanskrit", "mixed")
CAPS = {"topics": 8, "people_named": 200, "places_named": 60, "scriptures_referenced": 60, "timing_clues": 6, "location_clues": 6}


def call(model: Callable[[str], str]) -> Callable[[Column], Column]:
    """A model as a column function, in Arrow batches."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else model(x)), "string")


def context_blocks(results: DataFrame) -> DataFrame:
    """One text a query: its results (query_id, place, source_file, text) as numbered blocks in order."""
    block = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] SOURCE: "), F.col("source_file"), F.lit("\nTEXT: "), F.col("text"))
    return results.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("context"))


def prompt(instruction: str, question: Column, context: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(instruction), F.concat(F.lit("CONTEXT:\n"), context), F.concat(F.lit("QUESTION: "), question))


def parsed_tags(text: Column) -> Column:
    """The tag object in a chatty answer, its lists deduped and capped; null where there is none."""
    o = F.from_json(json_object(text), TAG_SCHEMA)
    lists = {c: F.slice(dedupe(o[c]), 1, n) for c, n in CAPS.items()}
    keys = [k.split()[0] for k in TAG_SCHEMA.split(", ")]
    return F.when(o.isNotNull(), F.struct(*[(lists[k] if k in lists else o[k]).alias(k) for k in keys]))


def tag_errors(tags: Column) -> Column:
    """What is wrong with a tag object; an empty array for a good one."""
    checks = [F.when(tags.isNull(), "no object"), F.when(~tags["event_type"].isin(*EVENT_TYPES), "event_type"), F.when(~tags["primary_language"].isin(*LANGUAGES), "primary_language")]
    checks += [F.when(tags.isNotNull() & tags[k].isNull(), f"missing {k}") for k in (*CAPS, "event_type", "primary_language", "summary_hindi", "summary_english")]
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def merged_tags(parts: DataFrame, key: str) -> DataFrame:
    """Tags of a file's windows (key, idx, tags) as one: lists united in order and capped, scalars of the first window."""
    ordered = F.sort_array(F.collect_list(F.struct("idx", "tags")))
    g = parts.groupBy(key).agg(ordered.alias("p"))
    of = lambda c: F.flatten(F.transform("p", lambda s: s["tags"][c]))
    lists = [F.slice(dedupe(of(c)), 1, n).alias(c) for c, n in CAPS.items()]
    scalars = [F.element_at("p", 1)["tags"][c].alias(c) for c in ("event_type", "primary_language", "summary_hindi", "summary_english")]
    return g.select(key, *scalars, *lists)


def grounded(answer: Column, verdicts: Column) -> Column:
    """The sentences of an answer that are supported; all of them where verdicts are missing, too few, or reject everything."""
    s = sentences(answer)
    kept = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("x"), F.get(verdicts, i).alias("ok"))), lambda z: z["ok"])
    whole = verdicts.isNull() | (F.size(verdicts) != F.size(s)) | (F.size(kept) == 0)
    return F.when(whole, answer).otherwise(F.array_join(F.transform(kept, lambda z: z["x"]), " "))


def section_titles(sections: DataFrame, text: str = "text", model: Callable[[str], str] | None = None) -> DataFrame:
    """A title of each section by a model, by default its first 60 characters."""
    title = call(model)(F.col(text)) if model else F.trim(F.substring(text, 1, 60))
    return sections.withColumn("title", title)


def select_sections(sections: DataFrame, queries: DataFrame, chooser: Callable[[pd.Series, pd.Series], pd.Series] | None = None, k: int = 4) -> DataFrame:
    """Sections of candidate files that a chooser of (query, title and summary) scores highest; by default shared words."""
    from .ranking import lexical_scorer, top

    both = sections.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    seen = F.concat_ws(" ", "title", "summary")
    score = F.pandas_udf(chooser, "double")(F.col("query"), seen) if chooser else lexical_scorer(F.col("query"), seen)
    return top(both.withColumn("score", score), k, [F.desc("score"), F.col("source_file"), F.col("section")])

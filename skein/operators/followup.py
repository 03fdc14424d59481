"""Follow-up questions made to stand alone by a model that is shown the turns before; without one they stay as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .corpus import last_turns
from .models import call

#: Turns that are shown, and characters of an answer.
TURNS, ANSWER_CHARS = 3, 400


def rewrite_prompt(question: Column, context: Column) -> Column:
    """What a model is asked: the turns so far, the question, and one query in the same language that names what the question points at."""
    return F.concat(
        F.lit("Turns so far:\n"), F.coalesce(F.nullif(context, F.lit("")), F.lit("(none)")), F.lit("\n\nQuestion: "), question,
        F.lit("\n\nWrite the question as one search query that needs no turn before it, in the same language, with the person or topic by name. Reply with the query alone."),
    )


def standalone(queries: DataFrame, turns: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """queries (query_id, conversation_id, text) with `rewritten`: the model's reply without spaces and quotes around it, or the text itself where there is no
    model, no turn before, or nothing in the reply. turns: conversation_id, turn_index, role, text."""
    if model is None:
        return queries.withColumn("rewritten", F.col("text"))
    shown = last_turns(turns.join(queries.select("conversation_id").distinct(), "conversation_id", "left_semi").where(F.trim(F.coalesce("text", F.lit(""))) != ""), TURNS, ANSWER_CHARS)
    asked = queries.join(shown, "conversation_id", "left").withColumn("_p", F.when(F.col("context").isNotNull(), rewrite_prompt(F.col("text"), F.col("context"))))
    reply = F.regexp_replace(call(model)(F.col("_p")), r"(?U)^[\s\"']+|[\s\"']+$", "")
    return asked.withColumn("_r", reply).withColumn("rewritten", F.when(F.coalesce("_r", F.lit("")) != "", F.col("_r")).otherwise(F.col("text"))).select(*queries.columns, "rewritten")

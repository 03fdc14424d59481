"""Audits of chunks, arrays and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import dedupe, unique_ratio, words

#: Limits of a chunk in characters and tokens, and of a loop.
LONG_CHARS, LONG_TOKENS, LOOP_WORDS, LOOP_RATIO = 6000, 8192, 50, 0.15


def measured(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Each chunk's characters, words, distinct share, estimated tokens and the joined reasons why it is flagged ('' if it is not)."""
    w = F.size(words(F.col(text)))
    m = chunks.select("*", F.length(text).alias("chars"), w.alias("n_words"), F.round(unique_ratio(F.col(text)), 6).alias("ratio"), F.ceil(F.length(text) / 4).cast("long").alias("tokens"))
    loop, long_chars, long_tokens = (F.col("n_words") >= LOOP_WORDS) & (F.col("ratio") < LOOP_RATIO), F.col("chars") > LONG_CHARS, F.col("tokens") > LONG_TOKENS
    reasons = F.filter(F.array(F.when(loop, "loop"), F.when(long_chars, "over6kchar"), F.when(long_tokens, "over8192tok")), lambda r: r.isNotNull())
    return m.withColumn("reason", F.array_join(reasons, "+"))


def totals(m: DataFrame) -> DataFrame:
    has = lambda r: F.col("reason").contains(r)
    return m.agg(F.count("*").alias("n"), F.count_if(has("loop")).alias("loops"), F.count_if(has("over6k")).alias("over_char"), F.count_if(has("over8192")).alias("over_token"), F.count_if(has("loop") & has("over6k")).alias("loop_and_long"), F.count_if(~has("loop") & has("over6k")).alias("long_alone"), F.max("chars").alias("most_chars"), F.min(F.when(F.col("n_words") >= LOOP_WORDS, F.col("ratio"))).alias("least_ratio"))


def by_file(m: DataFrame, file: str) -> DataFrame:
    """Files with a flagged chunk, worst measures first."""
    g = m.groupBy(file).agg(F.max("chars").alias("most_chars"), F.max("tokens").alias("most_tokens"), F.min(F.when(F.col("n_words") >= LOOP_WORDS, F.col("ratio"))).alias("least_ratio"), F.count_if(F.col("reason") != "").alias("flagged"))
    return g.where("flagged > 0").orderBy(F.desc("most_chars"), file)


def array_dedupe_plan(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, before, after, values) of the arrays that a dedupe would shorten or change."""
    each = [df.select(key, F.lit(c).alias("field"), F.col(c).alias("old"), dedupe(F.col(c)).alias("values")) for c in columns]
    every = each[0]
    for e in each[1:]:
        every = every.unionByName(e)
    return every.where(~F.col("old").eqNullSafe(F.col("values")) & F.col("old").isNotNull()).select(key, "field", F.size("old").alias("before"), F.size("values").alias("after"), "values")


def dedupe_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("field").agg(F.count("*").alias("n_rows"), F.sum(F.col("before") - F.col("after")).alias("removed"))


def missing(expected: DataFrame, present: DataFrame, key: str, by: str) -> DataFrame:
    return expected.join(present.select(key).distinct(), key, "left_anti").groupBy(by).agg(F.count("*").alias("missing"))


def sampled_presence(expected: DataFrame, stores: dict[str, DataFrame], key: str, n: int) -> DataFrame:
    """Of n keys chosen by hash, how many each store has."""
    some = expected.select(key).distinct().orderBy(F.xxhash64(key), key).limit(n)
    out = some
    for name, store in stores.items():
        out = out.join(store.select(key).distinct().withColumn(name, F.lit(1)), key, "left")
    return out.agg(F.count("*").alias("n"), *[F.count(name).alias(name) for name in stores])


def sizes_compared(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Array sizes of two stores: same, stale (the copy is longer), under (shorter) or missing."""
    j = left.select(key, F.size(column).alias("a")).join(right.select(key, F.size(column).alias("b")), key, "left")
    return j.select(key, F.when(F.col("b").isNull(), "missing").when(F.col("b") > F.col("a"), "stale").when(F.col("b") < F.col("a"), "under").otherwise("same").alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def stale(outputs: DataFrame, inputs: DataFrame, seconds: float = 2.0) -> DataFrame:
    """Outputs (stem, mtime) older than their newest input (stem, mtime) by more than so many seconds, oldest first."""
    newest = inputs.groupBy("stem").agg(F.max("mtime").alias("input"))
    age = F.col("input").cast("double") - F.col("mtime").cast("double")
    return outputs.join(newest, "stem").where(age > seconds).select("stem", F.round(age / 3600, 6).alias("hours")).orderBy(F.desc("hours"), "stem")


def parity(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Keys without a file and files without a key, each with its side."""
    a, b = keys.select("key").distinct(), files.select("key").distinct()
    return a.join(b, "key", "left_anti").withColumn("side", F.lit("key_only")).unionByName(b.join(a, "key", "left_anti").withColumn("side", F.lit("file_only")))


def round_trip(df: DataFrame, key: str, stored: str, derived) -> DataFrame:
    """Rows whose stored struct differs from the one that their key gives."""
    return df.withColumn("_d", derived(F.col(key))).where(~F.col(stored).eqNullSafe(F.col("_d"))).select(key, stored, F.col("_d").alias("derived"))

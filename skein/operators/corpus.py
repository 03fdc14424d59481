"""Path hierarchies, corpus summaries, facets and threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import version_key
from .filters import under


def track_state(path: Column, chunks: Column, date: Column) -> Column:
    """A key without a folder is failed; with chunks and a date a track is remembered; else it is written."""
    return F.when(~path.contains("/"), "failed").when((chunks > 0) & date.isNotNull(), "remembered").otherwise("written")


def tree(rows: DataFrame, prefix: str = "", depth: int = 1) -> DataFrame:
    """Nodes at most `depth` levels below prefix, each file counted in all its folders down to that level.

    rows: source_file, n_chunks, duration_sec, session_date. A node is a leaf where nothing follows it in a key. Folders come first in `order`."""
    base = prefix if not prefix or prefix.endswith("/") else prefix + "/"
    inside = rows.where(under(F.col("source_file"), base)).withColumn("state", track_state(F.col("source_file"), F.col("n_chunks"), F.col("session_date")))
    parts = F.split(F.substring(F.col("source_file"), F.lit(len(base) + 1), F.length("source_file")), "/")
    each = inside.withColumn("parts", parts).withColumn("depth", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size("parts")))))
    node = each.select(
        F.concat(F.lit(base), F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")).alias("path"),
        F.element_at("parts", F.col("depth")).alias("name"), "depth", (F.col("depth") == F.size("parts")).alias("is_leaf"),
        "n_chunks", "duration_sec", "state", "session_date",
    )
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return node.groupBy("path", "name", "depth").agg(
        F.bool_and("is_leaf").alias("is_leaf"), F.count("*").alias("n_files"), F.sum("n_chunks").alias("n_chunks"), F.round(F.sum(F.coalesce("duration_sec", F.lit(0.0))), 1).alias("duration_sec"),
        count("remembered"), count("written"), count("failed"),
    )


def tree_order() -> list[str]:
    return ["depth", "is_leaf", "name"]


def majority_state(remembered: Column, written: Column, failed: Column) -> Column:
    """A folder's state: that of most of its tracks, the worse on a tie."""
    return F.when((failed >= remembered) & (failed >= written), "failed").when(written >= remembered, "written").otherwise("remembered")


def lit_ratio(remembered: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(remembered, total), F.lit(0.0))


def summary(rows: DataFrame) -> DataFrame:
    """One row of totals over the corpus."""
    s = rows.withColumn("state", track_state(F.col("source_file"), F.col("n_chunks"), F.col("session_date")))
    return s.agg(
        F.count("*").alias("n_files"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.round(F.coalesce(F.sum("duration_sec"), F.lit(0.0)), 1).alias("duration_sec"),
        *[F.count_if(F.col("state") == x).alias(x) for x in ("remembered", "written", "failed")], F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"),
    )


def version(rows: DataFrame, count: str, latest: str) -> DataFrame:
    """A key that moves when files, chunks or the last change do."""
    return rows.agg(version_key(F.count("*"), F.coalesce(F.sum(count), F.lit(0)), F.max(latest)).alias("version"))


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a scalar or array column, without nulls and blanks."""
    values = df.select(F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)).toDF("value")
    return values.where("value is not null and value <> ''").distinct().orderBy("value")


def visible(nodes: DataFrame, opened: DataFrame, levels: int) -> DataFrame:
    """Nodes whose folders are all open, level by level; roots always are."""
    shown = nodes.where("depth = 1")
    last = shown
    for d in range(2, levels + 1):
        parents = last.join(opened, "path", "left_semi").select(F.col("path").alias("parent"))
        own = nodes.where(F.col("depth") == d).withColumn("parent", F.expr("regexp_replace(path, '/[^/]*$', '')"))
        last = own.join(parents, "parent", "left_semi").select(*nodes.columns)
        shown = shown.unionByName(last)
    return shown


def nearest_ancestor(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each key (path) the deepest existing node above it."""
    parts = F.split("path", "/")
    up = keys.select(F.col("path").alias("key"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path"))
    return up.join(nodes.select("path", "depth"), "path").groupBy("key").agg(F.max_by("path", "depth").alias("parent"))


def threads(turns: DataFrame) -> DataFrame:
    """One row a thread: the first turn's title and mode, the last activity, the number of turns."""
    return turns.groupBy("conversation_id").agg(F.min_by("title", "turn_index").alias("title"), F.min_by("mode", "turn_index").alias("mode"), F.max("created_at").alias("last_at"), F.count("*").alias("n_turns"))


def last_turns(turns: DataFrame, n: int = 3, cut: int = 400) -> DataFrame:
    """The last n turns of each thread as one text in order, answers cut."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("turn_index"))
    few = turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    line = F.concat_ws(": ", "role", F.when(F.col("role") == "assistant", F.substring("text", 1, cut)).otherwise(F.col("text")))
    return few.groupBy("conversation_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_index", line.alias("line")))), lambda s: s["line"]), "\n").alias("context"))


def next_turn(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New turns (conversation_id, created_at, ...) numbered after each thread's last."""
    top = existing.groupBy("conversation_id").agg(F.max("turn_index").alias("_last"))
    n = F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at"))
    return new.join(top, "conversation_id", "left").withColumn("turn_index", F.coalesce(F.col("_last") + 1, F.lit(0)) + n - 1).drop("_last")


def failed_files(rows: DataFrame) -> DataFrame:
    """The files of a corpus that were read but failed, in order; a table, since there may be many."""
    return rows.where(track_state(F.col("source_file"), F.col("n_chunks"), F.col("session_date")) == "failed").select("source_file").orderBy("source_file")


def has(df: DataFrame, column: str, value: object) -> DataFrame:
    """One row: whether a row has this key. One match ends the scan of a task."""
    return df.where(F.col(column) == value).limit(1).agg((F.count("*") > 0).alias("found"))


def history(thread_rows: DataFrame, limit: int) -> DataFrame:
    """The latest threads, 1 to 500 of them, the most recent first."""
    return thread_rows.orderBy(F.desc("last_at"), "conversation_id").limit(max(1, min(limit, 500)))


def node_radius(n_chunks: Column, n_files: Column, is_root: Column) -> Column:
    """A node's radius on a map: its area in proportion to its chunks, else its files, to a limit."""
    size = F.when(n_chunks > 0, n_chunks).otherwise(n_files)
    return F.when(is_root, F.lit(14.0)).otherwise(F.least(F.lit(22.0), 2.2 + F.sqrt(size) * 0.7))


def duration_text(seconds: Column) -> Column:
    """Seconds below a minute, minutes below an hour, hours with a decimal below a hundred."""
    s, half_up = F.coalesce(seconds, F.lit(0.0)), lambda x: F.floor(x + 0.5).cast("string")
    hours = s / 3600
    return F.when(s < 60, F.concat(half_up(s), F.lit("s"))).when(s < 3600, F.concat(half_up(s / 60), F.lit(" min"))).when(hours < 100, F.concat(F.format_string("%.1f", hours), F.lit(" hours"))).otherwise(F.concat(F.format_number(F.floor(hours + 0.5), 0), F.lit(" hours")))

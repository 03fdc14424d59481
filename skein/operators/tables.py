"""Insert, upsert, delete, dedupe and reconciliation as joins and windows over whole tables; the caller writes the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def insert_absent(existing: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first write wins: rows of new whose key is not there yet, one a key."""
    one = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return existing.unionByName(one.join(existing.select(*key), key, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last write wins: rows of new replace those of their key; of several the last in order."""
    one = last_of(new, key, order)
    return existing.join(one.select(*key), key, "left_anti").unionByName(one)


def last_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    flipped = [F.struct(*order)]
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in flipped])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def delete(existing: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return existing.join(keys.select(*key).distinct(), key, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, on either side alone, and the share of the left side's that match."""
    a, b = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full_outer")
    n = lambda c: F.count_if(c)
    matched = n(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.agg(matched.alias("matched"), n(F.col("_b").isNull()).alias("left_only"), n(F.col("_a").isNull()).alias("right_only"), F.round(F.coalesce(F.try_divide(100 * matched, n(F.col("_a").isNotNull())), F.lit(0.0)), 2).alias("pct"))


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have one value only, with it."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def enrich_optional(left: DataFrame, right: DataFrame, keys: list[str], optional: str) -> DataFrame:
    """left joined to right on keys and on `optional`, where a null in right's `optional` binds nothing: two equi-joins, no nested loop."""
    exact = right.where(F.col(optional).isNotNull())
    free = right.where(F.col(optional).isNull()).drop(optional)
    return left.join(exact, [*keys, optional]).unionByName(left.join(free, keys), allowMissingColumns=True)


def collapse(df: DataFrame, key: str, pos: str, firsts: list[str], lists: list[str], first_known: list[str]) -> DataFrame:
    """One row a key: the head row's scalars, ordered distinct unions of array columns, and the first value that is neither null nor blank."""
    merged = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(pos, c))), lambda s: s[c]))).alias(c)
    known = lambda c: F.min_by(F.nullif(F.trim(F.col(c)), F.lit("")), F.when(F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull(), F.col(pos))).alias(c)
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.min_by(c, pos).alias(c) for c in firsts], *[merged(c) for c in lists], *[known(c) for c in first_known])


def changed(df: DataFrame, old_new: dict[str, Column]) -> DataFrame:
    """Rows in which a derived column differs from the stored one, nulls compared as values."""
    test = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(v) for c, v in old_new.items()])
    return df.where(test).select("*", *[v.alias(f"new_{c}") for c, v in old_new.items()])


def date_changes(df: DataFrame, old: str, new: Column, allow_loss: bool = False) -> DataFrame:
    """Counts of gained, lost and moved dates of a backfill; a loss is an error unless allowed."""
    counts = df.select(F.col(old).alias("o"), new.alias("n")).agg(F.count_if(F.expr("o is null and n is not null")).alias("gained"), F.count_if(F.expr("o is not null and n is null")).alias("lost"), F.count_if(F.expr("o <> n")).alias("moved"))
    if allow_loss:
        return counts
    return counts.withColumn("lost", F.when(F.col("lost") > 0, F.raise_error(F.lit("dates would be lost"))).otherwise(F.col("lost")).cast("long"))


def resume(work: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Work whose ledger entry is not 'ok'."""
    return work.join(ledger.where("status = 'ok'").select(key), key, "left_anti")


def ledger_counts(ledger: DataFrame, statuses: tuple[str, ...] = ("ok", "failed", "in_progress")) -> DataFrame:
    """Entries by status, those without any as 0."""
    fixed = ledger.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return fixed.join(ledger.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def attempt(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """The ledger (key, status, attempts, last_ts) after runs (key, status, ts): attempts add up, the last status holds."""
    last = runs.groupBy("key").agg(F.max_by("status", "ts").alias("_s"), F.count("*").alias("_k"), F.max("ts").alias("_t"))
    j = ledger.join(last, "key", "full_outer")
    return j.select("key", F.coalesce("_s", "status").alias("status"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("_k", F.lit(0))).alias("attempts"), F.coalesce("_t", "last_ts").alias("last_ts"))


def requeue(rejects: DataFrame, work: DataFrame, key: str) -> DataFrame:
    """Rejects go back to work, oversize ones excepted."""
    return work.unionByName(rejects.where("reason <> 'oversize'").select(*work.columns)).dropDuplicates([key])


def work_list(*sources: DataFrame, key: str = "source_file") -> DataFrame:
    """Keys of all sources in order, each once at its first place."""
    every = reduce(lambda a, b: a.unionByName(b), [s.select(key, "pos").withColumn("_s", F.lit(i)) for i, s in enumerate(sources)])
    return every.groupBy(key).agg(F.min(F.struct("_s", "pos")).alias("_p")).orderBy("_p").select(key)


def running(df: DataFrame, order: list[Column], size: Column) -> DataFrame:
    """df with _before and _row, the sum of sizes and the number of rows that stand before each row in a global order, and _rows, how many there are.

    Rows are dealt by ranges of the order; each range sums its own rows, and only the ranges' totals, one row each, meet in one task."""
    ranged = df.withColumn("_size", size).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part").orderBy(*order)
    own = ranged.withColumn("_row", F.row_number().over(within) - 1).withColumn("_before", F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    totals = own.groupBy("_part").agg(F.sum("_size").alias("_t"), F.count("*").alias("_c"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("_part", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"), F.sum("_c").over(every).alias("_rows"))
    joined = own.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, (F.col("_before") + F.col("_t0")).alias("_before"), (F.col("_row") + F.col("_c0")).alias("_row"), "_rows")


def slice_until(df: DataFrame, size: str, order: list[Column], target: int) -> DataFrame:
    """Rows in order until their sizes reach target, the row that crosses it included."""
    return running(df, order, F.col(size)).where(F.col("_before") < target).select(*df.columns)


def strided(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """n rows evenly spaced over an order."""
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.greatest(F.col("_rows") - 1, F.lit(0)) / max(n - 1, 1)))
    return running(df, order, F.lit(1)).where(F.array_contains(picks, F.col("_row").cast("long"))).select(*df.columns)

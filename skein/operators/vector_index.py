"""An index of vectors: inverted lists around centroids, vectors as bytes with a proven error, exact answers.

A unit vector v is kept as s * c, c whole numbers from -127 to 127, with the length e of what that leaves out, so that q.v lies within e of s * q.c for every
unit vector q. A list keeps the greatest distance r of its vectors from its centroid m, so that q.v is at most q.m + r. Searching reads bytes first: near lists for
a floor under the k-th best score, then every further list whose bound reaches the floor; vectors themselves are read only where
their bound does, and decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .fulltext import ranked
from .vectors import SCORES, best_of, cosine, list_matrix, query_blocks, query_matrix

#: Lists at most, vectors that centroids are fitted on at most, rounds of fitting, and lists that give the first floor.
LISTS, SAMPLE, ROUNDS, NEAR = 256, 20_000, 8, 4
#: Rounding that bounds allow for: of sums of products of unit vectors, and of scores to six places.
_SLACK = 1e-9 + 5e-7


def fit_centroids(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of at most so many lists, by Lloyd's rounds over a bounded sample: vectors with the smallest hashes of their ids."""
    table = vectors.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("query_id"), "vector").toArrow()
    x, _ = query_matrix(table)
    if not len(x):
        return np.zeros((0, 0))
    x = x / np.sqrt((x * x).sum(1))[:, None]
    centroids = x[np.linspace(0, len(x) - 1, min(lists, max(1, len(x) // 8))).astype(int)]
    for _ in range(rounds):
        near = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        norms = np.sqrt((sums * sums).sum(1))
        centroids = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], centroids)
    return centroids


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, scales and errors (rounded up) of unit vectors."""
    scale = np.maximum(np.abs(unit).max(1, initial=0), 1e-300) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    left = unit - code * scale[:, None]
    return code, scale, np.sqrt((left * left).sum(1)) * (1 + 1e-12) + 1e-15


def build(vectors: DataFrame, path: str, facets: tuple[str, ...] = (), lists: int = LISTS, sample: int = SAMPLE) -> None:
    """Write the index of vectors (id, vector and facets) to path: codes by list with their facets, exact vectors by list, and the lists' centroids and radii.

    Every row with a usable vector is indexed (not null, zero, not finite or of another length than the sample's longest); rows are not shuffled but to be
    written by list, and a large list is written in several files."""
    spark = vectors.sparkSession
    centroids = fit_centroids(vectors, lists, sample)
    size = centroids.shape[1]
    shared = spark.sparkContext.broadcast(centroids)
    keep = vectors.select("id", "vector", *facets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x, good = list_matrix(b.column("vector"), size)
            at = np.flatnonzero(good) if len(m) else np.empty(0, np.int64)
            unit = x[at] / np.sqrt((x[at] * x[at]).sum(1))[:, None]
            near = (unit @ m.T).argmax(1) if len(at) else np.empty(0, np.int64)
            code, scale, error = encode(unit)
            away = unit - m[near] if len(at) else unit
            own = b.take(pa.array(at))
            extra = [pa.array(near, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(error), pa.array(np.sqrt((away * away).sum(1)))]
            yield pa.RecordBatch.from_arrays([*own.columns, *extra], [*own.schema.names, "list", "code", "scale", "error", "away"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + ", list int, code binary, scale double, error double, away double"
    placed = keep.mapInArrow(run, schema)
    # a list is dealt to several tasks by id, so that no task writes a third of all rows
    dealt = placed.repartition(F.col("list"), F.pmod(F.xxhash64("id"), F.lit(16)))
    dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    spark.createDataFrame([(schema,)], "ddl string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    radii = _rows(spark, path).groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    facts = {r.list: (r.radius, r.n) for r in radii.collect()}  # one row a list
    rows = [(i, [float(v) for v in m], *map(float, facts[i][:1]), int(facts[i][1])) for i, m in enumerate(centroids) if i in facts]
    spark.createDataFrame(rows, "list int, centroid array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The indexed rows, none included."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").first().ddl).parquet(f"{path}/rows")


def _coded(rows: DataFrame, shared, k: int, upper: bool) -> DataFrame:
    """By list and in Arrow batches: with upper false, the k best lower bounds of a task for each query, as (query, bound); with upper true, all
    (query, id, list) whose upper bound reaches the query's floor. Only pairs of a query and a list that it asked for are computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, asked, floors = shared.value
        best = np.full(len(q), -np.inf)
        for b in batches:
            near = b.column("list").to_numpy(zero_copy_only=False)
            for n in np.unique(near).tolist():
                who = np.flatnonzero(asked[:, n])
                at = np.flatnonzero(near == n)
                step = max(1, SCORES // max(1, len(who)))
                for i in range(0, len(at) if len(who) else 0, step):
                    part = b.take(pa.array(at[i : i + step]))
                    code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(part.num_rows, -1)
                    scale, error = (part.column(c).to_numpy(zero_copy_only=False) for c in ("scale", "error"))
                    scores = (code @ q[who].T) * scale[:, None]
                    if upper:
                        rows_, cols = np.nonzero(scores + error[:, None] + _SLACK >= floors[who])
                        if len(rows_):
                            yield pa.RecordBatch.from_arrays([pa.array(who[cols], pa.int32()), part.column("id").take(pa.array(rows_)), part.column("list").take(pa.array(rows_))], ["query", "id", "list"])
                    else:
                        floor = best[who]
                        rows_, cols = best_of(scores - error[:, None] - _SLACK, pa.array(np.arange(part.num_rows)), floor, k)
                        best[who] = floor
                        if len(rows_):
                            low = scores[rows_, cols] - error[rows_] - _SLACK
                            yield pa.RecordBatch.from_arrays([pa.array(who[cols], pa.int32()), pa.array(low)], ["query", "bound"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "list", "code", "scale", "error").mapInArrow(run, f"query int, id {kind}, list int" if upper else "query int, bound double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 40, where=None, near: int = NEAR, report: dict | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k vectors of the index nearest to each query (query_id, vector) by cosine, exactly; where is a predicate on facets.

    The filter is tested on the rows' facets before anything is scored. Floors come from the lists nearest to a query; where these hold fewer
    than k rows that pass the filter, a query's floor is none and all lists are read, so that the answer never depends on the lists. To a dictionary given as
    report the shares of list reads and of exact vectors are added."""
    lists = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # LISTS rows at most
    rows = _rows(spark, path)
    rows = rows if where is None else rows.where(where)
    centroids, radii = np.array([r.centroid for r in lists]), np.array([r.radius for r in lists])
    names, sizes = np.array([r.list for r in lists]), np.array([r.n for r in lists])
    width = int(names.max(initial=0)) + 1
    parts = []
    for block in query_blocks(queries.select("query_id", "vector")) if lists else ():
        q, ids = query_matrix(block)
        if not len(q) or q.shape[1] != centroids.shape[1]:
            continue
        q = q / np.sqrt((q * q).sum(1))[:, None]
        to_lists = q @ centroids.T
        first = np.zeros((len(q), width), bool)
        order = np.argsort(-to_lists, axis=1)[:, :near]
        first[np.arange(len(q))[:, None], names[order]] = True
        floors = np.full(len(q), -np.inf)
        shared = spark.sparkContext.broadcast((q, first, floors))
        wanted = rows.where(F.col("list").isin(np.flatnonzero(first.any(0)).tolist()))
        bounds = _coded(wanted, shared, k, False)
        for r in _kth(bounds, k).collect():  # one row a query of the block
            floors[r.query] = r.bound
        reach = to_lists + radii + _SLACK >= floors[:, None]
        asked = np.zeros((len(q), width), bool)
        asked[:, names] = reach
        shared = spark.sparkContext.broadcast((q, asked, floors))
        hits = _coded(rows.where(F.col("list").isin(np.flatnonzero(asked.any(0)).tolist())), shared, k, True)
        named = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(ids)), pa.int32()), "query_id": ids, "q": pa.array(q.tolist())}))
        parts.append(hits.join(F.broadcast(named), "query").select("query_id", "q", "id", "list"))  # a block of queries at most
        if report is not None:
            for name, n in (("pairs", len(q) * int(sizes.sum())), ("first", int((first[:, names] * sizes).sum())), ("read", int((reach * sizes).sum()))):
                report[name] = report.get(name, 0) + n
    if not parts:
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
        return ranked(spark.createDataFrame([], kinds), k)
    found = reduce(DataFrame.unionByName, parts)
    if report is not None:
        report["exact"] = found.count()
    return _exact(found, rows.select("id", "list", "vector"), k)


def _kth(bounds: DataFrame, k: int) -> DataFrame:
    """(query, bound): the k-th greatest bound of each query; no row for a query with fewer."""
    w = Window.partitionBy("query").orderBy(F.desc("bound"))
    return bounds.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).groupBy("query").agg(F.min("bound").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")


def _exact(found: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact scores of what the bounds left; rows that repeat an id are scored one by one."""
    pairs = found.distinct().join(vectors, ["list", "id"])
    return ranked(pairs.select("query_id", "id", cosine(F.col("q"), F.col("vector")).alias("score")), k)

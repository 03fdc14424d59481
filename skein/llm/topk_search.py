"""Operator 1: exact top-k by inner product, aggregating sorted lists without random access.

A block of candidates has two sorted lists for each component, largest values first and smallest first; a query reads the one
its own component's sign asks for, entry after entry. After t entries of each list a value that was read is known, and one that was not lies
between the list's end and its t-th entry: that bounds every score from below and above. Candidates whose upper bound is below the k-th
lower bound are outsiders; so are those below the k-th score of the blocks before. Reading goes on, twice as deep each time and for the
others alone, until their bounds meet: then their scores are known. Bounds of many queries at once are matrix products with the values clamped
to what has been read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import tasks

#: Rows of a block of candidates and of queries.
BLOCK, QUERIES = 2048, 256
#: Queries whose best scores a task keeps from block to block, and a score below all.
_SEEN, _LOWEST = 200_000, np.iinfo(np.int64).min // 4


def _pack(group: pa.Table) -> pa.Table:
    ids, flat = group["id"].to_numpy(), group["v"].combine_chunks().flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    values = flat.reshape(len(ids), -1)[order]
    return pa.table({"dim": group["dim"][:1], "block": group["block"][:1], "ids": pa.array([ids[order].tobytes()], pa.binary()), "values": pa.array([values.tobytes()], pa.binary())})


def _blocks(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """One row a block of about so many vectors of one dimension."""
    count = max(1, -(-vectors.count() // rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(_pack, "dim int, block int, ids binary, values binary"), count


def search_block(queries: np.ndarray, own: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """For each query the (score, id) of its k best candidates, ties to the smaller id, and how many entries of each list it read. A
    candidate with the query's id, or with a score below the query's floor, is none."""
    n = len(ids)
    bound = float(np.abs(values).max(initial=0)) * float(np.abs(queries).max(initial=0)) * values.shape[1]
    kind = np.float64 if bound < 2**52 else np.int64  # exact either way
    v, q = values.astype(kind), queries.astype(kind)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    lists = np.sort(v, 0)  # each component's list: read from its end for plus, from its start for minus
    floors = np.full(len(q), _LOWEST) if floors is None else floors
    out: list[list[tuple[int, int]]] = [[] for _ in q]
    read = np.full(len(q), n)

    def bounds(rows: np.ndarray, x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        top, bottom = lists[n - depth], lists[depth - 1]
        low = plus[rows] @ np.where(x >= top, x, lists[0]).T + minus[rows] @ np.where(x <= bottom, x, lists[-1]).T
        return low, plus[rows] @ np.maximum(x, top).T + minus[rows] @ np.minimum(x, bottom).T

    def insiders(low: np.ndarray, high: np.ndarray, floor: float) -> np.ndarray:
        if len(low) > k:
            floor = max(floor, np.partition(low, len(low) - k)[len(low) - k])
        return high >= floor

    many, few, depth = np.arange(len(q)), {}, max(1, n // 16)
    while len(many) or few:
        low, high = bounds(many, v, depth) if len(many) else ((), ())
        left = []
        for i, lo, hi in zip(many.tolist(), low, high, strict=True):
            others = np.flatnonzero(ids != own[i])
            found = others[insiders(lo[others], hi[others], floors[i])]
            if len(found) <= max(8 * k, n // 8) or depth == n:
                few[i] = found
            else:
                left.append(i)
        many = np.array(left, np.int64)
        for i, found in list(few.items()):
            low, high = (x[0] for x in bounds(np.array([i]), v[found], depth))
            inside = insiders(low, high, floors[i])
            found, low, high = found[inside], low[inside], high[inside]
            few[i] = found
            if (low == high).all():
                best = np.lexsort((ids[found], -low))[:k]
                out[i], read[i] = [(int(low[j]), int(ids[found[j]])) for j in best], depth
                del few[i]
        depth = min(n, depth * 2)
    return out, read


def _search(k: int):
    """Rows come ordered by candidates' block, the block itself first, then the queries' blocks that are to search it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        seen: dict[tuple[int, int], list[int]] = {}  # the best scores of a bounded number of queries: they spare reading alone
        for b in batches:
            rows = []
            for dim, at, query, ids, values in zip(*(b.column(n).to_pylist() for n in ("dim", "block", "query", "ids", "values")), strict=True):
                own, matrix = np.frombuffer(ids, np.int64), np.frombuffer(values, np.int64).reshape(-1, dim)
                if not query:
                    block = (dim, at, matrix, own)
                elif block and block[:2] == (dim, at):
                    before = [seen.get((dim, q), ()) for q in own.tolist()]
                    floors = np.array([s[-1] if len(s) == k else _LOWEST for s in before])
                    for q, best, old in zip(own.tolist(), search_block(matrix, own, *block[2:], k, floors)[0], before, strict=True):
                        rows += [(q, i, s) for s, i in best]
                        if (dim, q) in seen or len(seen) < _SEEN:
                            seen[dim, q] = sorted([*old, *(s for s, _ in best)], reverse=True)[:k]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, factor: int = 256, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k candidates of the highest integer inner product for each vector whose id is divisible by `every`:
    (query_id, rank from 1, vec_id, score), ties to the smaller vec_id.

    Components are floor(factor * x), x as double. Candidates are all rows but those with the query's own id; only vectors of the same dimension
    are compared. Every block of queries meets every block of candidates once; each task holds one of either, and k rows a
    query and block are merged. Null ids and vectors, empty ones and those with null or non-finite components take no part.
    Repeated rows are candidates of their own; a repeated query id is searched once, by its first vector in order. No vectors give an empty result."""
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & ok)
    whole = clean.select("id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * float(factor)).cast("long")).alias("v"))
    asked = whole.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.dim", "x.v")
    candidates, count = _blocks(whole, block)
    queries, _ = _blocks(asked, QUERIES)
    sent = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("query", F.lit(True))
    rows = candidates.withColumn("query", F.lit(False)).unionByName(sent)
    ordered = rows.repartition(max(count, tasks(vectors.sparkSession)), "dim", "block").sortWithinPartitions("dim", "block", "query")
    found = ordered.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL with the same rows, for the table embeddings.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

"""Operator 12: exact Lloyd clustering, with Ptolemy's inequality over fixed pivot pairs to skip distances.

For four points of a Euclidean space d(x,c) * d(p,q) >= |d(x,p) * d(c,q) - d(x,q) * d(c,p)|. The distances d(x,p) of every vector to the pivots are computed
once and kept with it; those of the centroids are computed in every round. A centroid whose lower bound lies above the best
distance found so far cannot be the nearest; all others are compared exactly, in integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialise

#: Rows of a block of vectors, pivot pairs, and the vectors that pivots are chosen from.
BLOCK, PAIRS, SAMPLE = 4096, 8, 64
#: Relative slack of a bound: some hundred times the rounding error of its products, quotient and square roots.
_SLACK = 1e-13
#: Components below this size leave squared distances of up to 2^15 dimensions within a long; greater ones are computed with Python's integers.
_SMALL = 1 << 23


def _whole(flat: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x), x as double, as 64-bit integers or, where those may overflow, as Python's."""
    floors = np.floor(flat.astype(np.float64) * factor)
    return floors.astype(np.int64) if np.abs(floors).max(initial=0) < _SMALL else np.array([int(f) for f in floors.ravel()], object).reshape(floors.shape)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from the vector y."""
    if x.dtype != y.dtype:
        x, y = x.astype(object), y.astype(object)
    d = x - y
    return (d * d).sum(1)


def _roots(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p).astype(np.float64) for p in points], 1)) if len(points) else np.empty((len(x), 0))


def choose_pairs(points: np.ndarray, pairs: int) -> np.ndarray:
    """Pivots, two by two: from points, again and again the two that are farthest apart among those left."""
    left, out = list(range(len(points))), []
    apart = _roots(points, points)
    while len(left) > 1 and len(out) < 2 * pairs:
        part = apart[np.ix_(left, left)]
        i, j = np.unravel_index(part.argmax(), part.shape)
        if part[i, j] == 0:
            break
        out += [left[i], left[j]]
        left = [p for n, p in enumerate(left) if n not in (i, j)]
    return points[out]


def lower_bounds(cached: np.ndarray, of_centroids: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Bounds from below, rounded down, of the distances of vectors (rows of cached) from centroids, by the pivot pairs (0,1), (2,3), ..."""
    best = np.zeros((len(cached), len(of_centroids)))
    for i, d in enumerate(apart):
        one, two = cached[:, 2 * i, None] * of_centroids[None, :, 2 * i + 1], cached[:, 2 * i + 1, None] * of_centroids[None, :, 2 * i]
        np.maximum(best, (np.abs(one - two) - _SLACK * (one + two)) / d * (1 - _SLACK), out=best)
    return best


def assign(x: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row the nearest centroid (ties: the smaller number), the exact squared distance, and how many distances were computed for all."""
    apart = np.array([float(squared(pivots[i : i + 1], pivots[i + 1])[0]) ** 0.5 for i in range(0, len(pivots), 2)])
    low = lower_bounds(cached, _roots(centroids, pivots), apart)
    first = low.argmin(1)
    near, best = first.copy(), np.zeros(len(x), x.dtype if x.dtype == centroids.dtype else object)
    for c in range(len(centroids)):
        at = np.flatnonzero(first == c)
        best[at] = squared(x[at], centroids[c])
    computed = len(x)
    for c in range(len(centroids)):
        above = np.sqrt(best.astype(np.float64)) * (1 + _SLACK)
        at = np.flatnonzero((first != c) & (low[:, c] <= above))
        d = squared(x[at], centroids[c])
        computed += len(at)
        better = (d < best[at]) | ((d == best[at]) & (c < near[at]))
        near[at[better]], best[at[better]] = c, d[better]
    return near, best, computed


def _pack(factor: int, pivots: np.ndarray):
    """Blocks of vectors with their distances from the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = _whole(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), factor)
                small = x.dtype == np.int64
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([x.astype(np.int32).tobytes() if small else None], pa.binary()),
                        pa.array([None if small else [str(i) for i in x.ravel()]], pa.list_(pa.string())),
                        pa.array([_roots(x, pivots).tobytes()], pa.binary()),
                    ],
                    ["ids", "x", "large", "cached"],
                )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for ids, x, large, cached in zip(*(b.column(n).to_pylist() for n in ("ids", "x", "large", "cached")), strict=True):
            whole = np.frombuffer(x, np.int32).astype(np.int64) if x is not None else np.array([int(i) for i in large], object)
            yield ids, whole.reshape(len(ids), -1), np.frombuffer(cached).reshape(len(ids), -1)


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    """Of each cluster of a task one row: members, exact sums of components as text, distances computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        members, sums, done = np.zeros(k, np.int64), [[0] * dim for _ in range(k)], 0
        for _, x, cached in _blocks(batches):
            near, _, computed = assign(x, cached, centroids, pivots)
            done += computed
            for c in np.unique(near).tolist():
                own = x[near == c]
                members[c] += len(own)
                sums[c] = [a + int(s) for a, s in zip(sums[c], own.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array(members), pa.array([[str(s) for s in row] for row in sums], pa.list_(pa.string())), pa.array([done] + [0] * (k - 1), pa.int64())],
            ["cluster", "members", "sums", "computed"],
        )

    return run


def _final(centroids: np.ndarray, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, cached in _blocks(batches):
            near, best, _ = assign(x, cached, centroids, pivots)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.int32()), pa.array([int(d) for d in best], pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _step(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The next centroids; distances computed, and distances there are. Only one row a cluster and component reaches the driver."""
    parts = table.mapInArrow(_sums(centroids, pivots), "cluster int, members long, sums array<string>, computed long")
    entries = parts.select("cluster", "members", "computed", F.posexplode("sums").alias("at", "part"))
    first = F.col("at") == 0
    rows = entries.groupBy("cluster", "at").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum(F.when(first, F.col("members"))).alias("members"), F.sum(F.when(first, F.col("computed"))).alias("computed")
    ).collect()
    size = {r.cluster: r.members for r in rows if r.at == 0}
    out = centroids.astype(object)
    for r in rows:
        if size[r.cluster]:
            out[r.cluster, r.at] = int(r.total) // size[r.cluster]
    small = max((abs(v) for v in out.ravel()), default=0) < _SMALL
    return out.astype(np.int64) if small else out, sum(r.computed or 0 for r in rows), sum(size.values()) * len(centroids)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, factor: int = 1024, salt: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", report: list | None = None) -> DataFrame:
    """Lloyd's algorithm in exact integers: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row a vector.

    Components are floor(factor * x), x as double. Centroids start as the k vectors with the smallest sha256 of `salt:id`, in that
    order (ties, as of repeated ids: by components; a null id counts as no text). In each round every vector goes to its nearest
    centroid, ties to the smaller number, and every centroid with vectors becomes the exact floor of their mean. Vectors of another
    length than dim, null ones and those with null or non-finite components take no part. Repeated rows each count. With fewer than k
    vectors there are as many centroids; without vectors the result is empty. Distances and their sums must fit a long, else the job
    fails. Other columns are ignored. To a list given as report one (distances computed, distances there are) is added a round."""
    spark = vectors.sparkSession
    fits = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & fits)
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    lowest = kept.select("id", "v", name.alias("name")).orderBy("name", F.transform("v", lambda x: F.floor(x * float(factor)))).limit(max(k, SAMPLE)).collect()
    if not lowest:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    known = _whole(np.array([r.v for r in lowest]), factor)
    centroids, pivots = known[:k], choose_pairs(known, PAIRS)
    table = materialise(kept.mapInArrow(_pack(factor, pivots), "ids array<long>, x binary, large array<string>, cached binary"))
    for _ in range(rounds):
        centroids, *figures = _step(table, centroids, pivots)
        if report is not None:
            report.append(tuple(figures))
    assigned = materialise(table.mapInArrow(_final(centroids, pivots), "vec_id long, cluster int, distance long"))
    discard(table)
    own = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row a cluster
    facts = [(c, own[c], sum(own.values()), hashlib.sha256(",".join(str(int(v)) for v in centroids[c]).encode()).hexdigest()) for c in own]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, dim: int = 64, factor: int = 1024, salt: int = 3) -> str:
    """DuckDB SQL with the same rows, one pair of tables a round."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS e, row_number() OVER () AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS INTEGER) AS cluster, e FROM v QUALIFY cluster < {k}
)"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(e) AS e, min({{'d': d, 'c': cluster}}) AS best
  FROM (SELECT v.r, v.vec_id, v.e, c.cluster, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i} c) GROUP BY r
)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS MATERIALIZED (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS e
  FROM (SELECT best.c AS cluster, j, CAST(sum(e[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, {dim + 1}) t(j) GROUP BY ALL) GROUP BY cluster
), c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (cluster)
)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, a.best.c AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.best.c"""

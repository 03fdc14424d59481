"""Vectors: guard, cosine, exact nearest neighbours, mean pooling, and pluggable embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .fulltext import ranked


def is_good(vector: Column, size: int) -> Column:
    """Finite and of the right size; null is not."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(dot(a, b), norm(a) * norm(b)), 6)


#: Queries whose vectors every task holds at once, and scores computed at a time.
QUERY_BLOCK, SCORES = 4096, 1 << 21
#: Words whose places an embedder keeps at hand.
KNOWN_WORDS = 1 << 16


def query_blocks(queries: DataFrame) -> list[pa.Table]:
    """The queries (query_id, vector, ...) in blocks of about QUERY_BLOCK rows: what is sent to all tasks is bounded, whatever their number."""
    head = queries.limit(QUERY_BLOCK + 1).toArrow()
    if head.num_rows <= QUERY_BLOCK:
        return [head]
    parts = -(-queries.count() // QUERY_BLOCK)
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toArrow() for i in range(parts)]


def list_matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow column as rows of so many numbers, and which give one: a vector that is null, of another length, zero or not finite gives none."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    fits = lengths == size
    if fits.any() and not column.flatten().null_count:
        own = column if fits.all() else column.filter(pa.array(fits))
        flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    else:
        rows = [v if f and all(x is not None for x in v) else [np.nan] * size for v, f in zip(column.to_pylist(), fits.tolist(), strict=True)]
        flat, fits = np.array(rows, np.float64).reshape(len(rows), size), np.ones(len(rows), bool)
    out = np.zeros((len(column), size))
    out[fits] = flat
    norms = np.sqrt((out * out).sum(1))
    return out, np.isfinite(norms) & (norms > 0)


def best_of(scores: np.ndarray, ids: pa.Array, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, query) that may be among the k best of a query, given the k-th best score seen before; floor is raised in place.

    Of equal scores those with the smallest ids are kept, so that a query never has more than k rows of a block."""
    n = len(scores)
    if n > k:
        np.maximum(floor, np.partition(scores, n - k, axis=0)[n - k], out=floor)
    rows, cols = np.nonzero((scores >= floor) & np.isfinite(scores))
    if len(cols) and np.bincount(cols).max() > k:
        by_id = np.empty(n, np.int64)
        by_id[pc.sort_indices(ids).to_numpy()] = np.arange(n)
        order = np.lexsort((by_id[rows], -scores[rows, cols], cols))
        rows, cols = rows[order], cols[order]
        place = np.arange(len(cols)) - np.searchsorted(cols, cols)
        rows, cols = rows[place < k], cols[place < k]
    return rows, cols


def query_matrix(block: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """The block's usable vectors, all of its longest one's length, and their query ids."""
    column = block["vector"].combine_chunks()
    size = pc.max(pc.list_value_length(column)).as_py() or 0
    q, good = list_matrix(column, size)
    return q[good], block["query_id"].combine_chunks().filter(pa.array(good))


#: The score, below any cosine, of a vector that gives none.
UNSCORED = -2.0


def scan(vectors: DataFrame, block: pa.Table, k: int, measure: str, by: str | None = None) -> DataFrame:
    """(query_id, id, score): of each task the rows that may be among the k best of the block's queries. With `by` a query meets the vectors alone whose
    value of that column is in its list `within`; those that give no score are then UNSCORED."""
    q, names = query_matrix(block)
    if not len(q):
        vectors = vectors.where(F.lit(False))
    if measure == "cosine":
        q = q / np.sqrt((q * q).sum(1))[:, None] if len(q) else q
    groups, member = pa.array([], pa.string()), None
    if by:
        own = dict(zip(block["query_id"].to_pylist(), block["within"].to_pylist(), strict=True))
        groups = pa.array(sorted({g for x in own.values() for g in x or () if g is not None}), block["within"].type.value_type)
        at = {g: i for i, g in enumerate(groups.to_pylist())}
        member = np.zeros((len(groups) + 1, len(names)), bool)  # the last row is that of other groups
        for j, name in enumerate(names.to_pylist()):
            member[[at[g] for g in own[name] or () if g is not None], j] = True
    shared = vectors.sparkSession.sparkContext.broadcast((q, names, groups, member))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names, groups, member = shared.value
        floor = np.full(len(q), -np.inf)
        step = max(1, SCORES // max(1, len(q)))
        for b in batches:
            for at in range(0, b.num_rows if len(q) else 0, step):
                part = b.slice(at, step)
                x, good = list_matrix(part.column("vector"), q.shape[1])
                scores = x @ q.T
                if measure == "cosine":
                    with np.errstate(divide="ignore", invalid="ignore"):
                        scores /= np.sqrt((x * x).sum(1))[:, None]
                scores = np.round(scores, 6) + 0.0
                scores[~good] = -np.inf if member is None else UNSCORED
                if member is not None:
                    group = np.asarray(pc.index_in(part.column(by), groups).fill_null(len(groups)))
                    scores[~member[group]] = -np.inf
                rows, cols = best_of(scores, part.column("id"), floor, k)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(cols)), part.column("id").take(pa.array(rows)), pa.array(scores[rows, cols])], ["query_id", "id", "score"])

    return vectors.select("id", "vector", *([by] if by else [])).mapInArrow(run, f"query_id {from_arrow_type(names.type).simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 40, measure: str = "cosine") -> DataFrame:
    """(query_id, id, score, rank) of the k vectors (id, vector) nearest to each query (query_id, vector), exactly, by cosine or by inner product ('dot').

    The vectors stay where they are: a block of queries is sent to all tasks, which multiply their vectors by it in Arrow batches and keep k rows a query;
    more queries than a block go in several passes. A vector that is null, zero, not finite or of another length has no score and is not found."""
    parts = [scan(vectors, block, k, measure) for block in query_blocks(queries.select("query_id", "vector"))]
    return ranked(reduce(DataFrame.unionByName, parts), k)


def nearest_within(queries: DataFrame, vectors: DataFrame, by: str, k: int = 40) -> DataFrame:
    """(query_id, id, score, rank) of the k vectors (id, vector, by) nearest by cosine to each query (query_id, vector, within), of those whose `by` is in the
    query's array `within`. As nearest(), but that vectors without a score come last, with null, rather than not at all."""
    parts = [scan(vectors, block, k, "cosine", by) for block in query_blocks(queries.select("query_id", "vector", "within"))]
    return ranked(reduce(DataFrame.unionByName, parts), k).withColumn("score", F.nullif("score", F.lit(UNSCORED)))


def mean_pool(df: DataFrame, by: str, vector: str) -> DataFrame:
    """The element-wise mean of each group's vectors."""
    each = df.select(by, F.posexplode(vector).alias("pos", "x"))
    means = each.groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


def blend(a: Column, b: Column) -> Column:
    """The mean of two vectors; the first alone where the second is null."""
    return F.coalesce(F.zip_with(a, b, lambda x, y: (x + y) / 2), a)


def hashing_embedder(size: int = 64) -> Callable[[pd.Series], pd.Series]:
    """The default embedder: words hashed to signed places, normalised. It stands in for a model, which may be passed instead."""

    def embed(texts: pd.Series) -> pd.Series:
        import re
        import zlib

        class Places(dict):
            """Where a word falls: its place, or size places further on for a negative sign."""

            def __missing__(self, word: str) -> int:
                if len(self) >= KNOWN_WORDS:
                    self.clear()
                h = zlib.crc32(word.encode())
                self[word] = place = h % size + (0 if h >> 31 else size)
                return place

        out, places = [], Places()
        for t in texts.fillna(""):
            hits = np.bincount([places[w] for w in re.findall(r"\w+", t.lower())], minlength=2 * size) if t else np.zeros(2 * size)
            v = (hits[:size] - hits[size:]).astype(np.float64)
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


def embedded(df: DataFrame, text: str = "text", embedder: Callable[[pd.Series], pd.Series] | None = None, to: str = "vector") -> DataFrame:
    """df with a vector a row, made in Arrow batches by any function from a series of texts to a series of vectors of equal number."""
    model = embedder or hashing_embedder()

    def checked(texts: pd.Series) -> pd.Series:
        vectors = model(texts)
        if len(vectors) != len(texts):
            raise ValueError(f"the embedder returned {len(vectors)} vectors for {len(texts)} texts")
        return vectors

    return df.withColumn(to, F.pandas_udf(checked, "array<double>")(F.col(text)))

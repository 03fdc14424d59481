"""Operator 13: whitening of embeddings by the singular values of the centred rows.

Every block of centred rows is reduced to a triangle by QR, and triangles by QR of their stack, so that rows are never multiplied with each other
and no accuracy is lost to squares. Householder reflections make the last triangle bidiagonal; the qd algorithm with shifts (dqds)
finds its singular values to high relative accuracy, and twisted factorisations their vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialise

#: Rows that one QR takes; triangles that one task stacks at once.
_ROWS, _FAN = 4096, 32
_EPS = np.finfo(np.float64).eps


# --- the small problem: singular values and right vectors of a triangle ---


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections from both sides: diagonal a, superdiagonal b, and v with r = u * bidiagonal * v'."""
    m = np.array(r, np.float64)
    n = m.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or len(x) < 2:
            return None
        h = x / size
        h[0] += 1 if h[0] >= 0 else -1
        return h / np.linalg.norm(h)

    for i in range(n):
        if (h := reflector(m[i:, i])) is not None:
            m[i:, i:] -= 2 * np.outer(h, h @ m[i:, i:])
        if i < n - 1 and (h := reflector(m[i, i + 1 :])) is not None:
            m[i:, i + 1 :] -= 2 * np.outer(m[i:, i + 1 :] @ h, h)
            v[:, i + 1 :] -= 2 * np.outer(v[:, i + 1 :] @ h, h)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal, falling. Without subtractions but for the shift, each keeps its relative accuracy.

    Shifts are bounds of the least value from below; should rounding make a pivot negative, a smaller one is tried, at last none. Blocks are split where the
    superdiagonal vanishes, and turned round where their small end stands first."""
    found: list[float] = []
    top = max(float(np.max(x, initial=0)) for x in (a * a, b * b))
    nothing = 1e-3 * (len(a) * _EPS) ** 2 * top  # couplings that leave values above rounding as they are
    blocks = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while blocks:
        q, e, base = blocks.pop()
        shift, calls = 0.0, 0
        while q:
            n = len(q)
            if n == 1:
                found.append(q.pop() + base)
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= 64 * _EPS * _EPS * (q[i] + q[i + 1]) or e[i] * (e[i] + q[i] + q[i + 1]) <= max(_EPS * 0.1 * base, nothing) ** 2), None)
            if cut is not None:
                if cut == n - 2:
                    found.append(q.pop() + base)
                    e.pop()
                    shift, calls = 0.0, 0
                    continue
                blocks.append((q[: cut + 1], e[:cut], base))
                q, e, shift, calls = q[cut + 1 :], e[cut + 1 :], 0.0, 0
                continue
            if 1.5 * q[0] < q[-1]:
                q.reverse()
                e.reverse()
            calls += 1
            if calls > 200 * n:
                raise ArithmeticError("dqds did not converge")
            while True:
                new_q, new_e, pivots = [], [], [q[0] - shift]
                for i in range(n - 1):
                    new_q.append(pivots[i] + e[i])
                    ratio = q[i + 1] / new_q[i] if new_q[i] > 0 else 0.0
                    new_e.append(e[i] * ratio)
                    pivots.append(pivots[i] * ratio - shift)
                if min(pivots) >= 0 or shift == 0.0:
                    break
                shift = shift / 2 if shift > _EPS * q[0] else 0.0
            new_q.append(max(pivots[-1], 0.0))
            q, e, base = new_q, new_e, base + shift
            # the pivots' reciprocals are the diagonal of the inverse, and its trace bounds the least value from below
            shift = 1 / sum(1 / p for p in pivots) * (1 - 1e-10) if min(pivots) > 1e-290 else 0.0
    return np.array(sorted(found, reverse=True))


def twisted(a: np.ndarray, b: np.ndarray, value: float, skip: int = 0) -> np.ndarray:
    """The unit eigenvector of the square of a bidiagonal for a squared singular value, by the twisted factorisation with the smallest
    twist (or with one of the next)."""
    d, low = a * a, b / a[:-1]
    n = len(a)
    tiny = max(value, float(d.max())) * _EPS * _EPS
    s, p = np.zeros(n), np.zeros(n)
    down, up = np.zeros(n - 1), np.zeros(n - 1)
    s[0] = -value
    for i in range(n - 1):
        pivot = d[i] + s[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        t = d[i] / pivot
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    at = int(np.argsort(np.abs(s + p + value), kind="stable")[skip])
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest squared singular values of a triangle, their right vectors as columns, and the sum of all squares.

    Only values above rounding are returned. Vectors of values closer than a thousandth are made orthogonal to those before; where one
    vanishes by that, it is taken from the next twist."""
    n = r.shape[1]
    size = float(np.abs(r).max(initial=0))
    if n == 0 or size == 0:
        return np.empty(0), np.empty((n, 0)), 0.0
    a, b, v = bidiagonalise(np.concatenate((r, np.zeros((max(0, n - len(r)), n)))) / size)
    least = _EPS * _EPS * max(np.abs(a).max(), np.abs(b).max(initial=0))
    a = np.where(np.abs(a) > least, a, least)
    values = dqds(a, b)
    total = float((np.append(a, b) ** 2).sum())
    values = values[: min(count, n)]
    values = values[values > values[0] * (n * _EPS) ** 2 * 16]
    cuts = np.flatnonzero(np.abs(b) <= _EPS * 1e-3 * np.sqrt(values[0]))  # blocks that do not touch: a vector lives in one
    blocks = np.split(np.arange(n), cuts + 1)
    own: list[np.ndarray] = []
    taken: list[float] = []
    pool = [(value, block) for block in blocks for value in dqds(a[block], b[block[:-1]])]
    pool.sort(key=lambda x: -x[0])
    for value, block in pool[: len(values)]:
        for skip in range(len(block)):
            z = np.zeros(n)
            z[block] = twisted(a[block], b[block[:-1]], value, skip) if len(block) > 1 else 1.0
            for _ in range(2):
                for other, w in zip(taken, own, strict=True):
                    if other - value <= 1e-3 * other:
                        z = z - (z @ w) * w
            length = np.linalg.norm(z)
            if length > 1e-3:
                break
        taken.append(value)
        own.append(z / length)
    return np.array(taken) * size**2, v @ np.stack(own, 1), total * size**2


# --- the rows ---


def _qr(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _triangle_row(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])


def _reduce(shift: np.ndarray, n: int, turn: np.ndarray | None = None):
    """The triangle of a task's rows, centred by sums shift over n; with turn, of their projections on its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                x = _centred(_matrix(b.column("x").slice(at, _ROWS)), shift, n)
                x = x if turn is None else x @ turn
                r = _qr(x if r is None else np.concatenate((r, x)))
        yield from _triangle_row(r)

    return run


def _stack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for part in b.column("r").to_pylist():
                one = np.frombuffer(part).reshape(-1, dim)
                r = one if r is None else _qr(np.concatenate((r, one)))
        yield from _triangle_row(r)

    return run


def _last_triangle(parts: DataFrame, dim: int) -> np.ndarray:
    """QR of QRs, a few at a time, until so few are left that the driver stacks them."""
    table = materialise(parts)
    while (left := table.count()) > _FAN:
        before, table = table, materialise(table.repartition(-(-left // _FAN)).mapInArrow(_stack(dim), "r binary"))
        discard(before)
    found = sorted((r.r for r in table.collect()), key=bytes)
    discard(table)
    return _qr(np.concatenate([np.frombuffer(r).reshape(-1, dim) for r in found])) if found else np.zeros((0, dim))


def _centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - sums / n, the difference taken exactly before the division."""
    base = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([(int(s) % n) / n for s in sums])
    return (x - base).astype(np.float64) - rest


def _whitened(sums: np.ndarray, n: int, turn: np.ndarray, shares: np.ndarray, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = turn.shape[1]
        for b in batches:
            x = _matrix(b.column("x"))
            top = int(np.abs(x).max(initial=0))
            if n * 2 * top < 1 << 26:
                deviation = ((n * x - sums.astype(np.int64)) ** 2).sum(1).tolist()
            else:
                deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, n), pa.int64()),
                    pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                    pa.array((_centred(x, sums, n) @ turn).ravel()),
                    pa.array(np.tile(shares, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, factor: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates: (vec_id, component from 1, n, deviation, whitened, explained, identity_error), one row a vector and component.

    Entries are x = floor(factor * c) + offset, c as double. Each distinct x vector stands once in the fit list; n is its length and S its
    sums. Components are unit eigenvectors of the list's covariance (divisor n) by falling eigenvalue e, either sign; whitened is (x - S/n)
    projected on one, over sqrt(e); explained is e over the trace; deviation is the exact sum of (n * x - S)^2, which must fit a long,
    else the job fails; identity_error is the largest entry of the list's whitened covariance minus the identity, measured on all of it.
    Null vectors, empty ones and those with null or non-finite entries are dropped. Where lengths differ, the vectors of the
    commonest length (ties: the longer) take part. Components of no variance beyond rounding are not returned, so a list of one vector, like an
    empty table, gives an empty result. Repeated rows and null ids keep their rows. Other columns are ignored."""
    spark = vectors.sparkSession
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(whole)
    lengths = kept.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], _SCHEMA)
    dim = lengths[0].dim
    rows = kept.where(F.size("v") == dim).select("vec_id", F.transform("v", lambda c: F.floor(c * float(factor)).cast("long") + F.lit(offset).cast("long")).alias("x"))
    fit = materialise(rows.select("x").distinct())
    totals = fit.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    n = totals[0].n
    sums = np.array([int(r.s) for r in sorted(totals, key=lambda r: r.at)], object)
    values, vectors_, total = directions(_last_triangle(fit.mapInArrow(_reduce(sums, n), "r binary"), dim), components)
    if not len(values):
        discard(fit)
        return spark.createDataFrame([], _SCHEMA)
    turn = vectors_ / np.sqrt(values / n)
    check = _last_triangle(fit.mapInArrow(_reduce(sums, n, turn), "r binary"), len(values))  # its square is n times the covariance
    error = float(np.abs(check.T @ check / n - np.eye(len(values))).max())
    discard(fit)
    return rows.mapInArrow(_whitened(sums, n, turn, values / total, error), _SCHEMA)

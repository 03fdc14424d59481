import hashlib

import numpy as np
import pytest

pytest.importorskip("skein.llm.centroids")

from skein.llm.centroids import assign, choose_pairs, cluster, lower_bounds, squared, _roots  # noqa: E402
from skein.llm.whitening import directions, dqds, whiten  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string"


def vectors(n=300, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    near = rng.normal(0, 1, (5, dim))
    return [(i, [float(c) for c in np.float32(near[i % 5] + rng.normal(0, 0.2, dim))], 1, "x") for i in range(n)]


def odd(dim=64):
    some = [0.25] * dim
    return [(900, None, 1, "x"), (901, [], 1, "x"), (902, [float("nan"), *some[1:]], 1, "x"), (903, [None, *some[1:]], 1, None), (904, [float("inf"), *some[1:]], 1, "x"), (905, [1.0, 2.0], 1, "x")]


def plain_lloyd(rows, k=8, rounds=10, dim=64):
    kept = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, own in groups.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    total = {j: sum(d for _, c, d in out if c == j) for _, j, _ in out}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, total[c], sum(total.values()), names[c]) for i, c, d in out), key=str)


def test_clusters_are_those_of_plain_lloyd(spark):
    rows = vectors() + odd() + [(None, vectors(1)[0][1], 1, "x"), (7, vectors(8)[7][1], 2, "y"), (7, vectors(9)[8][1], 2, "y")]
    report = []
    got = cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), report=report)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lloyd(rows)
    assert len(report) == 10 and all(0 < done < whole for done, whole in report)  # bounds spare distances here


def test_large_components_few_vectors_and_none(spark):
    rows = [(i, [c * 1e5 for c in v], 1, "x") for i, v, *_ in vectors(5)]
    assert sorted((tuple(r) for r in cluster(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain_lloyd(rows)
    same = [(i, [0.5] * 64, 1, "x") for i in range(12)]
    assert sorted((tuple(r) for r in cluster(spark.createDataFrame(same, SCHEMA)).collect()), key=str) == plain_lloyd(same)
    assert cluster(spark.createDataFrame(odd(), SCHEMA)).count() == 0
    assert cluster(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("scale", [1, 40, 100_000])
def test_bounds_never_exceed_distances(scale):
    rng = np.random.default_rng(scale)
    x = rng.integers(-scale, scale + 1, (400, 8))
    pivots = choose_pairs(x[:20], 4)
    apart = np.array([float(squared(pivots[i : i + 1], pivots[i + 1])[0]) ** 0.5 for i in range(0, len(pivots), 2)])
    centroids = x[rng.integers(0, 400, 6)]
    assert (lower_bounds(_roots(x, pivots), _roots(centroids, pivots), apart) <= _roots(x, centroids)).all()
    near, best, _ = assign(x, _roots(x, pivots), centroids, pivots)
    every = np.stack([squared(x, c) for c in centroids], 1)
    assert (near == every.argmin(1)).all() and (best == every.min(1)).all()


def test_triangles_of_all_kinds():
    rng = np.random.default_rng(8)
    kinds = [rng.normal(size=(90, 20)), rng.normal(size=(90, 20)) * np.logspace(0, -9, 20), rng.normal(size=(6, 20)), np.concatenate((np.eye(20), -np.eye(20))), np.repeat(rng.normal(size=(90, 6)), 3, axis=1), rng.normal(size=(30, 1)), rng.integers(-2, 3, (80, 20)).astype(float)]
    for x in kinds:
        x = x - x.mean(0)
        true = np.linalg.svd(x, compute_uv=False) ** 2
        values, v, total = directions(np.linalg.qr(x, mode="r"), 16)
        assert np.allclose(values, true[: len(values)], rtol=1e-12) and abs(total / true.sum() - 1) < 1e-12
        assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-11
        assert np.abs((x @ v).T @ (x @ v) / values[:, None] ** 0.5 / values**0.5 - np.eye(len(values))).max() < 1e-9
        assert len(values) == min(16, int((true > true[0] * 1e-20).sum()))
    a, b = np.abs(rng.normal(size=40)) + 0.1, rng.normal(size=39)
    assert np.allclose(dqds(a, b), np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2, rtol=1e-12)


def plain_whitening(rows, k=16):
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v, *_ in rows]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for _, v in kept]
    white = (np.array([v for _, v in kept], float) - mean) @ vectors_[:, :k] / np.sqrt(values[:k])
    return n, deviations, white, values / values.sum()


def test_whitening_is_that_of_the_covariance(spark):
    rows = vectors() + [(None, vectors(1)[0][1], 1, "x"), (907, vectors(8)[7][1], 2, "y")]
    got = whiten(spark.createDataFrame(rows + odd(), SCHEMA).repartition(5)).orderBy("deviation", "vec_id", "component").collect()
    n, deviations, white, shares = plain_whitening(rows)
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    order = sorted(range(len(rows)), key=lambda i: (deviations[i], rows[i][0] is not None, rows[i][0] or 0))
    table = np.array([r.whitened for r in got]).reshape(-1, 16)
    signs = np.sign((table * white[order]).sum(0))
    assert np.allclose(table, white[order] * signs, atol=1e-7)
    assert [r.deviation for r in got[::16]] == [deviations[i] for i in order] and [r.vec_id for r in got[::16]] == [rows[i][0] for i in order]
    assert np.allclose([r.explained for r in got[:16]], shares[:16], rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_whitening_of_little(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame(odd()[:5], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(i, [1.0, 2.0], 1, "x") for i in range(4)], SCHEMA)).count() == 0  # no variance
    flat = whiten(spark.createDataFrame([(i, [float(i % 3), 5.0, float(i % 3)], 1, "x") for i in range(9)] + odd()[:5], SCHEMA)).collect()
    assert {r.component for r in flat} == {1} and {r.n for r in flat} == {3} and abs(flat[0].explained - 1) < 1e-12 and len(flat) == 9

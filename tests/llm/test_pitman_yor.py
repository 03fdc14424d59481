import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("skein.llm.pitman_yor")

from skein.llm import pitman_yor as hpy  # noqa: E402

SCHEMA = "doc_id long, text string, score double, kind int"


def documents(n=120):
    rng = np.random.default_rng(5)
    words = ["der", "die", "Haus", "the", "of", "ab", "x1", "Ünder", "grün", "end."] + [f"w{i}" for i in range(60)]
    out = [(i, " ".join(rng.choice(words[: 10 + i % 60], rng.integers(0, 60))), 0.5, i) for i in range(n)]
    out += [(None, "the of the", None, 1), (3, out[3][1], 0.1, None), (6, "twice\t the same\n", 1.0, 1), (6, "twice\t the same\n", 1.0, 1), (7, None, None, None), (8, "", 0.0, 1), (1000, "the of " * 4000, 0.0, 1)]
    return out + [(i, "new words only here: " + "zz" * (i - 1000), 0.0, 1) for i in range(1001, 1020)]


def plain(rows, rounds=hpy.ROUNDS, burn_in=hpy.BURN_IN, strength=hpy.STRENGTH):
    """The same sampler with dictionaries; only the draws of single numbers are the operator's."""
    docs = []
    for i, text, *_ in rows:
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        docs.append((i, held, [*re.findall(r"[^\x20\x09-\x0D]+", low), None]))
    import pyarrow as pa

    names = sorted({w for _, _, ws in docs for w in ws if w is not None})
    hashes = dict(zip(names, hpy.word_hashes(*hpy.text_buffer(pa.array(names)))[0], strict=True)) | {None: hpy._END}
    pairs = Counter((u, w) for _, held, ws in docs if not held for u, w in zip([None, *ws[:-1]], ws, strict=True))
    count, customers = Counter(), Counter()
    for (u, w), c in pairs.items():
        count[w] += c
        customers[u] += c
    def bounded(values):
        one, two = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return round(min(0.95, max(0.1, one / (one + 2 * two) if one else 0.5)), 6)

    tables = {p: 1 for p in pairs}

    def sums(at):
        out = Counter()
        for p, t in tables.items():
            out[p[at]] += t
        return out

    low, high, v = bounded(pairs.values()), bounded(sums(1).values()), len(count)
    one = lambda x: np.array([x])
    samples, parent_tables = [], float(v)
    for turn in range(rounds + 1):
        salt, below = 100 * (turn + 1), sums(1)
        aux = hpy.gammas(one(strength / high + parent_tables), one(np.uint64(1)), salt)[0]
        weight = one(float(np.log(high * aux / (v + 1))))
        seats = {w: int(hpy.draw_tables(one(c), weight, high, one(hashes[w]), salt)[0]) for w, c in below.items()}
        g = {w: hpy.gammas(one(below[w] - high * seats[w]), one(hashes[w]), salt + 1)[0] for w in below}
        parent_tables = float(sum(seats.values()))
        if turn > burn_in:
            samples.append((dict(tables), sums(0), {w: below[w] - high * seats[w] for w in below}, sum(below.values()), parent_tables))
        if turn == rounds:
            break
        rest = hpy.gammas(one(strength + high * parent_tables), one(np.uint64(2)), salt)[0]
        lonely = [w for w in count if count[w] == 1]
        of_lonely = hpy.gammas(one(len(lonely) * (1 - high)), one(np.uint64(3)), salt)[0] if lonely else 0.0
        total, of = sum(g[w] for w in g if count[w] > 1) + of_lonely + rest, sums(0)
        for (u, w), c in pairs.items():
            if c > 1:
                x = hpy.gammas(one(strength / low + of[u]), one(hashes[u]), salt + 50)[0]
                key = hpy.mix64(one(hashes[u]) * hpy._U + one(hashes[w]))
                tables[u, w] = int(hpy.draw_tables(one(c), np.log(low * x) + np.log((one(g[w]) + rest / (v + 1)) / total), low, key, salt + 50)[0])
    n = sum(count.values())

    def predictive(u, w):
        p = 0.0
        for t, of, mass, c, heads in samples:
            parent = (mass.get(w, 0) + (strength + high * heads) / (v + 1)) / (strength + c)
            p += ((pairs[u, w] - low * t.get((u, w), 0)) + (strength + low * of[u]) * parent) / (strength + customers[u])
        return p / len(samples)

    out = []
    for i, held, ws in docs:
        score = sum(math.log10(predictive(u, w)) for u, w in zip([None, *ws[:-1]], ws, strict=True))
        out.append((i, held, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), score))
    return out, predictive, [*count, "never seen"]


@pytest.mark.parametrize("common", [65_535, 9])
def test_scores_are_those_of_a_plain_sampler(spark, monkeypatch, common):
    if common < hpy.COMMON:  # few common words: most pairs are of two rare ones
        monkeypatch.setattr(hpy, "_common_words", lambda docs, whole=hpy._common_words: np.unique(np.append(whole(docs)[:common], hpy._END)))
    rows = documents()
    wanted, predictive, vocabulary = plain(rows)
    got = hpy.lm_scores(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(wanted, key=order), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-12) and math.isclose(g[6], w[6], rel_tol=1e-9)
    for u in ("the", "w3", "never seen", None):
        assert math.isclose(sum(predictive(u, w) for w in vocabulary), 1, rel_tol=1e-9)
    held = [r for r in got if r.held_out and r.n_known == r.n_tokens]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tables_follow_the_conditional():
    d, log_a = 0.7, math.log(1.9)
    for c in (2, 3, 7, 40):
        stirling = {(1, 1): 1.0}
        for i in range(1, c):
            for t in range(1, i + 2):
                stirling[i + 1, t] = stirling.get((i, t - 1), 0.0) + (i - d * t) * stirling.get((i, t), 0.0)
        p = np.array([stirling[c, t] * math.exp(t * log_a) for t in range(1, c + 1)])
        drawn = hpy.draw_tables(np.full(60_000, c), np.full(60_000, log_a), d, np.arange(60_000, dtype=np.uint64), 4)
        assert np.abs(np.bincount(drawn, minlength=c + 1)[1:] / 60_000 - p / p.sum()).max() < 0.01


@pytest.mark.parametrize("weight", [0.05, 1.0, 30.0, 400.0])
def test_large_dishes_are_close_to_the_conditional(weight):
    d, c, n = 0.75, 4096, 4000
    row = np.full(c + 2, -np.inf)
    row[1] = 0.0
    t = np.arange(1, c + 2)
    for i in range(1, c):
        row[1:] = np.logaddexp(row[:-1], np.where(t <= i, np.log(np.maximum(i - d * t, 1e-300)), -np.inf) + row[1:])
    p = row[1:] + t * math.log(weight)
    p = np.exp(p - p.max())
    p /= p.sum()
    mean = (p * t).sum()
    drawn = hpy.draw_tables(np.full(n, c), np.full(n, math.log(weight)), d, np.arange(n, dtype=np.uint64), 4)
    assert abs(drawn.mean() - mean) < 0.04 * mean + 0.05
    assert abs(drawn.std() - math.sqrt((p * (t - mean) ** 2).sum())) < 0.15 * drawn.std() + 0.05


def test_gammas_have_their_moments():
    for shape in (0.2, 1.0, 37.5):
        x = hpy.gammas(np.full(50_000, shape), np.arange(50_000, dtype=np.uint64), 9)
        assert abs(x.mean() - shape) < 0.03 * max(shape, 0.5) and abs(x.var() - shape) < 0.06 * max(shape, 0.5)


def test_order_and_parts_bear_on_nothing(spark, monkeypatch):
    rows = documents(60)
    base = hpy.lm_scores(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    monkeypatch.setattr(hpy, "BLOCK", 500)
    monkeypatch.setattr(hpy, "SHARE", 300)
    other = hpy.lm_scores(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for a, b in zip(sorted(base, key=order), sorted(other, key=order), strict=True):
        assert a[:5] == b[:5] and math.isclose(a.score, b.score, rel_tol=1e-9) and math.isclose(a.base_score, b.base_score, rel_tol=1e-9)


def test_empty_tables_and_nothing_to_learn(spark):
    assert hpy.lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = hpy.lm_scores(spark.createDataFrame([(i, "some words", None, 1) for i in held], SCHEMA)).collect()
    assert len(got) == len(held) and all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-12 and abs(r.score) < 1e-12 for r in got)
    one = hpy.lm_scores(spark.createDataFrame([(0, None, 1.0, 1)], SCHEMA)).collect()[0]
    assert (one.n_tokens, one.train_tokens, one.n_known) == (1, 1, 1) and one.score < 0

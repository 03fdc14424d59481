import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("skein.llm.secret_scan")

from skein.llm.quality import quality_scores  # noqa: E402
from skein.llm.secret_scan import KINDS, secret_spans  # noqa: E402

PATTERNS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": (r"AKIA[A-Z0-9]+", 0),
    "hex": (r"[0-9a-f]+", 0),
}


def brute(text):
    found = []
    for kind, (p, flags) in PATTERNS.items():
        for m in re.finditer(p, text, flags):
            if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                found.append((m.start(), KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x[-1] for x in sorted(found)]


def texts():
    rng = random.Random(2)
    key = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    alnum, hexa = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    out = [None, "", "é password=", "secret=token : abcdef", "paſſword=abcdefgh", "AKIA" * 6, "AKIAA " + "AKIA" + "Z" * 16, "a" * 30, "password=" + "token=" * 9000]
    for _ in range(150):
        words = ["ünd " + key("aeiou nrst", 40) for _ in range(3)]
        words.insert(1, rng.choice([f'Token = "{key(hexa, 40)}"', f"password={key(hexa, 18)}", "AKIA" + key("ABCDEFGH234567", 16), f"mail.{key('0123456789', 14)}@example.com", "+1 (555) 555-1234", f"visit/page-{rng.randrange(9999)}/{key('aeioust', 12)}"]))
        out.append(" ".join(words))
    return out


def test_base_spans_match_the_patterns(spark):
    data = [(i, t, "x") for i, t in enumerate(texts())] + [(3, "again token=abcdef", "x"), (None, "token=abcdef", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, spans string").repartition(3)
    got = secret_spans(df).collect()
    want = sorted((str(i), hashlib.sha256(",".join(brute(t or "")).encode()).hexdigest()) for i, t, _ in data)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    of = {}
    for i, t, _ in data:
        of.setdefault(i, []).append(brute(t or ""))
    for r in got:
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("model")] in of[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in KINDS[:3])
    assert secret_spans(spark.createDataFrame([], df.schema)).count() == 0


def test_quality_on_held_out_rows(spark):
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choice("aeiourstlnm") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 90))).capitalize() + "."
    bad = lambda: rng.choice([lambda: good().upper().replace(" ", "!! "), lambda: " ".join([good().split()[0]] * 60), lambda: good().replace(" ", " | ")])()
    kind = [rng.random() < 0.8 for _ in range(900)]
    docs = [(i, good() if k else bad(), "x") for i, k in enumerate(kind)] + [(900, None, "x"), (901, "", "x"), (902, "word " * 50_000, "x")]
    labels = [(i, int(k)) for i, k in enumerate(kind) if i % 2]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4)
    got = quality_scores(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == kind[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901]
    none = quality_scores(df, spark.createDataFrame([], "doc_id long, quality int")).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_threshold_keeps_the_recall_below_one_half(monkeypatch):
    from skein.llm import secret_scan

    monkeypatch.setattr(secret_scan, "_convolve", lambda w, x: (x[:, 0].astype(float),))
    x, y = (np.arange(400) % 7)[:, None], np.arange(400) % 10 == 0
    w = secret_scan.calibrate({}, x, y, 0.95)
    assert (secret_scan.predict(w, x[y]) >= w["threshold"]).mean() >= 0.95


def test_candidates_are_the_runs():
    from skein.llm.secret_scan import MIN_CANDIDATE, MIN_WITHOUT_DIGIT, candidate_spans

    rng = random.Random(7)
    for text in [*filter(None, texts()), "", "a" * 20, "a" * 20 + "1", "x٣" + "b" * 25, "1234567", "12345678", *("".join(rng.choice("aZ0.@ é\n") * rng.randrange(1, 9) for _ in range(30)) for _ in range(300))]:
        runs = [m for m in re.finditer(r"[A-Za-z0-9+/_=.@-]+", text) if len(m[0]) >= (MIN_CANDIDATE if re.search("[0-9]", m[0]) else MIN_WITHOUT_DIGIT)]
        assert candidate_spans(text) == [m.span() for m in runs], text


def _secret_texts(rng, counts):
    key = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    hexa, digits = "0123456789abcdef", "0123456789"
    word = lambda: key("aeiounrst", rng.randrange(2, 9))
    kinds = {
        "known": lambda: rng.choice(["token = ", "", "password="]) + key(hexa, rng.choice([24, 32, 40])),
        "missed": lambda: key(hexa, 22),
        "other": lambda: rng.choice([lambda: key(digits, 16), lambda: f"{word()}.{key(digits, 2)}@mail.example.com", lambda: ".".join(key(digits, 3) for _ in range(4)), lambda: f"https://{word()}.example/{word()}/{key(digits, 4)}"])(),
    }
    return [(" ".join([word(), word(), kinds[k](), word(), word()]), k) for k, n in counts.items() for _ in range(n)]


def test_network_finds_what_the_patterns_miss(spark):
    from skein.llm.secret_scan import redact

    data = [(i, t, k) for i, (t, k) in enumerate(_secret_texts(random.Random(11), {"known": 200, "missed": 10, "other": 300}))]
    got = {r.doc_id: r.spans for r in secret_spans(spark.createDataFrame(data, "doc_id long, text string, kind string")).collect()}
    hits = {k: sum("model:" in got[i] for i, _, kind in data if kind == k) for k in ("missed", "other")}
    assert hits["missed"] >= 5 and hits["other"] <= 9, hits
    again = {r.doc_id: r.text for r in redact(spark.createDataFrame(data, "doc_id long, text string, n_secrets string")).collect()}
    assert all(("[SECRET]" in again[i]) == bool(got[i]) for i, _, _ in data)


def test_network_recalls_held_out_findings():
    from skein.llm.secret_scan import base_spans, candidate_spans, learn, predict, windows

    def sample(seed, n):
        out = {True: [], False: []}
        for t, _ in _secret_texts(random.Random(seed), {"known": n, "other": n}):
            base = base_spans(t)
            for s, e in candidate_spans(t):
                out[any(x < e and s < y for x, y, _ in base)].append(windows(t, s, e)[0])
        return np.stack(out[True]), np.stack(out[False])

    w = learn(*sample(1, 300), 0.95)
    yes, no = sample(2, 400)
    assert (predict(w, yes) >= w["threshold"]).mean() >= 0.9
    assert (predict(w, no) >= w["threshold"]).mean() <= 0.03

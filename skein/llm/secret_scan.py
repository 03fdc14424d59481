"""Operator 8: secret scans by fixed patterns and a character convolutional network over every candidate and its context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import materialise, short_batches

#: The kinds of findings, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What a text in lower case holds if it has an assignment.
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A candidate of the network: a run of these characters that holds a digit and is long enough to be a password, or that is long enough
#: to be a key without one.
_DIGITS, _TEN = re.compile(r"[0-9]+"), frozenset("0123456789")
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.@-")
MIN_CANDIDATE, MIN_WITHOUT_DIGIT = 8, 20
_LONG = re.compile(r"[A-Za-z+/_=.@-]{%d,}" % MIN_WITHOUT_DIGIT)
#: The network's window: characters before the candidate, of it, and after it. Longer candidates are read in several windows.
_LEFT, _TOKEN, _RIGHT = 20, 48, 12
_SPAN = _LEFT + _TOKEN + _RIGHT
#: Bound of the training sample, of either label, and steps of the first network.
MAX_FINDINGS, FIRST_STEPS = 2000, 60


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, ordered by start, then kind as listed."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYS):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """Maximal runs that hold a digit, of MIN_CANDIDATE characters or more, and those without one of MIN_WITHOUT_DIGIT or more, in order."""
    found, done = [], 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        start, end = m.span()
        while start > done and text[start - 1] in _RUN:
            start -= 1
        while end < len(text) and text[end] in _RUN:
            end += 1
        done = end
        if end - start >= MIN_CANDIDATE:
            found.append((start, end))
    whole = [m.span() for m in _LONG.finditer(text) if text[m.start() - 1 : m.start()] not in _TEN and text[m.end() : m.end() + 1] not in _TEN]
    return sorted(found + whole) if whole else found


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where((raw >= 32) & (raw < 127), raw - 31, np.where(raw < 32, 97, 96)).astype(np.uint8)


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate and its context, one row for each _TOKEN characters of it; those of the candidate lie above 100."""
    out = []
    for a in range(start, end, _TOKEN):
        b = min(end, a + _TOKEN)
        row = np.zeros(_SPAN, np.uint8)
        left, right = _codes(text[max(0, a - _LEFT) : a]), _codes(text[b : b + _RIGHT])
        row[_LEFT - len(left) : _LEFT] = left
        row[_LEFT : _LEFT + b - a] = _codes(text[a:b]) + 100
        row[_LEFT + b - a : _LEFT + b - a + len(right)] = right
        out.append(row)
    return np.stack(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its base spans, and of each candidate its place, its windows and whether a base span covers part of it."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("found", pa.bool_()), ("window", pa.binary())]))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    for b in batches:
        base, candidates = [], []
        for t in b.column("text").to_pylist():
            own = base_spans(t)
            base.append([{"start": s, "end": e, "kind": k} for s, e, k in own])
            candidates.append([{"start": s, "end": e, "found": any(x < e and s < y for x, y, _ in own), "window": windows(t, s, e).tobytes()} for s, e in candidate_spans(t)])
        keep = [i for i, n in enumerate(b.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(base, spans), pa.array(candidates, kind)], [*(b.schema.names[i] for i in keep), "base", "candidates"])


def _convolve(w: dict, x: np.ndarray) -> tuple:
    e = w["embed"][x]
    n, length, d = e.shape
    cols = np.lib.stride_tricks.sliding_window_view(e, 5, axis=1).transpose(0, 1, 3, 2).reshape(n, length - 4, 5 * d)
    maps = np.maximum(cols @ w["filter"] + w["bias"], 0)
    top, mean = maps.max(1), maps.mean(1)
    return e, cols, maps, top, mean, np.concatenate((top, mean), 1) @ w["out"] + w["out0"]


def train(x: np.ndarray, y: np.ndarray, steps: int = 400, seed: int = 3) -> dict:
    """A network of an embedding, 24 filters of width 5, maximum and mean over places, and a logistic output, fitted by Adam."""
    rng = np.random.default_rng(seed)
    d, f = 8, 24
    w = {"embed": rng.normal(0, 0.3, (256, d)), "filter": rng.normal(0, 0.2, (5 * d, f)), "bias": np.zeros(f), "out": rng.normal(0, 0.1, 2 * f), "out0": np.zeros(())}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    pos, neg = np.flatnonzero(y), np.flatnonzero(~y)
    for step in range(1, steps + 1):
        rows = np.concatenate((rng.choice(pos, 48), rng.choice(neg, 48)))
        bx, by = x[rows], y[rows]
        e, cols, maps, top, mean, z = _convolve(w, bx)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - by) / len(rows)
        both = np.concatenate((top, mean), 1)
        back = np.outer(g, w["out"])
        places = maps.shape[1]
        dm = np.repeat(back[:, None, f:] / places, places, 1)
        at = maps.argmax(1)
        np.add.at(dm, (np.arange(len(rows))[:, None], at, np.arange(f)[None, :]), back[:, :f])
        dm *= maps > 0
        dc = (dm @ w["filter"].T).reshape(len(rows), places, 5, d)
        de = np.zeros_like(e)
        for k in range(5):
            de[:, k : k + places] += dc[:, :, k]
        ge = np.zeros_like(w["embed"])
        np.add.at(ge, bx, de)
        grads = {"embed": ge, "filter": np.tensordot(cols, dm, ((0, 1), (0, 1))), "bias": dm.sum((0, 1)), "out": both.T @ g + 1e-4 * w["out"], "out0": g.sum()}
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
            w[k] = w[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def predict(w: dict, x: np.ndarray) -> np.ndarray:
    """Calibrated probabilities of the rows of x."""
    z = np.concatenate([_convolve(w, x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)
    slope, shift = w.get("calibration", (1.0, 0.0))
    return 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))


def calibrate(w: dict, x: np.ndarray, y: np.ndarray, recall: float) -> dict:
    """Platt's scaling on held-out rows, and the highest threshold at which so much of their findings is recalled."""
    z = _convolve(w, x)[-1]
    slope, shift = 1.0, 0.0
    for _ in range(300):
        g = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30))) - y
        slope, shift = slope - 0.1 * (g * z).mean() / max(1.0, (z * z).mean()), shift - 0.1 * g.mean()
    w = w | {"calibration": (slope, shift)}
    p = np.sort(predict(w, x[y]))
    return w | {"threshold": float(p[int((1 - recall) * len(p))]) if len(p) else 0.5}


def _without_hint(x: np.ndarray, context: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The same findings in the context of other candidates: a key is to be known by its own characters."""
    out = x.copy()
    other = context[rng.integers(0, len(context), len(x))]
    out[:, :_LEFT] = np.where(other[:, :_LEFT] > 100, 0, other[:, :_LEFT])
    return out


def learn(yes: np.ndarray, no: np.ndarray, recall: float) -> dict:
    """A network learnt from three quarters of the windows of findings and of others, calibrated on the rest. Each finding counts twice, once
    in the context of another candidate; both stand on the same side of the cut. The others may hold secrets that no pattern knows: those
    that a first, shortly trained network takes for findings are left out of the second one's."""
    rng = np.random.default_rng(1)

    def side(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate((own, _without_hint(own, other, rng), other)), np.repeat([True, False], [2 * len(own), len(other)])

    yes, no = rng.permutation(yes), rng.permutation(no)
    first = train(*side(yes, no), steps=FIRST_STEPS)
    plain = no[predict(first, no) < 0.5]
    no = plain if len(plain) >= 8 else no
    held = side(yes[::4], no[::4])
    model = train(*side(np.delete(yes, np.s_[::4], 0), np.delete(no, np.s_[::4], 0)))
    return calibrate(model, *held, recall)


def fit(scanned: DataFrame, recall: float, most: int):
    """A broadcast network learnt from at most `most` found and as many other candidates, those with the smallest hashes; None
    where either has fewer than 8."""
    each = scanned.select(F.explode("candidates").alias("c")).select("c.found", F.substring("c.window", 1, _SPAN).alias("window")).distinct()
    pick = lambda found: [np.frombuffer(r.window, np.uint8) for r in each.where(F.col("found") == found).orderBy(F.xxhash64("window"), "window").limit(most).collect()]
    yes, no = pick(True), pick(False)
    sc = scanned.sparkSession.sparkContext
    if len(yes) < 8 or len(no) < 8:
        return sc.broadcast(None)
    return sc.broadcast(learn(np.stack(yes), np.stack(no), recall))


def _scores(w: dict | None, candidates: list[np.ndarray]) -> list[float]:
    """The highest probability of each candidate's windows; 0 without a network."""
    if w is None or not candidates:
        return [0.0] * len(candidates)
    p = predict(w, np.concatenate(candidates))
    return [float(s.max()) for s in np.split(p, np.cumsum([len(c) for c in candidates]))[:-1]]


def _judge(model):
    """Add the spans of candidates that no base span touches and that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            rows = []
            base, candidates = b.column("base").to_pylist(), b.column("candidates").to_pylist()
            flat = [np.frombuffer(c["window"], np.uint8).reshape(-1, _SPAN) for own in candidates for c in own]
            scores = iter(_scores(w, flat))
            for own, more in zip(base, candidates, strict=True):
                added = [(c["start"], c["end"], "model") for c, s in ((c, next(scores)) for c in more) if w is not None and not c["found"] and s >= w["threshold"]]
                spans = [(s["start"], s["end"], s["kind"]) for s in own]
                join = lambda found: ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]))))
                count = [sum(k == kind for *_, k in spans) for kind in KINDS[:3]]
                rows.append((*count, hashlib.sha256(join(spans).encode()).hexdigest(), join(spans + added)))
            keep = [i for i, n in enumerate(b.schema.names) if n not in ("base", "candidates")]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            found = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *found], [*(b.schema.names[i] for i in keep), "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secret_spans(docs: DataFrame, recall: float = 0.95, most: int = MAX_FINDINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find secrets in every whole text: the three patterns, and candidates that the network takes for one.

    The network learns from the corpus's own candidates, those that a pattern finds against the others, on a bounded sample,
    and scores every candidate with its context; it only adds spans that touch no pattern's span. Places are code points, ends
    exclusive. A null text is empty; a text without secrets has empty spans. Null and repeated ids keep their rows. With too few
    candidates to learn from, the patterns alone decide. An empty table gives an empty result. Other columns are ignored.
    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    short_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = "start:bigint,end:bigint"
    scanned = materialise(source.mapInArrow(_scan, f"doc_id long, base array<struct<{place},kind:string>>, candidates array<struct<{place},found:boolean,window:binary>>"))
    model = fit(scanned, recall, most)
    return scanned.mapInArrow(_judge(model), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _cut(model, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            texts, counts = [], []
            own = b.column("text").to_pylist()
            base = [[(s, e) for s, e, _ in base_spans(t)] if t else [] for t in own]
            more = [[c for c in candidate_spans(t) if not any(s < c[1] and c[0] < e for s, e in known)] if t and w is not None else [] for t, known in zip(own, base, strict=True)]
            scores = iter(_scores(w, [windows(t, *c) for t, cs in zip(own, more, strict=True) for c in cs]))
            for t, spans, others in zip(own, base, more, strict=True):
                spans = spans + [c for c, score in ((c, next(scores)) for c in others) if score >= w["threshold"]]
                parts, at = [], 0
                for s, e in sorted(spans):
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                texts.append("".join([*parts, t[at:]]) if spans else t)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["row", "text", "n_secrets"])

    return run


def redact(docs: DataFrame, mark: str = "[SECRET]", recall: float = 0.95, most: int = MAX_FINDINGS, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, each secret in the text column replaced by mark (touching spans by one), as secret_spans finds
    them. A null text stays null."""
    short_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = "start:bigint,end:bigint"
    scanned = materialise(source.mapInArrow(_scan, f"base array<struct<{place},kind:string>>, candidates array<struct<{place},found:boolean,window:binary>>"))
    model = fit(scanned, recall, most)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    done = rows.mapInArrow(_cut(model, mark), T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_secrets", T.LongType())]))
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])

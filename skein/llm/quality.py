"""Operator 9: a quality classifier by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import short_batches, text_buffer, word_hashes

#: Bounds of the training sample: rows labelled positive, and rows of unlabelled text.
MAX_POSITIVES, MAX_UNLABELLED = 4000, 8000

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!", "?", "|", "#", "$", "%", "&", "*", ":;", "'\"`", "()[]{}<>", "-_/\\=+~^@"]
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g.encode())] = _i
_CLASS[0x80:0xC0], _CLASS[0xC0:] = len(_GROUPS) + 1, len(_GROUPS) + 2
_K = len(_GROUPS) + 3
N_FEATURES = _K * _K + _K + 6


def features(column: pa.Array) -> np.ndarray:
    """One row a text: logarithms of the rates of byte classes and of pairs of neighbours, the length, and how words repeat."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    singles, pairs = np.zeros((n, _K)), np.zeros((n, _K * _K))
    first = 0
    while first < n:  # so many texts at a time that they hold about 4 MB; a longer text is read alone
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (4 << 20), "right")) - 1)
        a, b = int(offsets[first]), int(offsets[last])
        for begin in range(a, b, 8 << 20):
            part = _CLASS[data[begin : min(begin + (8 << 20) + 1, b)]]
            of = np.repeat(np.arange(last - first), size[first:last])[begin - a : begin - a + len(part)]
            own = min(len(part), 8 << 20)
            singles[first:last] += np.bincount(of[:own] * _K + part[:own], minlength=(last - first) * _K).reshape(-1, _K)
            if len(part) > 1:
                inside = of[1:] == of[:-1]
                code = of[1:] * (_K * _K) + part[:-1] * _K + part[1:]
                pairs[first:last] += np.bincount(code[inside], minlength=(last - first) * _K * _K).reshape(-1, _K * _K)
        first = last
    words, counts = word_hashes(data, offsets)
    of = np.repeat(np.arange(n), counts)
    again = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(words) > 1 else np.zeros(n)
    order = np.lexsort((words, of))
    words, of = words[order], of[order]
    new = np.ones(len(words), bool)
    if len(words) > 1:
        new[1:] = (words[1:] != words[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(words)))
    most = np.zeros(n)
    np.maximum.at(most, of[starts], runs)
    some, per = np.maximum(counts, 1), np.maximum(size, 1)
    extra = np.stack([np.log1p(size), np.log1p(counts), size / some, np.bincount(of[starts], minlength=n) / some, again / some, most / some], 1)
    return np.concatenate([np.log1p(1000 * pairs / per[:, None]), np.log1p(1000 * singles / per[:, None]), extra], 1).astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array([r.tobytes() for r in x], pa.binary())], ["positive", "x"])


def _forward(w: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ w["a"] + w["b"], 0)
    return hidden, hidden @ w["c"] + w["d"]


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, seed: int = 11) -> dict:
    """Minimise the non-negative unbiased risk prior*R_p(+) + max(0, R_u(-) - prior*R_p(-)) under the logistic loss. Where the
    inner difference falls below zero, the step goes the other way along it. A network with one hidden layer, by Adam."""
    rng = np.random.default_rng(seed)
    every = np.concatenate((positive, unlabelled))
    mean, scale = every.mean(0), every.std(0) + 0.05
    del every
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    w = {"a": rng.normal(0, 0.05, (p.shape[1], 24)), "b": np.zeros(24), "c": rng.normal(0, 0.2, 24), "d": np.zeros(())}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        bp, bu = p[rng.integers(0, len(p), 256)], u[rng.integers(0, len(u), 512)]
        x = np.concatenate((bp, bu))
        hidden, z = _forward(w, x)
        zp, zu = z[:256], z[256:]
        minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = np.zeros(len(x))
        if minus >= 0:
            g[:256] = prior * (sigmoid(zp) - 1) / 256 - prior * sigmoid(zp) / 256
            g[256:] = sigmoid(zu) / 512
        else:
            g[:256] = prior * sigmoid(zp) / 256
            g[256:] = -sigmoid(zu) / 512
        back = np.outer(g, w["c"]) * (hidden > 0)
        grads = {"a": x.T @ back + 1e-4 * w["a"], "b": back.sum(0), "c": hidden.T @ g + 1e-4 * w["c"], "d": g.sum()}
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
            w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {k: np.asarray(x, np.float32) for k, x in w.items()} | {"mean": mean, "scale": scale}


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            if w is None:
                score = np.full(b.num_rows, 0.5)
            else:
                z = _forward(w, (features(b.column("text")) - w["mean"]) / w["scale"])[1]
                score = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
            kept = [i for i, n in enumerate(b.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(score)], [*(b.schema.names[i] for i in kept), "score"])

    return run


def held_out(id_col: str):
    """Rows never learnt from: crc32 of the id as text, modulo 5, is 0. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, positives: int = MAX_POSITIVES, unlabelled: int = MAX_UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Score every whole text by a classifier learnt from trusted positives (labelled 1) and unlabelled text.

    At most `positives` rows labelled 1 and `unlabelled` rows of docs are learnt from, those with the smallest hashes of their
    ids, none of them held out. The class prior is the share of label 1 over all labels that are not held out. The text alone
    decides a score: equal texts have equal scores. A null text is empty. Without positives or unlabelled rows every score is 0.5.
    Null or repeated ids keep their rows. An empty table gives an empty result. Other columns of docs are ignored.
    Returns doc_id, held_out, score, predicted (1 where score >= threshold)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = fit(source, labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")), positives, unlabelled)
    out = source.withColumn("held_out", held_out("doc_id")).mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, with all their columns, whose text the classifier scores at threshold or more."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = fit(source, labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score(model), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.where(F.col("score") >= threshold).select("row.*")


def fit(source: DataFrame, labels: DataFrame, positives: int = MAX_POSITIVES, unlabelled: int = MAX_UNLABELLED):
    """A broadcast model learnt from source (doc_id, text) and labels (doc_id, label); None where there is nothing to learn from."""
    spark = source.sparkSession
    short_batches(spark)
    known = labels.where(~held_out("doc_id") & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    prior = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    by_hash = lambda df, n, flag: df.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(n)), "doc_id").limit(n).withColumn("positive", F.lit(flag))
    chosen = by_hash(known.where("label = 1"), positives, True).union(by_hash(source.where(~held_out("doc_id") & F.col("doc_id").isNotNull()), unlabelled, False))
    # at most positives + unlabelled ids, whatever the input, and one text of each
    texts = source.join(F.broadcast(chosen.distinct()), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    sample = texts.select("positive", "text").mapInArrow(_features, "positive boolean, x binary").collect()
    x = {flag: np.array([np.frombuffer(r.x, np.float32) for r in sample if r.positive == flag]) for flag in (True, False)}
    del sample
    if not len(x[True]) or not len(x[False]):
        return spark.sparkContext.broadcast(None)
    x = {k: v[np.lexsort(v.T[::-1][:8])] for k, v in x.items()}  # an order of their own, whatever the tasks' order
    return spark.sparkContext.broadcast(train(x[True], x[False], min(0.98, max(0.02, prior))))

"""Operator 4: threshold-scaled fingerprints (every shingle hash below a fixed fraction) and estimates of containment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import shingle_sets, short_batches, tasks

#: Hex digits of one retained hash.
_DIGITS = 8


def sketches(column: pa.Array, scale: int = 8) -> list[np.ndarray]:
    """Of each text the retained hashes of its word 5-gram set: those in the lowest 1/scale of the hash space, and the smallest
    one in any case, so that only a text without words has none. The sketch of a union is the union of sketches without a
    smallest hash above the threshold where another hash is kept."""
    h, of, n = shingle_sets(column)
    low = h < np.uint64(2**64 // scale)
    first = np.cumsum(n) - n
    low[first[n > 0]] = True  # hashes are sorted within a text
    kept = ((h[low] >> np.uint64(29)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return np.split(kept, np.cumsum(np.bincount(of[low], minlength=len(n)))[:-1]) if len(n) else []


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated containment of the smaller document in the larger one; two empty sketches are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a), np.unique(b)
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def _compare(scale: int):
    """Rows come ordered by (bucket, first the row carried over from the bucket before, id); the row before is the next document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, old = "", np.empty(0, np.uint32)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            own = sketches(pa.array(texts, pa.large_string()), scale)
            edited = [t[: len(t) - len(t) // 3] + p[: len(t) // 3] for t, p in zip(texts, [before, *texts], strict=False)]
            changed = sketches(pa.array(edited, pa.large_string()), scale)
            rows = []
            for i, (carried, doc) in enumerate(zip(b.column("carried").to_pylist(), b.column("doc_id").to_pylist(), strict=True)):
                if not carried:
                    rows.append((doc, len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest(), as_text(own[i]), as_text(changed[i]), likeness(own[i], changed[i]), likeness(own[i], own[i - 1] if i else old)))
            if texts:
                before, old = texts[-1], own[-1]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def fingerprints(docs: DataFrame, scale: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text: the last third of its code points replaced by the start of the next
    document's text, in descending order of id (ties by a hash of the text; after the last document comes the first).

    Rows are dealt once, by ranges of ids, and read in order; the only rows that a range needs of another are the largest of
    the range before, one a range. A null text is empty. Null ids come last, as the smallest. Repeated rows stay rows and
    are each other's next document. An only document is its own next. An empty table gives an empty result. Other columns are
    ignored. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    short_batches(spark)
    lowest = -(2**63)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(lowest)))
    ranges = 2 * tasks(spark)
    # a number for each range: as many as the tasks need, whatever the rows
    cuts = sorted(set(docs.select("place").stat.approxQuantile("place", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))

    @F.pandas_udf("int")
    def bucket(place):
        return __import__("pandas").Series(np.searchsorted(np.asarray(cuts, np.float64), place.to_numpy(np.float64), "left").astype(np.int32))

    last = F.max(F.struct("place", F.xxhash64("text").alias("h"))).alias("last")
    ends = sorted((r.bucket, r.last.place, r.last.h) for r in docs.withColumn("bucket", bucket("place")).groupBy("bucket").agg(last).collect())
    numbers = [e[0] for e in ends]
    following = {(p, h): numbers[(i + 1) % len(ends)] for i, (_, p, h) in enumerate(ends)}
    placed = docs.withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket("place"))
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("carried"))
    copies = F.array(own)
    if following:
        goes = F.map_from_arrays(F.array(*[F.lit(f"{p}:{h}") for p, h in following]), F.array(*[F.lit(v).cast("int") for v in following.values()]))
        is_last = F.col("place").isin([p for p, _ in following])
        to = F.when(is_last, F.element_at(goes, F.concat_ws(":", "place", "h")))
        copies = F.when(to.isNotNull(), F.array(own, F.struct(to.alias("to"), F.lit(True).alias("carried")))).otherwise(copies)
    dealt = placed.withColumn("copy", F.explode(copies)).select("copy.to", "copy.carried", "place", "h", "doc_id", "text")
    dealt = dealt.repartition(ranges, "to").sortWithinPartitions("to", F.desc("carried"), "place", "h")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("carried", "doc_id", "text").mapInArrow(_compare(scale), schema)

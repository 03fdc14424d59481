"""Helpers that the operators of this subpackage share: cut lineage, batch sizes, hashing of words and shingles."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch sent to Python; texts can be long, so batches are kept short.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a table into the shared folder and read it again; lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _places[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote and that nothing reads any more."""
    for df in tables:
        if path := _places.pop(df, None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def collect_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now: its cleaner waits for the driver's garbage collector, which a quiet driver seldom runs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, so that a batch of long texts fits a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# --- hashing of words and word shingles over the UTF-8 buffer of an Arrow column ---

_RNG = np.random.default_rng(20240517)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WINDOW = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * _WINDOW)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[name] = np.multiply.accumulate(t)
    return _powers["up"], _powers["down"]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null has no bytes."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of each text and the words' counts by text. Words: runs of bytes other than 20 and 09-0D, A-Z as a-z.

    The bytes are read in windows of about 1 MB, cut between words, so that a very long text needs little memory."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    hashes, firsts = [], []
    bounds = np.unique(offsets)
    at = lo
    while at < hi:
        to = at + _WINDOW
        if to >= hi:
            to = hi
        else:
            nxt = bounds[np.searchsorted(bounds, to)]
            step = to
            while step < nxt:
                gap = np.flatnonzero(_SEP[data[step : min(step + 65536, nxt)]])
                if len(gap):
                    step += int(gap[0])
                    break
                step = min(step + 65536, nxt)
            to = int(step)
        part = data[at:to]
        word = ~_SEP[part]
        head = word.copy()
        head[1:] &= ~word[:-1]
        cut = bounds[(bounds >= at) & (bounds < to)] - at
        head[cut] = word[cut]
        starts = np.flatnonzero(head)
        if len(starts):
            up, down = _power_tables(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(np.where(word, _BYTE[part], np.uint64(0)) * up[: len(part)], out=sums[1:])
            total = sums[np.append(starts[1:], len(part))] - sums[starts]
            hashes.append(mix64(total * down[starts]))
            firsts.append(starts + at)
        at = to
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), np.diff(np.searchsorted(first, offsets))


def shingle_hashes(column, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order with repeats, the text of each, and the words' counts.

    A text of fewer than k words has its whole sequence as one shingle; one without words has none."""
    words, counts = word_hashes(*text_buffer(column))
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    full = np.empty(0, np.uint64)
    of = np.empty(0, np.int64)
    if len(words) >= k:
        m = len(words) - k + 1
        same = owner[:m] == owner[k - 1 :]
        acc = np.zeros(m, np.uint64)
        for i in range(k):
            acc += words[i : i + m] * _PLACE[i]
        full, of = mix64(acc[same]), owner[:m][same]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
        one = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            one[has] += words[begin[short[has]] + i] * _PLACE[i]
        one = mix64(one + _PLACE[7] * counts[short].astype(np.uint64))
        full, of = np.concatenate((full, one)), np.concatenate((of, short))
    return full, of, counts


def shingle_sets(column, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text: hashes sorted within the text, the text of each, and the sets' sizes."""
    h, of, counts = shingle_hashes(column, k)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
    return h, of, np.bincount(of, minlength=len(counts))

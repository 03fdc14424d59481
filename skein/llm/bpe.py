"""Operator 3: byte-level BPE. Spark cuts the texts into words; Arrow batches of words are encoded where they are.

A word begins as one-byte pieces; the neighbours of the lowest rank are merged, the leftmost first, until no pair has a rank. Of a stretch
of words each different one is merged once, and a task keeps what it found for the next. No text, word or id is shuffled."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import short_batches

#: Words that a task keeps, and their longest in characters.
COMMON, COMMON_CHARS = 1 << 17, 24
#: Words that are looked up at a time, and bytes beyond which a word is merged with a heap, since plain merging costs their square.
STRETCH, LONG = 1 << 16, 256
_NONE = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file, base64 token and rank on each line; the file is installed with the vocabularies on every machine."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def words_of(text: Column, pattern: str) -> Column:
    """The matches of the pattern. White space is Unicode's, as in the pattern's own engine."""
    return F.regexp_extract_all(text, F.lit(f"(?U)({pattern})"), F.lit(0))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word after all merges. A word that is a token is that one, as the library has it."""
    if word in ranks:
        return [ranks[word]]
    rank = ranks.get
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [rank(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) < _NONE:
        i = pairs.index(best)
        pieces[i] += pieces.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = rank(pieces[i - 1] + pieces[i], _NONE)
        if i < len(pairs):
            pairs[i] = rank(pieces[i] + pieces[i + 1], _NONE)
    return [ranks[p] for p in pieces]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs and a list of neighbours: n log n steps for n bytes."""
    if word in ranks:
        return [ranks[word]]
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    before, after = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(word) and (rank := ranks.get(pair := pieces[i] + pieces[after[i]])) is not None:
            heapq.heappush(heap, (rank, i, pair))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        if pieces[i] is None or after[i] >= len(word) or pieces[i] + pieces[after[i]] != pair:
            continue  # one of the two has been merged since
        j = after[i]
        pieces[i], pieces[j], after[i] = pair, None, after[j]
        if after[j] < len(word):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in pieces if p is not None]


def _encoded(path: str, common: int, long: int, stretch: int):
    """The digests of each row's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        known: dict[str, bytes] = {}

        def ids_of(word: str) -> bytes:
            data = word.encode()
            ids = np.array((merge_long if len(data) > long else merge)(data, ranks), "<u4").tobytes()
            if len(word) <= COMMON_CHARS and common:
                if len(known) >= common:
                    known.clear()
                known[word] = ids
            return ids

        def looked_up(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """The ids of words, and how many each has."""
            coded = words.dictionary_encode()
            own = [known.get(w) or ids_of(w) for w in coded.dictionary.to_pylist()]
            sizes = np.array([len(x) // 4 for x in own], np.int64)
            index = coded.indices.to_numpy()
            many = sizes[index]
            first = (np.cumsum(sizes) - sizes)[index] - (np.cumsum(many) - many)
            return np.frombuffer(b"".join(own), "<u4")[np.arange(many.sum()) + np.repeat(first, many)], many

        for b in batches:
            words = b.column("words")
            flat = words.flatten()
            parts = [looked_up(flat.slice(at, stretch)) for at in range(0, len(flat), stretch)]
            ids = np.concatenate([np.empty(0, "<u4"), *[p[0] for p in parts]])
            ends = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *[p[1] for p in parts]]))])
            cuts = ends[np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])].tolist()
            own = [ids[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
            back = (b"".join(map(tokens.__getitem__, x.tolist())) for x in own)
            columns = [pa.array([len(x) for x in own], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, common: int = COMMON, long: int = LONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Words are the pattern's matches; each is encoded by itself, without special tokens. Every byte has a rank of its own, so
    that any text can be encoded. A null text is empty, has no ids, and the digests of nothing. Null and repeated ids keep
    their rows. An empty table gives an empty result. Other columns are ignored. A task keeps the ids of `common` short words at most; a word of more than
    `long` bytes is merged with a heap."""
    short_batches(docs.sparkSession)
    words = words_of(F.coalesce(F.col(text_col), F.lit("")), pattern)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    return source.mapInArrow(_encoded(path, common, long, STRETCH), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

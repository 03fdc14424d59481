"""Operator 6: packing of token sequences by first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, short_batches, tasks

#: Words longer than this, and words beyond so many, are not kept from text to text.
_CACHED_CHARS, _CACHED_WORDS = 48, 500_000
#: White space to str.split(), but not to the tokenizer.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encode texts as little-endian unsigned 32-bit ids. The vocabulary drops white space and never joins what stands on
    both sides of it, so each word is encoded once and then looked up."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, bool)
    closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    known: dict[str, bytes] = {}
    stems: dict[str, bytes] = {mark: b"" for mark in ",."}

    def alone(words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(words, add_special_tokens=False)]

    def together(words: list[str]) -> list[bytes]:
        """Words of letters only are one run each, and its last id alone closes a word: they can be encoded as one text."""
        out = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.asarray(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(closes[ids]) + 1
            if len(ends) != len(part):
                out += alone(part)
                continue
            data, at = ids.tobytes(), 0
            for end in (4 * ends).tolist():
                out.append(data[at:end])
                at = end
        return out

    stems.update(zip(",.", alone([",", "."]), strict=True))

    def learn(words: list[str], into: dict[str, bytes]) -> None:
        """A final mark after a letter is a run of its own, and case does not count: few distinct stems are left to encode. A letter must be one in lower
        case too, where some become a letter and an accent; special tokens, which count in their own case, are left whole."""
        parts = [((w[:-1], w[-1]) if w[-1] in ",." and w[-2:-1].lower().isalpha() and "<|" not in w else (w, "")) for w in words]
        parts = [(s.lower() if s.isascii() and "<|" not in s else s, mark) for s, mark in parts]
        if missing := {s for s, _ in parts}.difference(stems):
            if len(stems) + len(missing) > _CACHED_WORDS:
                kept = {mark: stems[mark] for mark in ",."}
                stems.clear()
                stems.update(kept)
                missing = {s for s, _ in parts}.difference(stems)
            letters = [s for s in missing if s.isalpha()]
            others = [s for s in missing if not s.isalpha()]
            stems.update(zip(letters, together(letters), strict=True))
            stems.update(zip(others, alone(others), strict=True))
        for w, (s, mark) in zip(words, parts, strict=True):
            ids = stems[s] + stems[mark] if mark else stems[s]
            (known if len(w) <= _CACHED_CHARS else into)[w] = ids
        for s, _ in parts:
            if len(s) > _CACHED_CHARS:
                stems.pop(s, None)

    def encode(texts: list[str]) -> list[bytes]:
        split = [t.split() if not any(c in t for c in _ODD_SPACE) else None for t in texts]
        every = set().union(*(w for w in split if w))
        missing, extra = every.difference(known), {}
        if len(known) + len(missing) > _CACHED_WORDS:
            known.clear()
            missing = every
        learn(list(missing), extra)
        look = (lambda w: known[w] if w in known else extra[w]) if extra else known.__getitem__
        return [b"".join(map(look, w)) if w is not None else alone([t])[0] for t, w in zip(texts, split, strict=True)]

    return encode


def _pieces(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = word_encoder(path), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc, s, min(length, n - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
            if rows:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return run


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size (given largest first). A tournament tree holds the free space of all bins: each inner
    node the larger of its children, so the first bin with room is found by one walk from the root."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - free[node])
        free[node] -= size
        node //= 2
        while node and free[node] != (best := max(free[2 * node], free[2 * node + 1])):
            free[node] = best
            node //= 2
    return bins, offsets


def _pack(length: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(group["length"].to_pylist(), length)
        sequence = group["grp"].to_numpy() * (1 << 24) + np.asarray(bins, np.int64)
        return group.drop_columns("grp").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2, group_pieces: int = 8192, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every text, add end_id, cut it into pieces of at most `length` ids and pack the pieces into sequences.

    Pieces are dealt at random (a hash of id, start and row) to groups of about group_pieces, however many there are, so no
    group grows with the input; each group is packed by first-fit decreasing. Only the pieces' descriptions are shuffled.

    A null or empty text is the single id end_id. Repeated rows are packed as often as they occur. Null ids are kept.
    Other columns of docs are ignored. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    short_batches(spark)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialise(source.mapInArrow(_pieces(path, length, end_id), schema))
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    return dealt.repartition(min(groups, 4 * tasks(spark)), "grp").groupBy("grp").applyInArrow(_pack(length), schema + ", sequence_id long, offset long")

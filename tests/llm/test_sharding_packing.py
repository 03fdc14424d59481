import zlib

import numpy as np
import pytest

pytest.importorskip("skein.llm.sharding")

from skein.llm.packing import first_fit_decreasing, pack  # noqa: E402
from skein.llm.queries import vocabulary  # noqa: E402
from skein.llm.sharding import shard_by_bytes  # noqa: E402

SCHEMA = "doc_id long, text string, shard string, size int"


def rows(n=60):
    out = [(i, "wörter and more " * (i % 9), "x", 1) for i in range(n)]
    return [*out, (None, "no id", "x", 1), (3, None, None, None), (4, "", "x", 1), (5, "long " * 30_000, "x", 1), (7, "same", "x", 1), (7, "same", "x", 1)]


def test_shards_are_contiguous_and_balanced(spark):
    data = rows()
    got = shard_by_bytes(spark.createDataFrame(data, SCHEMA), 4).collect()
    sizes = [len((t or "").encode()) + 1 for _, t, *_ in data]
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((s, zlib.crc32((t or "").encode())) for s, (_, t, *_) in zip(sizes, data, strict=True))
    for s in {r.shard for r in got}:
        part = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r.size for r in part) - sum(sizes) / 4) <= max(sizes)
    ids = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert ids == sorted(ids)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shard_by_bytes(empty).count() == 0
    assert pack(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(1)
    sizes = sorted(rng.integers(1, 100, 300).tolist(), reverse=True)
    bins, offsets = first_fit_decreasing(sizes, 100)
    used: list[int] = []
    for size, b, o in zip(sizes, bins, offsets, strict=True):
        fit = next((i for i, u in enumerate(used) if u + size <= 100), len(used))
        if fit == len(used):
            used.append(0)
        assert (b, o) == (fit, used[fit])
        used[fit] += size


def test_pieces_hold_every_id_once(spark):
    from tokenizers import Tokenizer

    odd = ["Odd\x1cspace É<|endoftext|> don't 123", "a<|startoftext|>b <|ENDOFTEXT|>. <|endoftext|>, <|endoftext|>", "Ĺẞİ. İ, ẞ. Ǆ. ŉ, ﬁ. a\u0301. K. Å,", "x<|endof text|> <| |>"]
    data = [*rows(20), *((90 + i, t, "x", 1) for i, t in enumerate(odd))]
    got = pack(spark.createDataFrame(data, SCHEMA), vocabulary("word_bpe_49k.json"), length=64, group_pieces=50).collect()
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for doc, text, *_ in data:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(str(doc), s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids)) for s in range(0, len(ids), 64)]
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64

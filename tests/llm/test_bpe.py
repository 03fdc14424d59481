import base64
import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("skein.llm.bpe")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

from skein.llm import bpe  # noqa: E402
from skein.llm.bpe import encode_documents  # noqa: E402
from skein.llm.queries import vocabulary  # noqa: E402


@pytest.mark.parametrize(("common", "long"), [(0, 512), (30, 256), (30, 4)])
def test_ids_match_the_library(spark, common, long, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 50)
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    data = [None, "", " ", "\n\n  x", "don't we'll I'm", "Ünïcödé  naïve space em \t tab", "漢字かな 한국어 العربية हिन्दी", "🙂👍🏽 é", "\x00\x01\x7f", "<|endoftext|>", "a" * 400, "1234567890 12,5", "x" + " " * 70 + "y", "'s 'S", "\r\n\r\n", "\x85\x1c z"]
    data += [" ".join("".join(rng.choice("thereinandé") for _ in range(rng.randrange(1, 12))) for _ in range(60)) for _ in range(12)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(data)] + [(None, "null id", 1), (3, data[3], 1)], "doc_id long, text string, words int").repartition(3)
    got = encode_documents(df, path, public_tokenizers.PATTERN, common=common, long=long).collect()
    assert len(got) == len(data) + 2
    for r in got:
        text = "null id" if r.doc_id is None else data[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert (r.doc_id, r.n_tokens) == (r.doc_id, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), text
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert encode_documents(df.where("false"), path, public_tokenizers.PATTERN, common=common, long=long).count() == 0


def test_words_are_not_gathered_by_the_driver(spark):
    """The plan holds no literal of the vocabulary or of words: nothing grows on the driver."""
    df = spark.createDataFrame([(1, "some words"), (2, "some more words")], "doc_id long, text string")
    out = encode_documents(df, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(plan) < 20_000


def test_plain_merging_and_the_heap_agree():
    ranks = bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    rng = random.Random(8)
    for _ in range(2000):
        word = "".join(rng.choice("aeinrst é漢🙂-_09") for _ in range(rng.randrange(1, 40))).encode()
        assert bpe.merge(word, ranks) == bpe.merge_long(word, ranks)

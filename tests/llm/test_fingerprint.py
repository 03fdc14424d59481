import hashlib

import pytest

pytest.importorskip("skein.llm.fingerprint")

from skein.llm.fingerprint import fingerprints  # noqa: E402


def test_edited_texts_and_order(spark):
    data = [(i * 3, " ".join(f"é{(i * j) % 37}" for j in range(i))) for i in range(70)] + [(1000, "y " * 40_000), (1001, None), (1002, ""), (1003, "same text here"), (1004, "same text here")]
    df = spark.createDataFrame([(t, i, None, i) for i, t in data], "text string, doc_id long, h string, bucket long").repartition(5)
    got = {r.doc_id: r for r in fingerprints(df).collect()}
    order = sorted(data, reverse=True)
    assert len(got) == len(data)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[1003].fingerprint == got[1004].fingerprint and got[1004].near_next == 1
    assert got[1001].fingerprint == "" and got[1002].near_next == 1


def test_likeness_is_near_the_true_containment(spark):
    data = [(i, " ".join(f"w{i}x{j}" for j in range(3000))) for i in range(6)]
    for r in fingerprints(spark.createDataFrame(data, "doc_id long, text string")).collect():
        assert abs(r.near_edited - 2 / 3) < 0.12 and r.near_next < 0.01


def test_one_document_and_none(spark):
    schema = "doc_id long, text string"
    (r,) = fingerprints(spark.createDataFrame([(None, "abc def")], schema)).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest() and r.near_next == 1
    assert fingerprints(spark.createDataFrame([], schema)).count() == 0

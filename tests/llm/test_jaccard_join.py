import itertools
import random
import re

import pytest

pytest.importorskip("skein.llm.jaccard_join")

from skein.llm import jaccard_join  # noqa: E402
from skein.llm.components import components  # noqa: E402
from skein.llm.jaccard_join import jaccard_components  # noqa: E402


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(data):
    sets, root = {i: shingles(t) for i, t in data}, {i: i for i, _ in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        same = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def documents():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["Ünï", "É"]
    shared = " ".join(rng.choice(vocab) for _ in range(40))
    out = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 30, 120]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w) + (" " + shared if rng.random() < 0.3 else ""))
    out += [None, "", " \n\t", "one two", "ONE Two", "one two three", out[0], out[0].upper(), "x y " * 20_000]
    return list(enumerate(out))


def test_components_match_brute_force(spark):
    data = documents()
    df = spark.createDataFrame([(t, i, 1, "x") for i, t in data], "text string, doc_id long, n long, s string").repartition(3)
    assert sorted(map(tuple, jaccard_components(df).collect())) == brute(data)


def test_classes_alone_in_a_part_of_a_split_column(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_BLOCK_ROWS", 4)
    texts = []
    for g in range(24):
        base = [f"g{g}w{i}" for i in range(60)]
        texts += [" ".join(base)] * 6 + [" ".join([*base[:-1], "other"])]
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard_components(df).collect())) == brute(data)


def test_repeated_rows_null_ids_and_empty_table(spark):
    schema = "doc_id long, text string"
    got = jaccard_components(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "a b c d e f")], schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == [(False, 0, 2, 0), (False, 1, 2, 0), (False, 1, 2, 0)]
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(2, None)]
    assert jaccard_components(spark.createDataFrame([], schema)).count() == 0


def test_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)] + [(5, 5), (7, 3)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((n, find(n)) for n in root)


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    from skein.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    data = documents()[:40]
    found = jaccard_components(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == brute(data)
    assert 1 <= len(list(tmp_path.glob("skein-*"))) <= 3  # what the result is read from

"""Structures that are built and then searched, and tables that change together."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import fulltext, ranking, section_trees, vector_index, vectors
from skein.operators.segments import TextIndex
from skein.sources.stores import Stores

CHUNKS = "source_file string, idx int, chunk_id string, text string, start_sec double, end_sec double, speakers array<string>"


def chunks(spark, sizes, file="a.json"):
    return spark.createDataFrame([(file, i, f"c{i}", "x" * n, float(i), i + 1.5, ["S0"] if i % 2 else ["S1", "S0"]) for i, n in enumerate(sizes)], CHUNKS)


# --- section trees ---


def test_sections_fill_up_and_split(spark):
    def lengths(sizes, most):
        return [len(r.chunk_ids) for r in section_trees.build(chunks(spark, sizes), most).orderBy("node_id").collect()]

    assert lengths([40] * 5, 25) == [2, 2, 1] and lengths([4000, 4000], 100) == [1, 1] and lengths([0, 0, 3], 2) == [2, 1]
    assert section_trees.build(chunks(spark, []), 100).count() == 0


def test_nodes_carry_provenance(spark):
    rows = [("f", 0, "a", "hello", 1.0, 3.0, ["S0"]), ("f", 1, "b", "world ", 3.0, 9.5, ["S1", "S0"]), ("g", 0, "c", None, None, None, None), (None, 0, "d", "no file", 0.0, 1.0, None)]
    a, b = section_trees.build(spark.createDataFrame(rows, CHUNKS), titler=lambda t: "" if t == "" else t.upper(), summariser=lambda t: f"on {t[:5]}", describer=lambda t: t).orderBy("source_file").collect()
    assert (a.node_id, a.text, a.start_sec, a.end_sec, a.speakers, a.chunk_ids, a.chunk_count) == ("0001", "hello\nworld", 1.0, 9.5, ["S0", "S1"], ["a", "b"], 2)
    assert (a.title, a.summary, a.doc_description) == ("HELLO\nWORLD", "on hello", "- HELLO\nWORLD: on hello") and (b.start_sec, b.speakers, b.text, b.title) == (None, [], "", "")


def test_replies_name_nodes_of_the_tree(spark):
    replies = ['{"node_ids": ["0002", "0001", "0002", "0099"]}', 'Sure! {"node_ids": ["0001"]} hope that helps', '{"node_ids": []}', "not json at all", '{"wrong_key": ["0001"]}', None, '{"node_ids": "0001"}', '{"node_ids": [" 0001 "]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = [r[0] for r in df.orderBy("i").select(section_trees.chosen_nodes(F.col("r"), F.array(F.lit("0001"), F.lit("0002")))).collect()]
    assert got[:6] == [["0002", "0001"], ["0001"], [], [], [], []] and got[7] == ["0001"] and set(got[6]) <= {"0001"}


def test_names_and_prompts(spark):
    df = spark.createDataFrame([("04 PRAVACHAN.json",), ("a/b\\c:d*e.json",), ("x" * 500,)], "s string")
    assert [r[0] for r in df.select(section_trees.tree_name(F.col("s"))).collect()] == ["04_PRAVACHAN.json", "a_b_c_d_e.json", "x" * 120]
    sections = F.array(F.struct(F.lit("0001").alias("node_id"), F.lit(" Karma").alias("title"), F.lit("on action").alias("summary")))
    text = spark.range(1).select(section_trees.selection_prompt(F.lit("what is karma?"), F.lit(""), sections)).first()[0]
    assert "[0001] Karma — on action" in text and "what is karma?" in text and "node_ids" in text and "(no description)" in text


def test_search_goes_from_files_to_nodes_to_texts(spark, tmp_path):
    rows = [(f"f{i}", j, f"{i}{j}", text, float(j), j + 1.0, ["S"]) for i, texts in enumerate([["karma is action", "deep breath now"], ["breath and calm", "karma again"], ["nothing here", "karma karma"]]) for j, text in enumerate(texts)]
    section_trees.write(section_trees.build(spark.createDataFrame(rows, CHUNKS), 4), str(tmp_path / "t"))
    outlines, texts = section_trees.read(spark, str(tmp_path / "t"))
    q = spark.createDataFrame([(1, "karma breath"), (2, "unknown words"), (3, "karma")], "query_id long, text string")
    ranked = spark.createDataFrame([(1, "f1", 1), (1, "f0", 2), (1, "no tree", 3), (2, "f0", 1)], "query_id long, source_file string, place int")
    got = section_trees.search(outlines, texts, q, ranked).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in got if r.query_id == 1] == [(1, "f1#0001", 0.5), (1, "f1#0002", 0.5), (1, "f0#0001", 0.5), (1, "f0#0002", 0.5)]
    assert [r for r in got if r.query_id == 2] == [] and {r.source_file for r in got if r.query_id == 3} == {"f0", "f1", "f2"}  # no ranked file: the first with trees
    assert got[0].metadata["backend"] == "sections" and got[0].result_type == "chunk" and got[0].metadata["node_id"] == "0001"
    pinned = spark.createDataFrame([(1, "f2")], "query_id long, source_file string")
    asked = []
    reply = section_trees.search(outlines, texts, q.where("query_id = 1"), ranked, pinned, reasoner=lambda prompt: '{"node_ids": ["0002"]}')
    assert [(r.chunk_id, r.place) for r in reply.collect()] == [("f2#0002", 1)] and asked == []


def test_trees_from_json(spark, tmp_path):
    tree = {"source_file": "a.json", "model": "m", "chunk_count": 2, "doc_description": None, "nodes": [{"node_id": "0001", "title": "T", "start_sec": 0, "text": "x"}, {"node_id": "0002", "speakers": ["S"]}]}
    (tmp_path / "a.json").write_text(json.dumps(tree))
    (tmp_path / "bad.json").write_text('{"source_file": "b", "nodes": [')
    (tmp_path / "other.json").write_text('{"x": 1}')
    got = section_trees.from_json(spark, str(tmp_path)).orderBy("node_id").collect()
    assert [(r.source_file, r.node_id, r.title, r.text, r.speakers, r.doc_description) for r in got] == [("a.json", "0001", "T", "x", [], ""), ("a.json", "0002", "", "", ["S"], "")]


# --- vectors ---


def points(n=600, dim=16, seed=2, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (clusters, dim))
    return [(i, [float(x) for x in centres[i % clusters] + rng.normal(0, 0.15, dim)], i % 4) for i in range(n)]


def rows_of(df):
    return sorted((r.query_id, r.id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7])
def test_index_answers_like_a_scan(spark, tmp_path, k):
    odd = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [1.0, 2.0], 0), (9003, [float("nan")] * 16, 0), (9004, points()[5][1], 1), (9005, points()[5][1], 1)]
    v = spark.createDataFrame(points() + odd, "id long, vector array<double>, label int")
    q = v.where("id % 60 = 5").select(F.col("id").alias("query_id"), "vector")
    vector_index.build(v, str(tmp_path / "i"), ("label",), lists=16, sample=300)
    report = {}
    assert rows_of(vector_index.search(spark, str(tmp_path / "i"), q, k, report=report)) == rows_of(vectors.nearest(q, v, k))
    assert report["read"] < report["pairs"] / 2 and report["exact"] < report["pairs"] / 10
    few = vectors.nearest(q, v.where("label = 1 and id < 60"), k)
    assert rows_of(vector_index.search(spark, str(tmp_path / "i"), q, k, where="label = 1 and id < 60")) == rows_of(few)
    assert vector_index.search(spark, str(tmp_path / "i"), q.limit(0), k).count() == 0


def test_index_of_no_vectors(spark, tmp_path):
    v = spark.createDataFrame([(1, None)], "id long, vector array<double>")
    vector_index.build(v, str(tmp_path / "i"))
    assert vector_index.search(spark, str(tmp_path / "i"), spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 3).count() == 0


def test_bytes_hold_their_error():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(500, 24))
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    code, scale, error = vector_index.encode(unit)
    q = rng.normal(size=(50, 24))
    q /= np.sqrt((q * q).sum(1))[:, None]
    assert (np.abs(unit @ q.T - (code @ q.T) * scale[:, None]) <= error[:, None] + 1e-12).all()


def test_blocks_of_queries_and_ties(spark, monkeypatch):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, float(i + 1)]) for i in range(40)], "id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", [1.0, 0.1 * i]) for i in range(9)], "query_id string, vector array<double>")
    whole = [tuple(r) for r in vectors.nearest(q, v, 3).orderBy("query_id", "rank").collect()]
    assert [r[1] for r in whole[:3]] == [1, 3, 5]
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vectors, "SCORES", 16)
    assert [tuple(r) for r in vectors.nearest(q, v, 3).orderBy("query_id", "rank").collect()] == whole
    plan = vectors.nearest(q, v, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_lexical_nearest_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(0, 6)))) for i in range(50)] + [(50, None)], "id long, text string")
    q = spark.createDataFrame([(0, "w1 w2 w3"), (1, "none of these"), (2, ""), (3, None), (4, "W5")], "query_id long, text string")
    every = fulltext.ranked(texts.join(q.withColumnRenamed("text", "query")).select("query_id", "id", ranking.lexical_scorer(F.col("query"), F.col("text")).alias("score")), 5)
    assert rows_of(ranking.lexical_nearest(q, texts, 5)) == rows_of(every)


# --- stores and segments ---


def test_changes_are_seen_together(spark, tmp_path):
    s = Stores(spark, str(tmp_path / "s"), {"chunks": "source_file", "ledger": "key"})
    assert s.table("chunks") is None and s.delete(spark.createDataFrame([("a",)], "k string")) is False
    rows = lambda *x: spark.createDataFrame(list(x), "source_file string, n int")
    marks = lambda *x: spark.createDataFrame(list(x), "key string, status string")
    s.change({"chunks": rows(("a", 1), ("b", 2), ("b", 3)), "ledger": marks(("a", "ok"), ("b", "ok"))})
    now = lambda t: sorted(map(tuple, s.table(t).collect()))
    assert s.delete(spark.createDataFrame([("b",), (None,)], "k string"), {"ledger": marks(("b", "deleted"))}) is True
    assert now("chunks") == [("a", 1)] and now("ledger") == [("a", "ok"), ("b", "deleted")]
    s.change({"chunks": rows(("b", 9), ("a", 5))}, spark.createDataFrame([("a",)], "k string"), ("chunks",))
    assert now("chunks") == [("a", 5), ("b", 9)]
    s.compact("chunks")
    assert now("chunks") == [("a", 5), ("b", 9)] and now("ledger") == [("a", "ok"), ("b", "deleted")]
    assert s.delete(spark.createDataFrame([("zzz",)], "k string")) is False


def test_a_failed_change_leaves_the_old_state(spark, tmp_path):
    s = Stores(spark, str(tmp_path / "s"), {"one": "k", "two": "k"})
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    s.change({"one": df, "two": df})
    broken = spark.range(3).select(F.lit("b").alias("k"), F.raise_error(F.lit("disk is full")).cast("int").alias("n"))
    with pytest.raises(Exception, match="disk is full"):
        s.change({"one": spark.createDataFrame([("b", 2)], "k string, n int"), "two": broken}, spark.createDataFrame([("a",)], "k string"))
    assert [tuple(r) for r in s.table("one").collect()] == [("a", 1)] == [tuple(r) for r in s.table("two").collect()] and s.state()[0] == 1


def test_segments_equal_a_whole_index(spark, tmp_path):
    docs = [(i, f"w{i % 7} w{i % 3} common {'rare' if i == 4 else ''}", f"s{i % 5}") for i in range(60)] + [(60, None, "s1"), (61, "", "s2")]
    d = spark.createDataFrame(docs, "id long, text string, source_file string")
    q = spark.createDataFrame([(0, "w1 common"), (1, "rare w2"), (2, "absent")], "query_id long, text string")
    index = TextIndex(spark, str(tmp_path / "x"))
    assert index.bm25(q).count() == 0
    for i in range(3):
        index.add(d.where(F.col("id") % 3 == i))
    whole = lambda df: rows_of(fulltext.bm25(q, fulltext.postings(df, "id"), fulltext.corpus_stats(df), 8))
    assert rows_of(index.bm25(q, 8)) == whole(d)
    assert index.delete(spark.createDataFrame([("s1",)], "source_file string")) is True
    left = d.where("source_file <> 's1'")
    assert rows_of(index.bm25(q, 8)) == whole(left)
    new = spark.createDataFrame([(100, "w1 w1 common", "s2")], "id long, text string, source_file string")
    index.add(new, replace=True)
    left = left.where("source_file <> 's2'").unionByName(new)
    assert rows_of(index.bm25(q, 8)) == whole(left)
    index.compact()
    assert rows_of(index.bm25(q, 8)) == whole(left) and index.delete(spark.createDataFrame([("s1",)], "source_file string")) is False


def test_refresh_shuffles_no_texts(spark, tmp_path):
    """Keys and digests are compared; of a key that stands twice the smaller text counts."""
    import random

    from skein.operators import builds

    def shuffled():
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    rng = random.Random(5)
    rows = [(f"k{i}", f"{rng.getrandbits(160_000):x}") for i in range(200)] + [("k7", "0 smallest"), (None, "no key"), ("blank", " ")]
    df = spark.createDataFrame(rows, "source_file string, text string").repartition(4)
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    stores = Stores(spark, str(tmp_path / "stores"), {"t": "source_file"})
    before = shuffled()
    wrote = [builds.refresh(stores, "t", d, lambda x: x, prune=True) for d in (df, df, df.where("source_file <> 'k3'").withColumn("text", F.when(F.col("source_file") == "k9", "new").otherwise(F.col("text"))))]
    assert wrote == [200, 0, 1]
    assert shuffled() - before < 1_000_000
    held = {r.source_file: r.text for r in stores.table("t").collect()}
    assert len(held) == 199 and held["k7"] == "0 smallest" and held["k9"] == "new" and held["k8"] == dict(rows)["k8"]

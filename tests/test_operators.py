import pytest
from pyspark.sql import functions as F

from skein.operators import catalog, chunking, cleaning, corpus, filters, models, ranking, tables, understanding as U


def test_rrf_adds_overlap_and_orders_ties(spark):
    dense = spark.createDataFrame([("q", "a", 0), ("q", "b", 1)], "query_id string, id string, rank int")
    bm25 = spark.createDataFrame([("q", "b", 0)], "query_id string, id string, rank int")
    got = {r.id: r.score for r in ranking.rrf({"dense": dense, "bm25": bm25}, ranking.arm_weights(0.65)).collect()}
    assert got["b"] > got["a"] and abs(got["b"] - (0.35 / 62 + 0.65 / 61)) < 1e-7


def test_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "x double").withColumn("q", F.lit(1))
    assert [r.x for r in ranking.min_max(df, ["x"], "q").collect()] == [0.0, 1.0, 0.5]
    assert {r.x for r in ranking.min_max(df.withColumn("x", F.lit(2.0)), ["x"], "q").collect()} == {0.0}


def test_floor_is_strict(spark):
    df = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.4)], "query_id string, id int, score double")
    assert [r.id for r in ranking.above_floor(df, 0.5).collect()] == [1]
    assert ranking.above_floor(df, 0.5, abstain=True).count() == 0
    assert ranking.above_floor(df, 0).count() == 2


def test_tree_counts_files_in_all_folders(spark):
    rows = [("Dagshai 2002/Apr/1.json", 5, 10.0, None), ("Dagshai 2002/2.json", 3, 5.0, None), ("Dagshai 2002/Apr/x$_%.json", 4, None, None), ("loose.json", 1, 1.0, None)]
    df = spark.createDataFrame(rows, "source_file string, n_chunks long, duration_sec double, session_date date")
    top = {r.path: r for r in corpus.tree(df).collect()}
    assert top["Dagshai 2002"].n_files == 3 and top["Dagshai 2002"].n_chunks == 12 and not top["Dagshai 2002"].is_leaf
    assert top["loose.json"].failed == 1 and top["loose.json"].is_leaf
    assert corpus.tree(df, "Dagshai 200").count() == 0
    deep = {r.path: r for r in corpus.tree(df, "Dagshai 2002", 2).collect()}
    assert deep["Dagshai 2002/Apr"].n_files == 2 and "Dagshai 2002/Apr/x$_%.json" in deep


def test_sentence_plans_advance_and_cover():
    for sizes in ([10] * 200, [800, 10, 900, 20], [450] * 5, [1], []):
        plan = chunking.plan_sentences(sizes)
        assert {i for a, b in plan for i in range(a, b)} == set(range(len(sizes)))
        assert all(x[0] < y[0] for x, y in zip(plan, plan[1:], strict=False))


def test_segment_plans_cut_at_speakers_and_size():
    assert chunking.plan_segments([(300, "a"), (200, "a"), (100, "b")]) == [(0, 2), (2, 3)]
    assert chunking.plan_segments([(250, "a"), (500, "a"), (10, "a")]) == [(0, 1), (1, 3)]
    assert chunking.plan_segments([(900, None), (10, None)]) == [(0, 1), (1, 2)]
    assert all(len(p.split()) <= chunking.WINDOW for p in chunking.split_long("w " * 2000))


def test_sections_pack(spark):
    rows = [("f", i, f"c{i}", "x" * n, float(i), float(i + 1)) for i, n in enumerate([4000, 4000, 4000, 4000, 4000])]
    df = spark.createDataFrame(rows, "source_file string, idx int, chunk_id string, text string, start_sec double, end_sec double")
    assert sorted((r.section, r.n_chunks) for r in chunking.sections(df, 2000).collect()) == [(0, 2), (1, 2), (2, 1)]


def _segments(*texts):
    return [{"text": t, "start": float(i), "end": i + 1.0, "speaker": f"S{i}"} for i, t in enumerate(texts)]


def _texts(found):
    return [s["text"] for s in found]


def test_alignment_keeps_times_and_places_each_word_once():
    out = cleaning.align(_segments("a b c d", "e f g", "h i"), "A b c x d e g h i j")
    assert " ".join(_texts(out)).split() == "A b c x d e g h i j".split() and [s["speaker"] for s in out] == ["S0", "S1", "S2"]
    raw = _segments("hello world", "foo bar baz")
    assert cleaning.align(raw, "hello world foo bar baz") == raw
    assert _texts(cleaning.align(_segments("medishan ise muhabbat", "apne aapse mulakat"), "meditation ise muhabbat apne aapse mulakat")) == ["meditation ise muhabbat", "apne aapse mulakat"]
    assert _texts(cleaning.align(_segments("मेडिशन इसे", "मुहब्बत"), "मेडिटेशन इसे मुहब्बत")) == ["मेडिटेशन इसे", "मुहब्बत"]
    assert " ".join(_texts(cleaning.align(_segments("a b c d", "e f g h"), "a b c e f g h"))) == "a b c e f g h"


def test_alignment_of_deleted_new_and_missing_words():
    out = cleaning.align(_segments("alpha beta", "noise noise", "gamma"), "alpha beta gamma")
    assert _texts(out) == ["alpha beta", "gamma"] and [s["start"] for s in out] == [0.0, 2.0]
    assert _texts(cleaning.align(_segments("", "one two"), "new one two")) == ["new", "one two"]  # before any match: the first segment, blank or not
    assert _texts(cleaning.align(_segments("one two", "three four"), "one two extra three four")) == ["one two extra", "three four"]
    assert cleaning.align([], "anything") == [] and cleaning.align(_segments(" ", None), "anything") == []
    assert [(s["text"], s["start"]) for s in cleaning.align(_segments(" keep this ", "  "), " ")] == [("keep this", 0.0)]


def test_alignment_against_plain_edits():
    import random

    rng = random.Random(4)
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 30))]
        b = [w for w in a if rng.random() > 0.2] + [rng.choice("xyz") for _ in range(rng.randint(0, 3))]
        made, at, to = [], 0, 0
        for op, i, k, j, m in cleaning.edits(a, b):
            assert (i, j) == (at, to) and (op != "equal" or a[i:k] == b[j:m])
            made, at, to = made + b[j:m], k, m
        assert made == b and (at, to) == (len(a), len(b))
        assert " ".join(_texts(cleaning.align(_segments(" ".join(a[:7]), " ".join(a[7:])), " ".join(b)))) == " ".join(b) or not b


def test_alignment_of_a_long_file_is_quick(spark):
    import time

    words = [f"w{i % 5000}" if i % 3 else "the" for i in range(60_000)]
    segments = _segments(*(" ".join(words[i : i + 20]) for i in range(0, len(words), 20)))
    cleaned = " ".join(w.upper() if i % 50 == 0 else w for i, w in enumerate(words) if i % 97)
    began = time.time()
    out = cleaning.align(segments, cleaned)
    assert " ".join(_texts(out)) == cleaned and time.time() - began < 30
    df = spark.createDataFrame([("f", segments[:3], " ".join(words[:60])), ("g", None, "x"), ("h", segments[:2], None)], "source_file string, segments array<struct<text:string,start:double,end:double,speaker:string>>, cleaned string")
    got = {r.source_file: r.segments for r in cleaning.aligned(df).collect()}
    assert [s.text for s in got["f"]] == _texts(segments[:3]) and got["g"] == [] and [s.end for s in got["h"]] == [1.0, 2.0]


def test_skeletons_meet(spark):
    df = spark.createDataFrame([("सिंग", "सिंह"), ("पूर्ण", "पूरन")], "a string, b string")
    assert all(r.x == r.y for r in df.select(cleaning.skeleton(F.col("a")).alias("x"), cleaning.skeleton(F.col("b")).alias("y")).collect())


def test_entity_grams_and_proposals(spark):
    df = spark.createDataFrame([("यह पूरन सिंह बोले".split(),)], "t array<string>")
    assert df.select(cleaning.entity_grams(F.col("t"), ["सिंह"], ["यह"])).first()[0] == ["पूरन सिंह"]
    s = spark.createDataFrame([("k", "good", 20), ("k", "bad", 3), ("k", "near", 8)], "key string, phrase string, count long")
    assert [(r.variant, r.canonical) for r in cleaning.proposals(s).collect()] == [("bad", "good")]


def test_optional_key_binds_only_where_given(spark):
    left = spark.createDataFrame([(1, 1), (1, 2)], "d int, seq int")
    right = spark.createDataFrame([(1, None, "all"), (1, 2, "two")], "d int, seq int, v string")
    got = tables.enrich_optional(left, right, ["d"], "seq")
    assert sorted((r.seq, r.v) for r in got.collect()) == [(1, "all"), (2, "all"), (2, "two")]


def test_insert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "x")], "k int, v string")
    new = spark.createDataFrame([(1, "y"), (2, "a"), (2, "b")], "k int, v string")
    once = tables.insert_absent(old, new, ["k"], [F.col("v")])
    twice = tables.insert_absent(once, new, ["k"], [F.col("v")])
    assert sorted(map(tuple, twice.collect())) == [(1, "x"), (2, "a")]


def test_filters_ignore_empty_values(spark):
    assert filters.predicate(filters.Filters()) is None
    f = filters.Filters(topics="rain", year=2010).merged({"season": "winter", "topics": ["sun"]})
    assert f.topics == ["rain"] and f.season == "winter" and f.date_range == ("2010-01-01", "2010-12-31")


def test_lost_dates_stop_a_backfill(spark):
    df = spark.createDataFrame([("2020-01-01",)], "d string").select(F.to_date("d").alias("d"))
    with pytest.raises(Exception, match="dates would be lost"):
        tables.date_changes(df, "d", F.lit(None).cast("date")).collect()
    assert tables.date_changes(df, "d", F.lit(None).cast("date"), allow_loss=True).first().lost == 1


@pytest.mark.parametrize(("query", "want"), [("how many discourses mention Nanak", "analytic"), ("puran singh ke baare mein", "name"), ("", "thematic"), ("hi hello what you can do", "chitchat"), ("hellooo ji", "chitchat"), ("who is Kabir", "name"), ("ध्यान कैसे करें", "thematic"),
    *((q, "chitchat") for q in ("ok", "gm", "nice", "ram ram", "Radhe radhe!", "sat sri akal", "jai guru", "kripya help", "Namaste 🙏", "namaste, ji!", "कैसे हैं आप", "hii hello ji", "are you there", "hi what can you do for me", "क्या आप मदद कर सकते हैं", "thanks ji")),
    *((q, "name") for q in ("who was Swami Rama Tirtha and what did he teach", "rama tirtha", "swami ji ne puran singh ke bare me kya kaha", "chetan vishwas ki katha", "पुरन सिंह के बारे में स्वामी जी ने क्या कहा है", "आशीष जी के बारे में", "नामदेव की कथा स्वामी जी ने कहाँ सुनाई है", "can you tell me about kabir")),
    *((q, "thematic") for q in ("वैराग्य जी", "karuna vairagya ke baare mein", "dhyan ke baare mein kya kaha", "prem aur bhakti ke bare me", "क्रोध के बारे में स्वामी जी ने क्या कहा है", "ध्यान कैसे करना चाहिए स्वामी जी", "what is dhyan", "tell me more", "hi swami ji ne kya kaha", "how are thoughts stilled in meditation", "   ")),
    ("नामदेव का ज़िक्र कितने प्रवचनों में है", "analytic"), ("स्वामी जी ने कितनी बार पुरन सिंह का ज़िक्र किया है", "analytic")])
def test_router(spark, query, want):
    assert spark.createDataFrame([(query,)], "q string").select(U.router_class(F.col("q"))).first()[0] == want


@pytest.mark.parametrize(("query", "listed", "best"), [("10 sitting for rain", 10, None), ("500 sittings", 50, None), ("what is rain", None, None), ("top 5 sittings about rain", None, 5), ("best way to meditate", None, None)])
def test_intents(spark, query, listed, best):
    row = spark.createDataFrame([(query,)], "q string").select(U.list_count(F.col("q")), U.best_count(F.col("q"))).first()
    assert row[1] == best and (best or row[0] == listed)


@pytest.mark.parametrize(("query", "want"), [("from 2015", ("2015-01-01", "2015-12-31")), ("2010 and 2014", ("2010-01-01", "2014-12-31")), ("2015-13-40", None), ("20155", None)])
def test_dates_in_queries(spark, query, want):
    d = spark.createDataFrame([(query,)], "q string").select(U.date_signal(F.col("q"))).first()[0]
    assert (tuple(d) if d else None) == want


def test_vocabulary(spark):
    q = spark.createDataFrame([(1, "on karma yoga in wintergreen qa")], "query_id int, text string")
    v = spark.createDataFrame([("topics", "karma-yoga"), ("season", "winter"), ("track_type", "qa")], "field string, value string")
    assert [r.value for r in U.vocabulary_signals(q, v).collect()] == ["karma-yoga"]


@pytest.mark.parametrize(("cell", "year", "want"), [("16 APR - 3$ - 630 AM", 2005, ("2005-04-16", 3, "06:30")), ("16 Nov - 8 PM", 1995, ("1995-11-16", None, "20:00")), ("1$", 1995, (None, 1, None)), ("30 FEB - 1$ - 8 AM", 2001, (None, 1, "08:00"))])
def test_sitting_cells(spark, cell, year, want):
    s = spark.createDataFrame([(cell, year)], "c string, y int").select(catalog.sitting_cell(F.col("c"), F.col("y"))).first()[0]
    assert (s.session_date and str(s.session_date), s.session_seq, s.session_time) == want


def test_tags_are_checked_and_capped(spark):
    raw = 'Here: {"event_type":"party","primary_language":"hindi","topics":["a","A","b"],"summary_english":"x"} ok'
    t = spark.createDataFrame([(raw,), ("none",)], "r string").select(models.parsed_tags(F.col("r")).alias("t")).select("t", models.tag_errors(F.col("t")).alias("e")).collect()
    assert t[0].t.topics == ["a", "b"] and "event_type" in t[0].e and t[1].t is None and "no object" in t[1].e


def test_groundedness_fails_open(spark):
    df = spark.createDataFrame([("One. Two.", [True, False]), ("One. Two.", [False, False]), ("One. Two.", None)], "a string, v array<boolean>")
    assert [r[0] for r in df.select(models.grounded(F.col("a"), F.col("v"))).collect()] == ["One.", "One. Two.", "One. Two."]


def test_event_spans(spark):
    from skein.functions import dates

    cases = [
        ("17 NEW YEAR DELHI 30 DEC - 1 JAN 2012", None, (17, "NEW YEAR DELHI", "2011-12-30", "2012-01-01", None)),
        ("DAGSHAI 10 - 13 JUNE CHILDREN CAMP", 2009, (None, "DAGSHAI", "2009-06-10", "2009-06-13", None)),
        ("DAGSHAI 10 - 13 JUNE CHILDREN CAMP", None, (None, "DAGSHAI", None, None, "no year")),
        ("3 Delhi 29 Feb - 2 March 2012", None, (3, "DELHI", "2012-02-29", "2012-03-02", None)),
        ("Delhi 31 June - 2 July 2012", None, (None, "DELHI", None, None, "bad date")),
        ("Delhi 5 May 2012 - 2 May 2012", None, (None, "DELHI", "2012-05-05", "2012-05-02", "start after end")),
        ("no event", 2012, None),
    ]
    df = spark.createDataFrame([(i, n, y) for i, (n, y, _) in enumerate(cases)], "i int, n string, y int").select("i", dates.event_span(F.col("n"), F.col("y")).alias("s"))
    for r in df.collect():
        want = cases[r.i][2]
        assert (r.s and (r.s.seq, r.s.location, r.s.start and str(r.s.start), r.s.end and str(r.s.end), r.s.warning)) == want, cases[r.i]


def test_cells_go_through_python_in_short_batches(spark):
    from skein.operators import cleaning

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    try:
        spark.conf.set(rows, "10000")
        df = spark.createDataFrame([(" plain_x000D_ ",), ("été",), ("NaN",), (None,), ("",)], "c string")
        got = [r.c for r in cleaning.clean_cells(df, ["c"]).collect()]
        assert got == ["plain", "été", None, None, None]
        assert int(spark.conf.get(rows)) <= 256
    finally:
        spark.conf.set(rows, before)

"""What a reranker reads of catalog rows."""

from skein.operators import sittings

CATALOG = "id long, source_type string, kind string, text string, sitting_key string, track_title string, track_type string, location string, session_date string, season string, performers array<string>"


def test_titles_are_told_with_their_sittings(spark):
    rows = [
        (1, "catalog", "track_title", "[Catalog]", "s1", "Song", "bhajan", "NOIDA", "2010-01-07", "winter", ["A", "B"]), (2, "catalog", "sitting_detail", "near", "s1", None, None, None, None, None, None),
        (3, "catalog", "sitting_detail", "far", "s1", None, None, None, None, None, None), (4, "catalog", "track_title", "[Catalog] two", "s2", "Talk", None, "", None, None, []),
        (5, "catalog", "sitting_detail", "", "s2", None, None, None, None, None, None), (6, "catalog", "track_title", "no title", "s1", None, None, None, None, None, None),
        (7, "transcript", "track_title", "a chunk", "s1", "x", None, None, None, None, None), (8, None, None, None, None, None, None, None, None, None, None), (9, "catalog", "track_title", "t", None, "Many", "x", None, None, None, list("abcdefghij")),
    ]
    catalog = spark.createDataFrame(rows, CATALOG)
    pool = spark.createDataFrame([(1, i) for i in (1, 2, 4, 6, 7, 8, 9)] + [(2, 1)], "query_id long, id long")
    got = {(r.query_id, r.id): r.read for r in sittings.rerank_texts(pool, catalog).collect()}
    told = "bhajan: Song, at NOIDA on 2010-01-07 during winter season performed by A, B"
    assert got == {(1, 1): f"{told}. near", (2, 1): f"{told}. near\nfar", (1, 2): "near", (1, 4): "track: Talk", (1, 6): "no title", (1, 7): "a chunk", (1, 8): "", (1, 9): "x: Many, performed by a, b, c, d, e, f, g, h"}


def test_order_and_degraded_answers(spark):
    catalog = spark.createDataFrame([(i, "transcript", None, t, None, None, None, None, None, None, None) for i, t in enumerate(["a b", "a", "b a", "c", "d", "e"])], CATALOG)
    pool = spark.createDataFrame([(1, i, 1.0 - i / 10, i + 1) for i in range(6)], "query_id long, id long, score double, place int")
    q = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert [(r.id, r.score) for r in sittings.rerank(pool, q, catalog, 3).orderBy("place").collect()] == [(0, 1.0), (2, 1.0), (1, 0.5)]
    assert [r.id for r in sittings.rerank(pool, q, catalog, 2, None).orderBy("place").collect()] == [0, 1, 2, 3]

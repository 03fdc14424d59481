"""Folders read by their shapes."""

import datetime as dt

from pyspark.sql import functions as F

from skein.functions import dates
from skein.operators import paths, understanding

BASE = "/mnt/audio"
CAMP = f"{BASE}/Live Masters 2010/01 NOIDA 7 - 10 JAN 2010"


def read(spark, *names, base=BASE):
    rows = paths.parse(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, path string"), base=base).orderBy("i").collect()
    return [r.facts for r in rows]


def test_whole_path(spark):
    (m,) = read(spark, f"{CAMP}/7 JAN - 1$ - 6 PM/04 PRAVACHAN.wav")
    assert (m.collection, m.year, m.event_seq, m.event_id, m.location) == ("Live Masters", 2010, 1, "01 NOIDA 7 - 10 JAN 2010", "NOIDA")
    assert (m.event_start, m.event_end, m.session_date, m.session_seq, m.session_time) == (dt.date(2010, 1, 7), dt.date(2010, 1, 10), dt.date(2010, 1, 7), 1, "18:00")
    assert (m.track_no, m.track_title, m.track_type, m.season, m.primary_speaker, m.parse_warnings) == (4, "PRAVACHAN", "discourse", "winter", "Swami ji", [])
    (n,) = read(spark, f"{CAMP}/7 JAN - 1$ - 6 PM/04 PRAVACHAN.wav", base=None)
    assert n.location == "NOIDA" and n.session_date == m.session_date and any("folder" in w for w in n.parse_warnings)


def test_what_pipelines_add_is_left_out(spark):
    camp = f"{BASE}/Live Masters 2010_isolation/01 NOIDA 7 - 10 JAN 2010_isolation"
    a, b, c, d = read(
        spark, f"{camp}/7 JAN - 1$ - 6 PM_isolation/04 PRAVACHAN_model-1_mel/turbo/04 PRAVACHAN.json", f"{camp}/10 JAN - 6$ - 1030 AM_isolation/06 X_model-1/turbo/06 SAMBODHAN.json",
        f"{camp}/8 JAN - 3$ - 930 AM_isolation/04 PRAVACHAN.json", f"{BASE}/03 PRAVACHAN IN MEDITATION_model-1/turbo/03 PRAVACHAN IN MEDITATION.json",
    )
    assert a.event_id == "01 NOIDA 7 - 10 JAN 2010" and a.parse_warnings == [] and b.session_time == "10:30" and b.session_seq == 6 and c.session_time == "09:30"
    assert (d.track_no, d.track_type, d.collection, d.event_id, d.session_date) == (3, "combined", None, None, None)


SESSIONS = [
    ("8 JAN - 1$ - 12 PM", (2010, 1, 8), 1, "12:00"), ("8 JAN - 1$ - 12 AM", (2010, 1, 8), 1, "00:00"), ("8 JAN 12 NOON", (2010, 1, 8), None, "12:00"), ("9 JAN-2$-12 NOON", (2010, 1, 9), 2, "12:00"),
    ("10 JAN - 6 PM (CASS REC)", (2010, 1, 10), None, "18:00"), ("8 JAN - NO TIME", (2010, 1, 8), None, None), ("8 JAN MORNING", (2010, 1, 8), None, None), ("08 January", (2010, 1, 8), None, None),
    ("8 JAN - LOHRI CELEBRATION $", (2010, 1, 8), None, None), ("8 JAN - 1$ - 25 PM", (2010, 1, 8), 1, None), ("25 JAN - 1$ - 6 PM", (2010, 1, 25), 1, "18:00"), ("32 JAN - 1$ - 6 PM", None, 1, "18:00"), ("8 ABC - 1$ - 6 PM", None, None, None),
]


def test_sessions(spark):
    for m, (folder, date, seq, time) in zip(read(spark, *(f"{CAMP}/{s[0]}/04 PRAVACHAN.wav" for s in SESSIONS)), SESSIONS, strict=True):
        assert (m.session_date, m.session_seq, m.session_time) == (date and dt.date(*date), seq, time), folder
        assert bool(m.parse_warnings) == (folder[:2] == "32" or "25 PM" in folder or "ABC" in folder), folder


EVENTS = [
    ("Dagshai 2001/DAGSHAI 15 - 19 JAN 2001", "DAGSHAI", (2001, 1, 15), (2001, 1, 19)), ("Dagshai 2001/DAGSHAI 10 - 13 JUNE CHILDREN CAMP", "DAGSHAI", (2001, 6, 10), (2001, 6, 13)),
    ("Live Masters 2013/08 BATHINDA 30 NOV - 2 DEC 2013", "BATHINDA", (2013, 11, 30), (2013, 12, 2)), ("Live Masters 2014/08 CHHATTARPUR  DELHI 30 DEC 2014 - 1 JAN 2015", "CHHATTARPUR DELHI", (2014, 12, 30), (2015, 1, 1)),
    ("Live Masters 2012/17 NEW YEAR DELHI 30 DEC - 1 JAN 2012", "NEW YEAR DELHI", (2011, 12, 30), (2012, 1, 1)), ("01 JAN - 2001/DAGSHAI 15 - 19 JAN", "DAGSHAI", (2001, 1, 15), (2001, 1, 19)),
    ("DAGSHAI 15 - 19 JAN", "DAGSHAI", None, None), ("X 2001/DAGSHAI 30 - 31 FEB", "DAGSHAI", None, None), ("X 2001/DAGSHAI 19 JAN 2002 - 3 JAN 2001", "DAGSHAI", (2002, 1, 19), (2001, 1, 3)), ("X 2001/DAGSHAI 1 - 3 XYZ 2001", None, None, None),
]


def test_events(spark):
    for m, (folders, location, start, end) in zip(read(spark, *(f"{BASE}/{e[0]}/15 JAN/01 A.wav" for e in EVENTS)), EVENTS, strict=True):
        assert (m.location, m.event_start, m.event_end) == (location, start and dt.date(*start), end and dt.date(*end)), folders


def test_sessions_take_their_year_from_the_event(spark):
    new_year = f"{BASE}/Live Masters 2014/08 DELHI 30 DEC 2014 - 1 JAN 2015"
    a, b, c, d = read(spark, f"{new_year}/1 JAN - 6 PM/1 A.wav", f"{new_year}/31 DEC/1 A.wav", f"{new_year}/5 MAR/1 A.wav", f"{BASE}/Live Masters 2010/JUNK FOLDER NAME/7 JAN/1 A.wav")
    assert [x.session_date for x in (a, b, c, d)] == [dt.date(2015, 1, 1), dt.date(2014, 12, 31), dt.date(2014, 3, 5), dt.date(2010, 1, 7)]
    assert d.event_id is None and any("event" in w for w in d.parse_warnings) and c.season == "summer"
    day = lambda *x: F.lit(dt.date(*x))
    got = spark.range(1).select(
        dates.year_in_span(F.lit(3), F.lit(5), day(2014, 12, 30), day(2015, 1, 1)).alias("a"), dates.year_in_span(F.lit(3), F.lit(5), day(2014, 12, 30), F.lit(None).cast("date")).alias("b"), dates.year_in_span(F.lit(1), F.lit(1), day(2014, 12, 30), day(2015, 1, 1)).alias("c")
    ).first()
    assert tuple(got) == (dt.date(2014, 3, 5), dt.date(2014, 3, 5), dt.date(2015, 1, 1))


def test_deepest_folder_counts_and_nothing_raises(spark):
    a, *rest = read(spark, f"{BASE}/A 2001/B 2002/01 X 1 - 3 MAR 2001/02 Y 4 - 6 APR/5 APR/01 T.wav", "", None, "/", "//", "file_name_with_no_number.wav", "a/b/04 PRAVACHAN", ".hidden")
    assert (a.collection, a.year, a.location, a.event_start, a.session_date) == ("B", 2002, "Y", dt.date(2002, 4, 4), dt.date(2002, 4, 5))
    assert all(r.parse_warnings and r.primary_speaker == "Swami ji" for r in rest)
    assert [r.track_title for r in rest] == [None, None, None, None, "file_name_with_no_number", "PRAVACHAN", ".hidden"]


TITLES = [
    ("discourse", ["PRAVACHAN", "  Pravachan  ", "PRAVACHAN (ZINDAGI KA SAFAR)", "PRAVACHAN - THIRD STAGE"]), ("address", ["SAMBODHAN", "SAMBODHAN - RISHI JI", "SAMBODHAN (2)"]), ("music", ["ENTRY MUSIC", "RETURN MUSIC"]),
    ("meditation", ["MEDITATION (WITHOUT OM)", "MEDITATION - ONLY OM", "MEDITATION 3"]), ("invocation", ["Om   Guruve   Namah", "OM GURUVE NAMAH (INCOMPLETE)"]), ("qa", ["QUESTION 1", "QUES-01", "QUESTION 14 & CHAL MERE DIL"]),
    ("session", ["COMPLETE SITTING", "WELCOME SITTING (ONLY VOICE)"]), ("combined", ["SAMBODHAN & PRAVACHAN", "SAMBODHAN&PRAVACHAN", "MEDITATION & PRAVACHAN"]),
    ("bhajan", ["NA HARA HAI ISHQ", "BHAJAN INTRO", "अमृत वाणी", "MEDITATION KI MASTIYON MEIN", "MERI SHAM MEDITATION MEIN", "STANDING MEDITATION", "RUHANI GEET & SAMBODHAN", ""]),
]


def test_title_types(spark):
    df = spark.createDataFrame([(kind, t) for kind, titles in TITLES for t in titles], "kind string, t string")
    assert df.where(paths.title_type(F.col("t")) != F.col("kind")).collect() == []


def test_speakers_and_headers(spark):
    df = spark.createDataFrame([("SAMBODHAN - RISHI JI",), ("SAMBODHAN BY RISHIJI",), ("SAMBODHAN - SWAMI JI & RISHI JI",), ("PRAVACHAN",), (None,)], "t string")
    assert [r[0] for r in df.select(paths.speaker(F.col("t"))).collect()] == ["Rishi ji", "Rishi ji", "Swami ji", "Swami ji", "Swami ji"]
    d = paths.parse(spark.createDataFrame([(f"{CAMP}/7 JAN - 1$ - 6 PM/04 PRAVACHAN.wav",), (None,)], "path string"), base=BASE)
    a, b = (r[0] for r in d.select(paths.header_fragment(F.col("facts"))).collect())
    assert a == "Event: 01 NOIDA 7 - 10 JAN 2010 | Date: 2010-01-07 | Time: 18:00 | Track: PRAVACHAN | Type: discourse | Season: winter" and b == ""


def test_bare_endings_are_names(spark):
    df = spark.createDataFrame([("दास",), ("देव",), ("तीर्थ की बात",), ("ध्यान क्या है",)], "q string")
    assert [r[0] for r in df.select(understanding.router_class(F.col("q"))).collect()] == ["name", "name", "name", "thematic"]

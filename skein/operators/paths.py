"""Metadata from a file's folders. Each folder is known by its shape (event, month bucket, collection, session); of several of one kind the deepest counts;
kinds are read in a fixed order, since a session takes its year from the event, and the event from the collection. Nothing raises: what cannot be read is null, and a warning says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import month_number, season
from ..functions.text import bound

# Shapes of folders and files, what pipelines add to names, speakers, and title words with their types.
EVENT = r"^(?:(\d{1,3})\s+)?([A-Za-z][^\d]*?)\s+(\d{1,2})(?:\s+([A-Za-z]{3,}))?(?:\s+(\d{4}))?\s*-\s*(\d{1,2})\s+([A-Za-z]{3,})(?:\s+(\d{4}))?(?:\s+(\S.*))?$"
MONTH_BUCKET = r"^\d{1,2}\s+([A-Za-z]{3,})\s*-\s*(\d{4})$"
COLLECTION = r"^([A-Za-z][^\d]*?)\s+(\d{4})$"
SESSION = r"^(\d{1,2})\s+([A-Za-z]{3,})\b(.*)$"
SEQUENCE = r"(?:^|[-\s])(\d{1,2})\s*\$"
CLOCK = r"(?i)\b(\d{1,4})(?::(\d{2}))?\s*(AM|PM)\b"
NOON = r"(?i)\bNOON\b"
TRACK = r"^(\d+)\s+(.+?)$"
ADDED, MODEL_FOLDER, SCAFFOLDS = r"(_isolation|_model-.*)$", "_model-", ("turbo",)
SPEAKER, SECOND_SPEAKER = "Swami ji", "Rishi ji"
TITLE_TYPES = {"PRAVACHAN": "discourse", "SAMBODHAN": "address", "MEDITATION": "meditation", "OM GURUVE NAMAH": "invocation", "ENTRY MUSIC": "music", "RETURN MUSIC": "music"}
SONG = "bhajan"


def _part(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _plain(title: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " ")))


def title_type(title: Column) -> Column:
    """qa for questions, session for sittings, combined where two types are named, the type of a word that the title begins with, else a song.

    A word counts as a beginning where the title ends after it, or goes on with a bracket, a dash or a number alone."""
    t = _plain(title)
    named = F.array_distinct(F.filter(F.array(*[F.when(t.rlike(rf"\b{word}\b"), kind) for word, kind in TITLE_TYPES.items()]), lambda x: x.isNotNull()))
    out = F.when(t.startswith("QUES"), "qa").when(t.contains("SITTING"), "session").when(F.size(named) > 1, "combined")
    for word, kind in TITLE_TYPES.items():
        out = out.when(t.rlike(rf"^{word}\s*($|[(\-]|\d+\s*$)"), kind)
    return out.otherwise(SONG)


def speaker(title: Column) -> Column:
    """The second speaker where a title names them alone, else the first."""
    t = _plain(title)
    return F.when(t.rlike(r"\bRISHI\s*JI\b") & ~t.rlike(r"\bSWAMI\s*JI\b"), SECOND_SPEAKER).otherwise(SPEAKER)


def folder_kind(name: Column) -> Column:
    """event, month_bucket, collection or session, the first whose shape fits; null for other folders. Words in a month's place must be months."""
    month = lambda pattern, i: month_number(F.regexp_extract(name, pattern, i)).isNotNull()
    first = F.regexp_extract(name, EVENT, 4)
    return (
        F.when(name.rlike(EVENT) & month(EVENT, 7) & ((first == "") | month_number(first).isNotNull()), "event").when(name.rlike(MONTH_BUCKET) & month(MONTH_BUCKET, 1), "month_bucket")
        .when(name.rlike(COLLECTION), "collection").when(name.rlike(SESSION) & month(SESSION, 2), "session")
    )


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def session_year(month: Column, day: Column, start: Column, end: Column, otherwise: Column) -> Column:
    """The year of an event's first or last day that puts a day inside the event; the first's where neither does; without an event another year."""
    inside = lambda y: _day(y, month, day).between(start, end)
    return F.when(start.isNull(), otherwise).when(end.isNotNull() & ~F.coalesce(inside(F.year(start)), F.lit(False)) & F.coalesce(inside(F.year(end)), F.lit(False)), F.year(end)).otherwise(F.year(start))


def _clock(rest: Column) -> Column:
    """(time, bad): HH:mm of '6 PM', '10:30 AM', '930 AM' or NOON; bad where hours or minutes do not exist."""
    digits, after, half = (_part(rest, CLOCK, i) for i in (1, 2, 3))
    joined = F.length(digits) >= 3
    hour = F.when(joined, F.substring(digits, F.lit(1), F.length(digits) - 2)).otherwise(digits).cast("int")
    minute = F.when(joined, F.substring(digits, -2, 2)).otherwise(F.coalesce(after, F.lit("0"))).cast("int")
    good = hour.between(1, 12) & (minute < 60)
    time = F.when(digits.isNotNull(), F.when(good, F.format_string("%02d:%02d", hour % 12 + F.when(F.upper(half) == "PM", 12).otherwise(0), minute))).when(rest.rlike(NOON), F.lit("12:00"))
    return F.struct(time.alias("time"), (digits.isNotNull() & ~F.coalesce(good, F.lit(False))).alias("bad"))


def parse(df: DataFrame, path: str = "path", base: str | None = None) -> DataFrame:
    """df with a struct `facts` of its path column: collection, year, event_seq, event_id, location, event_start, event_end, session_date, session_seq,
    session_time, track_no, track_title, track_type, season, primary_speaker, parse_warnings, source_path. A base folder is left out. Steps are columns of
    one projection after another, so that each is computed once."""
    whole = F.coalesce(F.col(path), F.lit(""))
    below = F.when(whole.startswith(base.rstrip("/") + "/"), F.substring(whole, len(base.rstrip("/")) + 2, 1 << 30)).otherwise(whole) if base else whole
    names = F.filter(F.split(below, "/"), lambda x: (x != "") & (x != "."))
    d = df.withColumn("_names", names).withColumn("_file", F.when(F.size("_names") > 0, F.element_at("_names", -1)))
    kept = F.filter(F.slice("_names", 1, F.greatest(F.size("_names") - 1, F.lit(0))), lambda x: ~x.isin(*SCAFFOLDS) & ~x.contains(MODEL_FOLDER))
    d = d.withColumn("_folders", F.transform(kept, lambda x: bound(F.trim(F.regexp_replace(x, ADDED, "")), lambda n: F.struct(n.alias("name"), folder_kind(n).alias("kind")))))
    deepest = lambda kind: F.get(F.reverse(F.filter("_folders", lambda f: f["kind"] == kind)), F.lit(0))["name"]
    d = d.withColumns({f"_{k}": deepest(k) for k in ("collection", "month_bucket", "event", "session")})
    year = F.coalesce(_part(F.col("_collection"), COLLECTION, 2), _part(F.col("_month_bucket"), MONTH_BUCKET, 2)).cast("int")
    event = lambda i: _part(F.col("_event"), EVENT, i)
    d = d.withColumns({
        "_year": year, "_d1": event(3).cast("int"), "_d2": event(6).cast("int"), "_m2": month_number(event(7)), "_m1": month_number(F.coalesce(event(4), event(7))), "_y1": event(5).cast("int"),
        "_day": _part(F.col("_session"), SESSION, 1).cast("int"), "_month": month_number(_part(F.col("_session"), SESSION, 2)), "_rest": F.regexp_extract("_session", SESSION, 3),
        "_stem": F.trim(F.coalesce(_part(F.col("_file"), r"(?s)^(.+)\.[^.]+$", 1), F.col("_file"))),
    })
    d = d.withColumn("_y2", F.coalesce(event(8).cast("int"), F.col("_year")))
    one, own = F.coalesce("_y1", "_y2"), F.col("_y1").isNotNull()
    d = d.withColumn("_start", F.when(F.col("_y2").isNotNull(), _day(one, F.col("_m1"), F.col("_d1")))).withColumn("_end", F.when(F.col("_y2").isNotNull(), _day(F.col("_y2"), F.col("_m2"), F.col("_d2"))))
    whole_span = F.col("_start").isNotNull() & F.col("_end").isNotNull()
    turned = whole_span & (F.col("_start") > F.col("_end"))
    before = _day(one - 1, F.col("_m1"), F.col("_d1"))
    d = d.withColumn("_turned", turned).withColumn("_first", F.when(whole_span, F.when(turned & ~own, before).otherwise(F.col("_start")))).withColumn("_last", F.when(whole_span & F.col("_first").isNotNull(), F.col("_end")))
    d = d.withColumn("_sy", session_year(F.col("_month"), F.col("_day"), F.col("_first"), F.col("_last"), F.col("_year"))).withColumn("_date", _day(F.col("_sy"), F.col("_month"), F.col("_day"))).withColumn("_clock", _clock(F.col("_rest")))
    numbered = F.col("_stem").rlike(TRACK)
    title = F.when(numbered, F.trim(F.regexp_extract("_stem", TRACK, 2))).otherwise(F.nullif(F.col("_stem"), F.lit("")))
    d = d.withColumn("_title", title).withColumn("_no", F.when(numbered, F.expr(f"try_cast(regexp_extract(_stem, r'{TRACK}', 1) as int)")))
    missing = [F.when(F.col(f"_{k}").isNull(), F.lit(f"{k}: no folder of this kind")) for k in ("collection", "event", "session")]
    quoted = lambda words, c: F.concat(F.lit(words + " '"), F.col(c), F.lit("'"))
    has_event, has_session = F.col("_event").isNotNull(), F.col("_session").isNotNull()
    told = F.concat(
        F.transform(F.filter("_folders", lambda f: f["kind"].isNull()), lambda f: F.concat(F.lit("folder: of no known kind '"), f["name"], F.lit("'"))),
        F.array(
            missing[0], missing[1], F.when(has_event & F.col("_y2").isNull(), quoted("event: no year for", "_event")), F.when(has_event & F.col("_y2").isNotNull() & (~whole_span | F.col("_first").isNull()), quoted("event: bad date in", "_event")),
            F.when(F.col("_turned") & own, quoted("event: start after end in", "_event")), missing[2], F.when(has_session & F.col("_sy").isNull(), quoted("session: no year for", "_session")),
            F.when(has_session & F.col("_sy").isNotNull() & F.col("_date").isNull(), quoted("session: bad date in", "_session")), F.when(F.col("_clock.bad"), quoted("session: bad time in", "_session")),
            F.when(F.col("_file").isNotNull() & ~numbered, quoted("track: no leading number in", "_file")),
        ),
    )
    warnings = F.when(F.col("_file").isNull(), F.array(F.lit("empty path"))).otherwise(F.filter(told, lambda w: w.isNotNull()))
    facts = F.struct(
        F.trim(_part(F.col("_collection"), COLLECTION, 1)).alias("collection"), F.col("_year").alias("year"), event(1).cast("int").alias("event_seq"), F.col("_event").alias("event_id"),
        F.upper(F.trim(F.regexp_replace(event(2), r"\s+", " "))).alias("location"), F.col("_first").alias("event_start"), F.col("_last").alias("event_end"), F.col("_date").alias("session_date"),
        _part(F.col("_rest"), SEQUENCE, 1).cast("int").alias("session_seq"), F.col("_clock.time").alias("session_time"), F.col("_no").alias("track_no"), F.col("_title").alias("track_title"),
        F.when(F.col("_title").isNotNull(), title_type(F.col("_title"))).alias("track_type"), season(F.coalesce("_date", "_first")).alias("season"), speaker(F.col("_title")).alias("primary_speaker"),
        warnings.alias("parse_warnings"), whole.alias("source_path"),
    )
    return d.select(*df.columns, facts.alias("facts"))


def header_fragment(facts: Column) -> Column:
    """What a chunk's header tells of a path; empty where nothing was read."""
    place = F.when(facts["event_id"].isNotNull(), F.concat(F.lit("Event: "), facts["event_id"])).otherwise(F.concat(F.lit("Location: "), facts["location"]))
    rest = [F.concat(F.lit(f"{word}: "), facts[c].cast("string")) for word, c in (("Date", "session_date"), ("Time", "session_time"), ("Track", "track_title"), ("Type", "track_type"), ("Season", "season"))]
    return F.concat_ws(" | ", place, *rest)

"""The catalog of sittings and tracks, and metadata read from folder names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import clock_24, duration_seconds, month_number, season
from ..functions.ids import dated_key
from ..functions.text import names, place
from .tables import collapse, last_of

#: A sitting's cell ('16 APR - 3$ - 630 AM'), one with a number alone, and a year that means unknown.
SITTING = r"(?i)^\s*(\d{1,2})\s*([A-Za-z]{3,})\.?\s*(?:-\s*(\d+)\s*\$?\s*)?-\s*(\d{1,4}(?:[:.]\d{2})?\s*[AP]\.?M|NOON)"
SEQUENCE = r"^\s*(\d+)\s*\$\s*$"
UNKNOWN_YEAR = 1900


def sitting_cell(cell: Column, year: Column) -> Column:
    """(session_date, session_seq, session_time, warning) of a sitting's cell and its camp's year; parts that cannot be read are null."""
    line = F.trim(F.element_at(F.split(F.coalesce(cell, F.lit("")), "\n"), 1))
    got = line.rlike(SITTING)
    part = lambda i: F.nullif(F.regexp_extract(line, SITTING, i), F.lit(""))
    month = month_number(part(2))
    year = F.when(year != UNKNOWN_YEAR, year)
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, part(1).cast("int")), "yyyy-MM-dd")
    date = F.when(year.isNotNull() & month.isNotNull(), date)
    seq = F.coalesce(part(3).cast("int"), F.nullif(F.regexp_extract(line, SEQUENCE, 1), F.lit("")).cast("int"))
    time = F.when(got, clock_24(part(4)))
    warning = F.when(line == "", "empty").when(~got & line.rlike(SEQUENCE), "sequence only").when(~got, "unparseable").when(month.isNull(), "unknown month").when(year.isNull(), "no year").when(date.isNull(), "bad date")
    return F.struct(date.alias("session_date"), seq.alias("session_seq"), time.alias("session_time"), warning.alias("warning"))


def tracks(rows: DataFrame) -> DataFrame:
    """Catalog rows (CampYear, CampPlace, Sitting, TrackNo, Content, Duration, Chorus, DetailContents) as tracks with their keys."""
    s = rows.withColumn("_s", sitting_cell(F.col("Sitting"), F.col("CampYear").cast("int")))
    date, seq, track = F.col("_s.session_date"), F.col("_s.session_seq"), F.col("TrackNo").cast("int")
    return s.select(
        dated_key(date, seq, track).alias("join_key"), dated_key(date, seq, F.lit(None)).alias("sitting_key"), date.alias("session_date"), seq.alias("session_seq"), F.col("_s.session_time").alias("session_time"),
        season(date).alias("season"), track.alias("track_no"), F.nullif(F.trim("Content"), F.lit("")).alias("track_title"), duration_seconds(F.col("Duration").cast("double")).alias("duration_sec"),
        names(F.col("Chorus")).alias("performers"), place(F.col("CampPlace")).alias("location"), F.nullif(F.trim("DetailContents"), F.lit("")).alias("detail"), F.col("_s.warning").alias("warning"),
    )


def sittings(t: DataFrame) -> DataFrame:
    """One row a sitting: its first track's scalars, performers in order, the first detail."""
    return collapse(t.where("sitting_key is not null"), "sitting_key", "track_no", ["session_date", "location"], ["performers"], ["detail"])


def unique_tracks(t: DataFrame) -> DataFrame:
    return last_of(t.where("join_key is not null"), ["join_key"], [F.col("track_no")])


def documents(t: DataFrame) -> DataFrame:
    """Texts to index: each track's title, and each sitting's detail once."""
    titles = t.where("track_title is not null").select(F.col("join_key").alias("key"), F.lit("track_title").alias("kind"), F.col("track_title").alias("text"), "session_date", "performers")
    details = sittings(t).where("detail is not null").select(F.col("sitting_key").alias("key"), F.lit("sitting_detail").alias("kind"), F.col("detail").alias("text"), "session_date", "performers")
    return titles.unionByName(details)


def report(t: DataFrame) -> DataFrame:
    return t.agg(F.count("*").alias("n"), F.count("session_date").alias("dated"), F.count("session_seq").alias("numbered"), F.count("duration_sec").alias("timed"), F.count("warning").alias("warned"))


def frequencies(t: DataFrame, column: str) -> DataFrame:
    return t.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


# --- folder names: event / month / collection / session / track ---

EVENT = r"(?i)^([A-Za-z .]+?)[ _-]*((?:19|20)\d{2})$"
SESSION = r"(?i)^(\d{1,2})[ _-]*([A-Za-z]{3,})[ _-]*(?:(\d{1,2})\$?[ _-]*)?(\d{1,4}(?:[:.]\d{2})?[ ]*[AP]M|NOON)?"
TRACK = r"^(\d{1,3})[ ._-]+(.*)$"


def track_type(title: Column) -> Column:
    """qa, session, combined, meditation or bhajan by a title's words; a meditation only where its title begins so."""
    t = F.lower(title)
    return (
        F.when(t.rlike(r"\b(?:q\s*&\s*a|qa|question|prashn)"), "qa").when(t.rlike(r"^(?:sitting|session)\b"), "session").when(t.rlike(r"\bcombined\b"), "combined")
        .when(t.rlike(r"^(?:meditation|dhyan|satsang|pravachan|discourse)\s*(?:$|[(\-]|\d+\s*$)"), "discourse").otherwise("bhajan")
    )


def path_facts(path: Column) -> Column:
    """What a key's folders tell, the deepest folder that fits each pattern: event, year, place, session date, number and time, track
    number, title and type, and warnings where a level is missing."""
    parts = F.split(path, "/")
    folders, file = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.regexp_replace(F.element_at(parts, -1), r"\.[A-Za-z0-9.]+$", "")
    deepest = lambda p: F.element_at(F.concat(F.array(F.lit("")), F.filter(folders, lambda x: x.rlike(p))), -1)
    event, session = deepest(EVENT), deepest(SESSION)
    year = F.nullif(F.regexp_extract(event, EVENT, 2), F.lit("")).cast("int")
    month = month_number(F.regexp_extract(session, SESSION, 2))
    day = F.nullif(F.regexp_extract(session, SESSION, 1), F.lit("")).cast("int")
    date = F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"))
    number = F.nullif(F.regexp_extract(file, TRACK, 1), F.lit("")).cast("int")
    title = F.coalesce(F.nullif(F.regexp_extract(file, TRACK, 2), F.lit("")), file)
    warnings = F.filter(F.array(F.when(event == "", "no event"), F.when(session == "", "no session"), F.when((session != "") & date.isNull(), "no date"), F.when(number.isNull(), "no track number")), lambda w: w.isNotNull())
    return F.struct(
        F.nullif(event, F.lit("")).alias("event_id"), year.alias("year"), place(F.nullif(F.trim(F.regexp_extract(event, EVENT, 1)), F.lit(""))).alias("location"), date.alias("session_date"), season(date).alias("season"),
        F.nullif(F.regexp_extract(session, SESSION, 3), F.lit("")).cast("int").alias("session_seq"), clock_24(F.regexp_extract(session, SESSION, 4)).alias("session_time"), number.alias("track_no"), title.alias("track_title"), track_type(title).alias("track_type"), warnings.alias("parse_warnings"),
    )

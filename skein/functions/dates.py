"""Column functions over dates, clocks and durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bound

#: Months by their first three letters.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def season(date: Column) -> Column:
    """The four seasons of the Indian meteorological year."""
    m = F.month(date)
    return F.when(m.isin(1, 2), "winter").when(m.isin(3, 4, 5), "summer").when(m.isin(6, 7, 8, 9), "monsoon").when(m.isNotNull(), "post-monsoon")


def month_number(token: Column) -> Column:
    """1 to 12 by a month's first three letters; null for other words."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(F.substring(token, 1, 3)))
    return F.when((F.length(token) >= 3) & (at > 0), at.cast("int"))


def duration_seconds(value: Column) -> Column:
    """Seconds of a number written as minutes.seconds; null below 0 and from 60 seconds on."""
    minutes = F.floor(value)
    seconds = F.bround((value - minutes) * 100).cast("int")
    return F.when((value >= 0) & ~F.isnan(value) & (seconds < 60), (minutes * 60 + seconds).cast("int"))


def clock_24(text: Column) -> Column:
    """HH:mm of '6.30 AM', '630 AM', '8 PM' or 'NOON'; null for other text."""
    up = F.upper(text)
    digits = F.regexp_extract(up, r"(\d{1,2})[:.]?(\d{2})?\s*([AP])\.?M", 1)
    hour = F.when(digits != "", digits.cast("int"))
    minute = F.coalesce(F.nullif(F.regexp_extract(up, r"(\d{1,2})[:.]?(\d{2})?\s*([AP])\.?M", 2), F.lit("")), F.lit("0")).cast("int")
    late = F.regexp_extract(up, r"(\d{1,2})[:.]?(\d{2})?\s*([AP])\.?M", 3) == "P"
    hour = hour % 12 + F.when(late, 12).otherwise(0)
    return F.when(up.rlike(r"\bNOON\b"), F.lit("12:00")).when((hour < 24) & (minute < 60), F.format_string("%02d:%02d", hour, minute))


def year_span(first: Column, last: Column) -> Column:
    """An inclusive range of dates of two years in either order; one empty side copies the other."""
    a, b = F.coalesce(first, last), F.coalesce(last, first)
    return F.struct(F.make_date(F.least(a, b), F.lit(1), F.lit(1)).alias("start"), F.make_date(F.greatest(a, b), F.lit(12), F.lit(31)).alias("end"))


def year_in_span(month: Column, day: Column, start: Column, end: Column) -> Column:
    """The date of a month and day within a span that may cross a year's end; outside of it, or where its end is unknown, in the year it starts."""
    early = F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(start), month, day), "yyyy-MM-dd")
    late = F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(end), month, day), "yyyy-MM-dd")
    return F.when(F.coalesce(early.between(start, end), F.lit(False)), early).when(F.coalesce(late.between(start, end), F.lit(False)), late).otherwise(early)


def recency(day: Column, today: Column) -> Column:
    """Today, Yesterday, the 7 and 30 days up to today, or Older, by calendar days; unknown days are older."""
    age = F.datediff(today, day)
    return F.when(age <= 0, "Today").when(age == 1, "Yesterday").when(age <= 6, "Previous 7 days").when(age <= 29, "Previous 30 days").otherwise("Older")


def hours_between(later: Column, earlier: Column) -> Column:
    return (later.cast("double") - earlier.cast("double")) / 3600


#: An event folder: number, place, first day and month and year, last day and month and year; the month and year of the first may be left out.
EVENT_SPAN = r"(?i)^(?:(\d{1,3})\s+)?([A-Za-z][A-Za-z .]*?)\s+(\d{1,2})(?:\s*([A-Za-z]{3,9}))?(?:\s*(\d{4}))?\s*-\s*(\d{1,2})\s*([A-Za-z]{3,9})(?:\s*(\d{4}))?(?:\s.*)?$"


def event_span(name: Column, year: Column) -> Column:
    """(seq, location, start, end, warning) of an event folder. A missing month or year is the last day's, a missing last year that of the folders above;
    a first day after the last one without a year of its own is the year before's. Null dates and a warning where they make no dates."""
    part = lambda i: F.nullif(F.regexp_extract(name, EVENT_SPAN, i), F.lit(""))
    day = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    read = F.struct(
        part(1).cast("int").alias("seq"), F.upper(F.regexp_replace(part(2), r"\s+", " ")).alias("location"), part(3).cast("int").alias("d1"), part(6).cast("int").alias("d2"),
        month_number(part(4)).alias("m1"), month_number(part(7)).alias("m2"), part(5).cast("int").alias("y1"), F.coalesce(part(8).cast("int"), year).alias("y2"),
    )

    def dated(p: Column) -> Column:
        y1, m1 = F.coalesce(p["y1"], p["y2"]), F.coalesce(p["m1"], p["m2"])
        whole = p["y2"].isNotNull() & p["m2"].isNotNull()
        days = F.struct(F.when(whole, day(y1, m1, p["d1"])).alias("a"), F.when(whole, day(p["y2"], p["m2"], p["d2"])).alias("b"), F.when(whole, day(y1 - 1, m1, p["d1"])).alias("back"))
        return bound(days, lambda x: bound(F.when((x["a"] > x["b"]) & p["y1"].isNull(), x["back"]).otherwise(x["a"]), lambda start: span(p, x, start)))

    def span(p: Column, x: Column, start: Column) -> Column:
        warning = F.when(p["y2"].isNull(), "no year").when(x["a"].isNull() | x["b"].isNull() | start.isNull(), "bad date").when(start > x["b"], "start after end")
        good = start.isNotNull() & x["b"].isNotNull()
        return F.struct(p["seq"].alias("seq"), p["location"].alias("location"), F.when(good, start).alias("start"), F.when(good, x["b"]).alias("end"), warning.alias("warning"))

    return bound(read, lambda p: F.when(p["d2"].isNotNull(), dated(p)))

"""Metadata filters: one record of optional fields becomes one Catalyst predicate. Lists are OR within a field, fields are AND."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class Filters:
    """Empty values mean no filter."""

    season: str | None = None
    event_id: str | None = None
    event_type: str | None = None
    primary_language: str | None = None
    location: str | None = None
    speakers: str | None = None
    track_type: list[str] = field(default_factory=list)
    source_file: list[str] = field(default_factory=list)
    topics: list[str] = field(default_factory=list)
    people_named: list[str] = field(default_factory=list)
    scriptures_referenced: list[str] = field(default_factory=list)
    performers: list[str] = field(default_factory=list)
    date_range: tuple[str, str] | None = None
    year: int | None = None

    def __post_init__(self) -> None:
        for name in ("track_type", "source_file", "topics", "people_named", "scriptures_referenced", "performers"):
            value = getattr(self, name)
            setattr(self, name, [value] if isinstance(value, str) else [v for v in value or [] if v])
        if self.year and not self.date_range:
            self.date_range = (f"{self.year}-01-01", f"{self.year}-12-31")

    def merged(self, detected: dict) -> Filters:
        """What was asked for wins over what was detected; detected nulls count for nothing."""
        own = {f.name: getattr(self, f.name) for f in fields(self)}
        return Filters(**{k: v if v else detected.get(k) or v for k, v in own.items()})

    def is_empty(self) -> bool:
        return not any(getattr(self, f.name) for f in fields(self))


def predicate(filters: Filters, date_column: str = "session_date", lenient_dates: bool = False) -> Column | None:
    """The filters as one predicate, or None. lenient_dates lets rows without a date pass a range, as after a fusion whose
    lexical rows carry no metadata."""
    tests: list[Column] = []
    tests += [F.col(c) == getattr(filters, c) for c in ("season", "event_id", "event_type", "primary_language") if getattr(filters, c)]
    tests += [F.col(c).isin(getattr(filters, c)) for c in ("track_type", "source_file") if getattr(filters, c)]
    if filters.location:
        tests.append(F.upper("location") == filters.location.upper())
    if filters.speakers:
        tests.append(F.array_contains("speakers", filters.speakers))
    for c in ("topics", "people_named", "scriptures_referenced", "performers"):
        if values := getattr(filters, c):
            tests.append(F.arrays_overlap(F.col(c), F.array(*[F.lit(v) for v in values])))
    if filters.date_range:
        test = F.col(date_column).between(*filters.date_range)
        tests.append(F.col(date_column).isNull() | test if lenient_dates else test)
    return reduce(lambda a, b: a & b, tests) if tests else None


def apply(df: DataFrame, filters: Filters, **how) -> DataFrame:
    """Rows that pass; a null test is no pass."""
    test = predicate(filters, **how)
    return df if test is None else df.where(test)


def under(path: Column, prefix: str) -> Column:
    """Keys below a folder, taken literally; '' is the root."""
    return F.lit(True) if not prefix else path.startswith(prefix if prefix.endswith("/") else prefix + "/")


#: Fields that hold several values.
LIST_FIELDS = ("track_type", "topics", "people_named", "scriptures_referenced", "performers")


def signal_filters(detections: DataFrame, soft: bool = False) -> DataFrame:
    """(query_id, field, values) of detections (query_id, at, field, value, is_soft) in their order `at`: all different values of a list field, the
    last one of any other. Soft detections count only if asked for."""
    used = detections if soft else detections.where("not is_soft")
    first = used.groupBy("query_id", "field", "value").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    values = F.transform(F.sort_array(F.collect_list(F.struct("first", "value"))), lambda x: x["value"])
    found = first.groupBy("query_id", "field").agg(values.alias("all"), F.max_by("value", "last").alias("latest"))
    return found.select("query_id", "field", F.when(F.col("field").isin(*LIST_FIELDS), F.col("all")).otherwise(F.array("latest")).alias("values"))

"""The rules of normalisation kept as a JSON file: token maps, invented phrases, and how loops are shortened."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Repeats from which a run is a loop, and how many of it stay, where a file does not say.
LOOP_RUN, LOOP_KEEP = 6, 3
_SCHEMA = "loanword_tokens map<string,string>, native_tokens map<string,string>, spelling_scatter map<string,string>, hallucination_tokens array<string>, hallucination_tail array<string>, loop_min_run int, loop_keep int"


@dataclass
class Rules:
    loanwords: dict[str, str] = field(default_factory=dict)
    natives: dict[str, str] = field(default_factory=dict)
    spellings: dict[str, str] = field(default_factory=dict)
    heads: list[str] = field(default_factory=list)
    tails: list[str] = field(default_factory=list)
    loop_run: int = LOOP_RUN
    loop_keep: int = LOOP_KEEP


def read_rules(spark: SparkSession, path: str) -> Rules:
    """The rules of one file, read by Spark; what it leaves out is empty or the default. Rules are edited by hand, so that they fit the driver."""
    r = spark.read.schema(_SCHEMA).option("multiLine", True).json(path).first()
    return Rules(
        r.loanword_tokens or {}, r.native_tokens or {}, r.spelling_scatter or {}, r.hallucination_tokens or [], r.hallucination_tail or [],
        LOOP_RUN if r.loop_min_run is None else r.loop_min_run, LOOP_KEEP if r.loop_keep is None else r.loop_keep,
    )

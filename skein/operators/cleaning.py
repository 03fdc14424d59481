"""Cleaned against raw transcripts: which to trust, and how cleaned words fall on raw segments. Entity spellings by majority."""

from __future__ import annotations

import bisect
import difflib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import bound, collapsed, excise, map_tokens, mapped_count, strip_glosses, tidy, words

#: Shares of the raw words below and above which a cleaned text is not trusted, words from which that is asked, and a loop's share.
TOO_FEW, TOO_MANY, ASKED_FROM, LOOP = 0.85, 1.15, 50, 0.10


def usable(cleaned: Column, raw: Column) -> Column:
    """Whether a cleaned text still is the raw one: not longer by much, nor shorter unless the raw text is a loop."""
    r, c = words(raw), words(cleaned)
    ratio = F.size(c) / F.size(r)
    loop = F.size(F.array_distinct(r)) / F.size(r) < LOOP
    return F.when(F.size(r) < ASKED_FROM, True).when(ratio > TOO_MANY, False).when(ratio >= TOO_FEW, True).otherwise(loop)


def best_text(raw: Column, cleaned_text: Column, cleaned_json: Column) -> Column:
    """The cleaned text, else the cleaned JSON's, else the raw one; a cleaned one only if usable."""
    cleaned = F.coalesce(F.nullif(F.trim(cleaned_text), F.lit("")), F.nullif(F.trim(F.get_json_object(cleaned_json, "$.cleaned_text")), F.lit("")))
    return F.when(cleaned.isNotNull() & usable(cleaned, raw), cleaned).otherwise(raw)


def normalised(text: Column, loanwords: dict[str, str], natives: dict[str, str], heads: list[str], tails: list[str], spellings: dict[str, str] | None = None) -> Column:
    """(text, glosses, counts) after all normalisations in their order: token maps, Latin asides stripped, inventions cut, loops shortened, punctuation tidied.
    counts has how often each acted."""
    maps = {"loanwords": loanwords, "natives": natives, "spellings": spellings or {}}

    def mapped(now: Column, left: list[str], counts: list[Column]) -> Column:
        if left:
            rules = maps[left[0]]
            if not rules and counts:  # an earlier map made white space single, which is all that one without rules does
                return mapped(now, left[1:], [*counts, F.lit(0).alias(left[0])])
            return bound(F.struct(map_tokens(now, rules).alias("t"), mapped_count(now, rules).alias("n")), lambda x: mapped(x["t"], left[1:], [*counts, x["n"].alias(left[0])]))
        return bound(strip_glosses(now), lambda g: bound(excise(g["text"], heads, tails), lambda e: done(g, e, counts)))

    def done(g: Column, e: Column, counts: list[Column]) -> Column:
        every = lambda n: F.struct(*counts, F.size(g["glosses"]).alias("glosses"), e["n"].alias("inventions"), n.alias("loops"))
        return bound(collapsed(e["text"]), lambda c: F.struct(tidy(c["text"]).alias("text"), g["glosses"].alias("glosses"), every(c["n"]).alias("counts")))

    return mapped(text, list(maps), [])


#: Products of lengths above which a stretch without words of its own is dealt in proportion rather than compared word by word.
MOST_CELLS = 1 << 24


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of words that stand once in a and once in b, the longest run of them that is in order in both."""
    once = {w for w, n in Counter(a).items() if n == 1} & {w for w, n in Counter(b).items() if n == 1}
    where = {w: j for j, w in enumerate(b) if w in once}
    pairs = [(i, where[w]) for i, w in enumerate(a) if w in once]
    ends: list[int] = []
    tops: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(ends, j)
        back[n] = tops[at - 1] if at else -1
        ends[at : at + 1], tops[at : at + 1] = [j], [n]
    out, n = [], tops[-1] if tops else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def edits(a: list[str], b: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """equal, replace, delete and insert spans that turn a into b, in order.

    Words that stand once on both sides cut the texts into stretches, those into further ones, and only stretches without such a
    word are compared in full, so that a long text does not cost the square of its words."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        if k - i == 1 and m - j == 1 and a[i] == b[j]:
            yield "equal", i, k, j, m
            continue
        own = _anchors(a[i:k], b[j:m]) if i < k and j < m else []
        if own:
            spans, x, y = [], i, j
            for p, q in own:
                spans += [(x, i + p, y, j + q), (i + p, i + p + 1, j + q, j + q + 1)]
                x, y = i + p + 1, j + q + 1
            spans.append((x, k, y, m))
            todo += [s for s in reversed(spans) if s[0] < s[1] or s[2] < s[3]]
        elif (k - i) * (m - j) > MOST_CELLS:
            yield "replace", i, k, j, m
        else:
            for op, p, q, r, s in difflib.SequenceMatcher(None, a[i:k], b[j:m], autojunk=False).get_opcodes():
                yield op, i + p, i + q, j + r, j + s


def align(segments: list[dict], cleaned: str) -> list[dict]:
    """The cleaned words dealt to the raw segments (text, start, end, speaker), each word once and in order; times and speakers stay.

    A word goes to the segment of the raw word that it equals or, in a changed run, stands for in proportion. New words go to the segment
    reached last, that of a deleted word included; before any word that is the first. Segments that receive nothing go. Without
    cleaned words the raw ones stay, blank segments aside; without raw words there is nothing."""
    raw = [(w, i) for i, s in enumerate(segments) for w in (s["text"] or "").split()]
    new = (cleaned or "").split()
    if not raw:
        return []
    if not new:
        return [{**s, "text": s["text"].strip()} for s in segments if (s["text"] or "").strip()]
    out: list[list[str]] = [[] for _ in segments]
    at = 0
    for op, a, b, c, d in edits([w for w, _ in raw], new):
        if op == "delete":
            at = raw[a][1]
        for k in range(c, d):
            if op != "insert":
                at = raw[min(a + (k - c) * (b - a) // (d - c), b - 1)][1]
            out[at].append(new[k])
    return [{**s, "text": " ".join(x)} for s, x in zip(segments, out, strict=True) if x]


def aligned(files: DataFrame) -> DataFrame:
    """Transcripts (source_file, segments: array of text, start, end, speaker; cleaned) with the cleaned words in the segments' place."""
    schema = T.StructType([files.schema["source_file"], files.schema["segments"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [align(s or [], c) for s, c in zip(b.column("segments").to_pylist(), b.column("cleaned").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("source_file"), pa.array(out, b.schema.field("segments").type)], ["source_file", "segments"])

    return files.select("source_file", "segments", "cleaned").mapInArrow(run, schema)


def _word_changes(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(old.fillna(""), new.fillna(""), strict=True):
        n = {"replace": 0, "delete": 0, "insert": 0}
        for op, i, j, k, m in difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).get_opcodes():
            if op in n:
                n[op] += max(j - i, m - k)
        out.append((n["replace"], n["delete"], n["insert"]))
    return pd.DataFrame(out, columns=["changed", "deleted", "inserted"])


def word_changes(old: Column, new: Column) -> Column:
    """(changed, deleted, inserted): how many words differ between two texts."""
    return F.pandas_udf(_word_changes, "struct<changed:int,deleted:int,inserted:int>")(old, new)


# --- entity spellings ---

#: Devanagari consonants by place of articulation; signs of nasality; what does not count.
CLASSES = {"K": "कखगघ", "C": "चछजझ", "T": "टठडढतथदध", "N": "ङञणनंँ", "M": "म", "P": "पफबभ", "Y": "य", "R": "रड़ढ़", "L": "लळ", "W": "व", "S": "शषस"}


def skeleton(token: Column) -> Column:
    """The consonant classes of a Devanagari word; vowels and ह do not count, nor a final K after N."""
    plain = F.regexp_replace(token, "़", "")
    for code, letters in CLASSES.items():
        plain = F.regexp_replace(plain, f"[{letters}]", code)
    return F.regexp_replace(F.regexp_replace(plain, "[^A-Z]", ""), "NK$", "N")


def entity_grams(tokens: Column, surnames: list[str], stop: list[str], least: int = 3) -> Column:
    """Windows of two and three words that end in a surname and otherwise hold names."""
    named = lambda t: ~t.isin(stop) & ~t.isin(surnames) & (F.length(t) >= least)
    window = lambda n: F.filter(F.transform(tokens, lambda t, i: F.slice(tokens, i + 1, n)), lambda g: F.size(g) == n)
    good = lambda g: F.element_at(g, -1).isin(surnames) & F.forall(F.slice(g, F.lit(1), F.size(g) - 1), named)
    return F.transform(F.filter(F.concat(window(2), window(3)), good), lambda g: F.array_join(g, " "))


def surfaces(lines: DataFrame, surnames: list[str], stop: list[str]) -> DataFrame:
    """Phrases of names in lines (source_file, pos, text): (key, phrase, count, files, sample), key the words' skeletons."""
    each = lines.select("source_file", "pos", "text", F.explode(bound(words(F.col("text")), lambda w: entity_grams(w, surnames, stop))).alias("phrase"))
    keyed = each.withColumn("key", F.array_join(F.transform(F.split("phrase", " "), skeleton), " "))
    return keyed.groupBy("key", "phrase").agg(F.count("*").alias("count"), F.count_distinct("source_file").alias("files"), F.min_by("text", F.struct("source_file", "pos")).alias("sample"))


def proposals(surfaces: DataFrame, least: int = 5, dominance: float = 4.0) -> DataFrame:
    """Rewrites (variant, canonical, counts) of surfaces (key, phrase, count): in a cluster of one key the commonest phrase, seen often,
    stands for those that it outnumbers by far."""
    w = Window.partitionBy("key").orderBy(F.desc("count"), F.desc("phrase"))
    r = surfaces.select("*", F.first("phrase").over(w).alias("canonical"), F.first("count").over(w).alias("canonical_count"), F.row_number().over(w).alias("_n"))
    return r.where((F.col("_n") > 1) & (F.col("canonical_count") >= least) & (F.col("canonical_count") >= dominance * F.col("count"))).select("key", F.col("phrase").alias("variant"), "canonical", F.col("count").alias("variant_count"), "canonical_count").orderBy(F.desc("canonical_count"), F.desc(F.col("canonical_count") - F.col("variant_count")), "variant")


def rewrite_phrases(df: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """df with phrases of whole tokens rewritten, the longest first."""
    by = {tuple(k.split()): v for k, v in rules.items()}
    longest = max(map(len, by), default=0)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            toks, out, i = t.split(), [], 0
            while i < len(toks):
                n = next((n for n in range(min(longest, len(toks) - i), 0, -1) if tuple(toks[i : i + n]) in by), 0)
                out.append(by[tuple(toks[i : i + n])] if n else toks[i])
                i += n or 1
            return " ".join(out)

        return texts.map(one)

    return df.withColumn(text, run(F.col(text)))


#: Rows of a batch of cells that goes through Python.
CELLS = 256


def clean_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with an export's text cells cleaned: carriage-return marks as line feeds, composed characters, no spaces at a line's end, one blank line at
    most, trimmed; empty cells and those that say nan or none are null. Only cells beyond ASCII go through Python, to be composed, in batches of CELLS rows at
    most, so that what a Python worker holds does not grow with a task's rows."""
    import unicodedata

    spark, rows = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= CELLS:
        spark.conf.set(rows, str(CELLS))

    @F.pandas_udf("string")
    def composed(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) and not x.isascii() else x)

    def clean(c: str) -> Column:
        beyond = F.when(F.col(c).rlike(r"[^\x00-\x7f]"), F.col(c))
        broken = F.replace(F.coalesce(composed(beyond), F.col(c)), F.lit("_x000D_"), F.lit("\n"))
        short = F.regexp_replace(F.regexp_replace(broken, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
        return F.when(~F.lower(F.trim(c)).isin("", "nan", "none"), F.nullif(F.regexp_replace(short, r"(?U)^\s+|\s+$", ""), F.lit("")))

    return df.withColumns({c: clean(c) for c in columns})

"""Column functions over text. One word tokenizer serves the whole engine: runs of letters, marks, digits and _ in lower case."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+"
#: Marks that may stand at a token's edges, sentence ends of Latin and Devanagari text, and how many tokens a word counts.
EDGE_MARKS = ",।॥.!?;:\"'()[]{}—–-"
SENTENCE_BREAK = r"(?<=[.!?।॥])(?U)\s+|(?<=[।॥])(?=\S)"
TOKENS_A_WORD = 1.3
#: Rules up to which a text is searched for each one rather than taken apart.
FEW_RULES = 8


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often use names it within its own lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """Words in lower case, in order; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})")), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """How many words tokens() gives, without making them."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(WORD)), F.lit(0))


def words(text: Column) -> Column:
    """What white space separates, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Words times 1.3, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(F.size(words(text)) * F.lit(TOKENS_A_WORD)).cast("int"))


def token_estimate_chars(text: Column, per_token: float = 4.0) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(per_token)).cast("int"))


def unique_ratio(text: Column) -> Column:
    """Distinct words by words; 1.0 for a text without words."""
    w = words(text)
    return F.when(F.size(w) == 0, F.lit(1.0)).otherwise(F.size(F.array_distinct(w)) / F.size(w))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != "")


def repetition(text: Column) -> Column:
    """1 - distinct/total of non-blank paragraphs, 0 below two."""
    p = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(p) < 2, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(p)) / F.size(p))


def clock(seconds: Column) -> Column:
    """hh:mm:ss of whole seconds, ??:??:?? where they are unknown."""
    s = F.floor(seconds).cast("long")
    return F.when(seconds.isNull(), F.lit("??:??:??")).otherwise(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60))


def short_title(text: Column, limit: int = 80) -> Column:
    """The first line, with an ellipsis where it is longer than limit."""
    line = F.trim(F.element_at(F.split(F.trim(text), "\n"), 1))
    return F.when(F.length(line) > limit, F.concat(F.rtrim(F.substring(line, 1, limit - 1)), F.lit("…"))).otherwise(line)


def loose(text: Column) -> Column:
    """Lower case, with -, _ and / as spaces, so that spellings of one name meet."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[-_/\s]+", " "))


def devanagari_share(text: Column) -> Column:
    """Devanagari letters by Devanagari and Latin letters; null without either."""
    deva, latin = F.length(F.regexp_replace(text, "[^ऀ-ॿ]", "")), F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.try_divide(deva, deva + latin)


def language(text: Column) -> Column:
    return F.when(devanagari_share(text) >= 0.20, F.lit("hindi")).otherwise(F.lit("english"))


def mixed_script(token: Column) -> Column:
    return token.rlike("[ऀ-ॿ]") & token.rlike("[A-Za-z]")


def dedupe(values: Column) -> Column:
    """The first spelling of each value, case and outer space aside, in order; blanks go."""
    trimmed = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    keyed = F.transform(trimmed, lambda v: F.struct(F.lower(F.regexp_replace(v, r"(?U)\s+", " ")).alias("k"), v.alias("v")))

    def firsts(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p["k"])
        return bound(keys, lambda ks: F.transform(F.filter(pairs, lambda p, i: F.array_position(ks, p["k"]) == i + 1), lambda p: p["v"]))

    return F.when(values.isNotNull(), bound(keyed, firsts))


def place(text: Column, metro: tuple[str, ...] = ("DELHI",)) -> Column:
    """The last part after a comma, in capitals; a metropolis stands for its neighbourhoods."""
    last = F.upper(F.trim(F.element_at(F.split(text, ","), -1)))
    found = last
    for city in metro:
        found = F.when(last.rlike(rf"\b{city}\b"), F.lit(city)).otherwise(found)
    return F.when(found == "", None).otherwise(found)


def names(text: Column) -> Column:
    """Names of a list cut at , / & and 'and', a final 'ji' dropped, the first spelling of each, in title case unless mixed already."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,/&]|(?i: and )"), lambda p: F.regexp_replace(p, r"(?U)\s+", " "))
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^[ .]+|[ .]+$", ""), r"(?i)\s+ji$", "")))
    return F.transform(dedupe(clean), lambda n: F.when((n == F.upper(n)) | (n == F.lower(n)), F.initcap(n)).otherwise(n))


def topic_terms(text: Column, stop: list[str], most: int = 8) -> Column:
    """Distinct topic words: no stop words or numbers, three Latin characters at least, so many at most."""
    keep = F.filter(tokens(text), lambda t: ~t.isin(stop) & ~t.rlike(r"^\p{N}+$") & ((F.length(t) >= 3) | t.rlike("[ऀ-ॿ]")))
    return F.slice(F.array_distinct(keep), 1, most)


def safe_name(text: Column, limit: int = 180) -> Column:
    """A file name: other characters as _, a long one cut and closed by its SHA-1's first eight digits."""
    flat = F.regexp_replace(text, r"[^\p{L}\p{N}._-]+", "_")
    return F.when(F.length(flat) > limit, F.concat_ws("-", F.substring(flat, 1, limit - 10), F.substring(F.sha1(text), 1, 8))).otherwise(flat)


def without_thoughts(text: Column) -> Column:
    """Answer text without think blocks, closed or not."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


def json_object(text: Column) -> Column:
    """From the first { to the last } of chatty text, null without."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def lines(text: Column, use: Callable[[Column], Column]) -> Column:
    """use of each line, joined by line feeds."""
    return F.array_join(F.transform(F.split(text, "\n"), use), "\n")


def map_tokens(text: Column, rules: dict[str, str]) -> Column:
    """Whole tokens rewritten by a small fixed map, their edge marks kept, white space made single, line by line."""
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]) if rules else None

    def one(t: Column) -> Column:
        bare = F.btrim(t, F.lit(EDGE_MARKS))
        head = F.call_function("substring_index", t, bare, F.lit(1))
        # a token without a rule stays as it is; only the few others are taken apart
        return F.when(bare.isin(list(rules)), F.concat(head, F.element_at(table, bare), F.substr(t, F.length(head) + F.length(bare) + 1))).otherwise(t)

    plain = lines(text, lambda x: F.array_join(words(x), " "))
    if not rules:
        return plain
    said = {t.strip(EDGE_MARKS) for value in rules.values() for t in value.split()}
    if len(rules) > FEW_RULES or said & set(rules):  # one rule after the other would rewrite what another has written
        return lines(text, lambda x: F.array_join(F.transform(words(x), one), " "))
    for key, value in rules.items():
        plain = F.regexp_replace(plain, _token([key]), f"$1{value.replace(chr(92), chr(92) * 2).replace('$', chr(92) + '$')}$2")
    return plain


def _token(keys: list[str]) -> str:
    """A pattern of whole tokens that are one of the keys but for edge marks. A key that begins or ends in such a mark is none."""
    marks = f"([{re.escape(EDGE_MARKS)}]*)"
    return f"(?U)(?<!\\S){marks}(?:{'|'.join(re.escape(k) for k in keys if k and k == k.strip(EDGE_MARKS)) or '(?!)'}){marks}(?!\\S)"


def mapped_count(text: Column, rules: dict[str, str]) -> Column:
    """How many tokens of a text map_tokens rewrites."""
    return F.coalesce(F.regexp_count(text, F.lit(_token(list(rules)))), F.lit(0)) if rules else F.lit(0)


def strip_glosses(text: Column) -> Column:
    """Text without bracketed Latin asides, and those asides."""
    pattern = r"\s*\(\s*([A-Za-z][A-Za-z0-9 '\-/&.]*)\s*\)"
    return F.struct(F.regexp_replace(text, pattern, "").alias("text"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda g: F.trim(g)).alias("glosses"))


def excise(text: Column, heads: list[str], tails: list[str]) -> Column:
    """Text with phrases that recognisers are known to invent replaced by a space and tidied, and how many there were. Heads and tails are plain words."""
    if not heads:
        return F.struct(text.alias("text"), F.lit(0).alias("n"))
    plain = lambda some: "|".join(map(re.escape, some))
    pattern = f"(?:{plain(heads)})" + (f"(?:[\\s,]+(?:{plain(tails)})){{0,8}}" if tails else "") + "[\\s,]*"
    return F.struct(tidy(F.regexp_replace(text, pattern, " ")).alias("text"), F.regexp_count(text, F.lit(pattern)).alias("n"))


def tidy(text: Column) -> Column:
    """One comma for several, no space before a comma or danda, single spaces, lines trimmed."""
    out = F.regexp_replace(F.regexp_replace(text, r",(?:[ \t]*,)+", ","), r"[ \t]+([,।॥])", "$1")
    return lines(F.regexp_replace(out, r"[ \t]{2,}", " "), lambda x: F.btrim(x, F.lit(" \t\r")))


def _runs(toks: Column, least: int, use: Callable[[Column], Column]) -> Column:
    """use(array of (s, n)): where each run of tokens that are equal but for edge marks starts, and its length. A mark alone is a run of its own. Where there
    are too many runs for one of `least` tokens, as nearly everywhere, the array is empty."""

    def found(starts: Column) -> Column:
        runs = F.transform(starts, lambda s, k: F.struct(s.alias("s"), (F.coalesce(F.get(starts, k + 1), F.size(toks) + 1) - s).alias("n")))
        return bound(F.when(F.size(starts) + least - 1 <= F.size(toks), runs).otherwise(F.array().cast("array<struct<s:int,n:int>>")), use)

    begins = lambda b: F.filter(F.sequence(F.lit(1), F.size(b)), lambda i: (i == 1) | (F.get(b, i - 1) != F.get(b, i - 2)) | (F.get(b, i - 1) == ""))
    return bound(F.transform(toks, lambda t: F.btrim(t, F.lit(EDGE_MARKS))), lambda b: bound(begins(b), found))


def collapse_loops(text: Column, least: int = 6, keep: int = 3) -> Column:
    """Runs of `least` or more tokens that are equal but for edge marks shortened to `keep`, line by line; white space becomes one space."""
    if least < 6 or keep < 3:
        raise ValueError("runs below six tokens, or fewer than three kept, would cut ordinary speech")

    return lines(text, lambda x: bound(words(x), lambda toks: F.when(F.size(toks) == 0, "").otherwise(_runs(toks, least, lambda runs: _shortened(toks, runs, least, keep)))))


def _shortened(toks: Column, runs: Column, least: int, keep: int) -> Column:
    """A line's tokens joined, its long runs cut. A line without one, as nearly all are, is joined as it is."""
    cut = lambda r: F.slice(toks, r["s"], F.when(r["n"] >= least, F.lit(keep)).otherwise(r["n"]))
    return F.array_join(F.when(F.exists(runs, lambda r: r["n"] >= least), F.flatten(F.transform(runs, cut))).otherwise(toks), " ")


def collapsed(text: Column, least: int = 6, keep: int = 3) -> Column:
    """(text, n): what collapse_loops and loop_count give, from one look at the tokens."""
    both = lambda toks, runs: F.struct(_shortened(toks, runs, least, keep).alias("t"), F.size(F.filter(runs, lambda r: r["n"] >= least)).alias("n"))
    line = lambda x: bound(words(x), lambda toks: F.when(F.size(toks) == 0, F.struct(F.lit("").alias("t"), F.lit(0).alias("n"))).otherwise(_runs(toks, least, lambda runs: both(toks, runs))))
    whole = lambda each: F.struct(F.array_join(F.transform(each, lambda x: x["t"]), "\n").alias("text"), F.aggregate(each, F.lit(0), lambda s, x: s + x["n"]).alias("n"))
    return bound(F.transform(F.split(text, "\n"), line), whole)


def loop_count(text: Column, least: int = 6) -> Column:
    """How many runs collapse_loops shortens."""
    count = lambda toks: F.when(F.size(toks) == 0, 0).otherwise(_runs(toks, least, lambda runs: F.size(F.filter(runs, lambda r: r["n"] >= least))))
    return F.aggregate(F.transform(F.split(text, "\n"), lambda x: bound(words(x), count)), F.lit(0), lambda s, n: s + n)


def chunk_header(source: Column, start: Column, end: Column, speakers: Column, facts: list[Column] | None = None) -> Column:
    """A chunk's head: file, span and speakers, then what is known of its folders; unknown parts are left out."""
    who = F.when(F.size(speakers) > 0, F.concat(F.lit("Speakers: "), F.array_join(speakers, ", ")))
    return F.concat_ws(" | ", F.concat(F.lit("File: "), source), F.concat(clock(start), F.lit("-"), clock(end)), who, *(facts or []))


def summary_text(title: Column, topics: Column, summary: Column, other: Column) -> Column:
    """What a file's vector is made of, a line each: title, topics, and its summary, else the one in the other language."""
    told = F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.nullif(F.trim(other), F.lit("")))
    listed = F.when(F.size(topics) > 0, F.concat(F.lit("Topics: "), F.array_join(topics, ", ")))
    return F.concat_ws("\n", F.nullif(F.trim(title), F.lit("")), listed, told)


def packed_paragraphs(text: Column, limit: int) -> Column:
    """Paragraphs joined in order as long as a pack has limit characters at most; a longer paragraph is a pack of its own."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n|\n"), lambda p: F.trim(p)), lambda p: p != "")

    def step(packs: Column, p: Column) -> Column:
        last = F.element_at(packs, -1)
        fits = F.length(last) + 1 + F.length(p) <= limit
        return F.when(fits, F.concat(F.slice(packs, F.lit(1), F.greatest(F.size(packs) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), p)))).otherwise(F.concat(packs, F.array(p)))

    # the fold begins with a blank pack, which the first paragraph replaces
    return F.filter(F.aggregate(parts, F.array(F.lit("")), lambda a, p: F.when(F.element_at(a, -1) == "", F.array(p)).otherwise(step(a, p))), lambda x: x != "")

"""Operator 5: fuzzy line dedup by MinHash, with DataFrame operations only.

Signatures of character shingles, bands of their minima, exact Jaccard similarity of the pairs that share a band, and
distributed union-find; one line of each component stays."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, materialise, tasks
from .components import components

#: Characters of a shingle, minima of a signature, and the bands: twelve sets of four minima, each minimum in two of them, drawn
#: once and for all. A pair that shares a band is compared if at least AGREE of its minima are equal.
SHINGLE, MINIMA, AGREE = 5, 24, 13
_DRAW = random.Random(5)
BANDS = tuple(tuple(sorted(order[i : i + 4])) for order in (_DRAW.sample(range(MINIMA), MINIMA) for _ in range(2)) for i in range(0, MINIMA, 4))
#: Shingles of a row that is folded, rows of a bucket that one task pairs, counters that tell large buckets, and bits of the filter of lines.
_STEP, _BUCKET_ROWS, _COUNTERS, _FILTER = 4, 50_000, 1 << 16, 1 << 26
#: Lines of a bucket whose lines are all compared at once, lines of a large bucket, and how many of its lines all its lines are compared with at first.
_SMALL, _LARGE, _CENTRES = 8, 32, 4
#: Lines of either side of a large bucket that tell how many pairs its lines have, and words of 64 bits in the finer sketch of a line with over about _LARGE of them.
_PROBES, _WORDS = 8, 32
#: Bits of a minimum in a sketch, and the lowest bits of its twelve fields in each of a sketch's two halves.
_BITS = 5
_LOWEST = sum(1 << (_BITS * i) for i in range(MINIMA // 2))


def _mask(i: int) -> int:
    """The i-th of the fixed numbers that turn one hash into several orders of the shingles. Their first five bits all differ, so
    that the minima of a line come from different parts of the hash space."""
    return (int(f"{i:05b}"[::-1], 2) << 27 | random.Random(i).getrandbits(27)) - 2**31


def _last(units: str) -> str:
    """The place of the last shingle of a line in UTF-32; a line shorter than a shingle is one itself."""
    return f"greatest(octet_length({units}) div 4 - {SHINGLE}, 0)"


def _grams(line: str) -> Column:
    """The hashes of a line's shingles. The line's units, four bytes a character, are bound, or each shingle would make them anew."""
    hashes = f"transform(sequence(0, {_last('u')}), i -> xxhash64(substring(u, 4 * i + 1, {4 * SHINGLE})))"
    return F.expr(f"element_at(transform(array(encode({line}, 'UTF-32')), u -> {hashes}), 1)")


def lines_of(docs: DataFrame, lowest: int, width: int) -> DataFrame:
    """(pos, line, k1, k2) of each line that is not blank, trimmed of spaces, tabs and carriage returns: pos is (doc_id - lowest) * width + its number, k1 and k2 a 128-bit key."""
    base = (F.col("doc_id") - F.lit(lowest)) * F.lit(width)
    each = docs.where("doc_id is not null").select(base.alias("base"), F.posexplode(F.split("text", "\n")).alias("number", "line"))
    each = each.select((F.col("base") + F.col("number")).alias("pos"), F.btrim("line", F.lit(" \t\r")).alias("line")).where("line <> ''")
    return each.select("pos", "line", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def signatures(lines: DataFrame) -> DataFrame:
    """(k1, k2, pos, last, m0, m1, ...) of each different line: its first and last place and the minima of its shingles' hashes.
    One row a line and task is shuffled; _STEP shingles at a time are folded as they are made."""
    return _hashed(lines, "pos", "k1", "k2").groupBy("k1", "k2").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"), *_minima())


def _hashed(lines: DataFrame, *keep: str) -> DataFrame:
    """Rows of _STEP hashes h0, h1, ... of each line's shingles beside the columns to keep."""
    units = lines.select(*keep, F.encode("line", "UTF-32").alias("u")).withColumn("end", F.expr(_last("u")))
    steps = units.select("*", F.explode(F.expr(f"sequence(0, end div {_STEP})")).alias("i"))
    return steps.select(*keep, *[F.expr(f"hash(substring(u, 4 * least({_STEP} * i + {j}, end) + 1, {4 * SHINGLE}))").alias(f"h{j}") for j in range(_STEP)])


def _minima() -> list[Column]:
    return [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(_mask(i))) for j in range(_STEP)])).alias(f"m{i}") for i in range(MINIMA)]


def _sketches(signed: DataFrame) -> DataFrame:
    """(pos, s0, s1): the last bits of the minima of each line."""
    half = lambda h: sum(F.shiftleft(F.col(f"m{MINIMA // 2 * h + i}").bitwiseAND(2**_BITS - 1).cast("long"), _BITS * i) for i in range(MINIMA // 2))
    return signed.select("pos", half(0).alias("s0"), half(1).alias("s1"))


def _dense(among: DataFrame) -> DataFrame:
    """(pos) of the lines that agree with over about _LARGE lines of a bucket which they must be compared with, by _PROBES lines inside of its largest component and as many outside."""
    side = Window.partitionBy("band", "part", "inside")
    large = among.where(f"outside > {_LARGE}").withColumn("weight", F.count("*").over(side) * F.greatest("parts", F.lit(1)) / F.lit(_PROBES))
    large = large.withColumn("number", F.row_number().over(side.orderBy(F.xxhash64("band", "pos"))))
    each, probes = (df.select("band", "part", *[F.col(c).alias(f"{x}{c}") for c in ("pos", "inside", "s0", "s1", "weight")]) for df, x in ((large, "x"), (large.where(f"number <= {_PROBES}"), "y")))
    met = each.join(probes.hint("merge"), ["band", "part"]).where(_agree("x", "y") & (F.col("xpos") != F.col("ypos")) & ~(F.col("xinside") & F.col("yinside")))
    return met.groupBy("band", "xpos").agg(F.sum(F.greatest("yweight", F.lit(1.0))).alias("count")).where(f"count > {_LARGE}").select(F.col("xpos").alias("pos")).distinct()


def _finer(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(pos, size, bits) of the lines whose pos is among ids: the number of different shingles, and whether an even or an odd number of them falls on each of 64 * _WORDS bits."""
    texts = _some(lines, ids).join(ids.hint("merge"), "pos").select("pos", "line").repartition(tasks(lines.sparkSession), F.xxhash64("pos"))
    # a generator, so that each set is made once and not once for each use of it
    sets = texts.select("pos", F.inline(F.array(F.struct(F.array_distinct(_grams("line")).alias("grams")))))
    word = f"aggregate(filter(grams, h -> pmod(h, {_WORDS}) = w), 0L, (bits, h) -> bits ^ shiftleft(1L, cast(shiftrightunsigned(h, 58) as int)))"
    return sets.select("pos", F.size("grams").alias("size"), F.expr(f"transform(sequence(0, {_WORDS - 1}), w -> {word})").alias("bits"))


def _close(x: str, y: str, num: int, den: int) -> Column:
    """Whether two lines can be similar by their sizes and finer sketches: each shingle that only one of the two has changes one bit, so no more bits can differ than there are such shingles."""
    xsize, ysize = F.col(f"{x}size").cast("long"), F.col(f"{y}size").cast("long")
    differ = F.expr(f"aggregate(zip_with({x}bits, {y}bits, (p, q) -> bit_count(p ^ q)), 0, (n, d) -> n + d)").cast("long")
    return (F.least(xsize, ysize) * den >= F.greatest(xsize, ysize) * num) & (differ * (den + num) <= (xsize + ysize) * (den - num))


def _agree(x: str, y: str) -> Column:
    """Whether enough of two lines' minima can be equal."""
    different = F.lit(0)
    for half in ("s0", "s1"):
        v = F.col(f"{x}{half}").bitwiseXOR(F.col(f"{y}{half}"))
        for shift in (1, 2):  # gathers a field's five bits in its lowest one
            v = v.bitwiseOR(F.shiftrightunsigned(v, shift))
        v = v.bitwiseOR(F.shiftrightunsigned(F.col(f"{x}{half}").bitwiseXOR(F.col(f"{y}{half}")), _BITS - 1))
        different += F.bit_count(v.bitwiseAND(_LOWEST))
    return different <= MINIMA - AGREE


def _some(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines whose pos is among ids, and a few more: a filter of 8 MB, whatever the input, spares most texts the shuffle."""
    place = F.pmod(F.xxhash64("pos"), F.lit(_FILTER))
    maps = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    marked = lines.select("pos", "line", F.bitmap_bucket_number(place).alias("chunk"), F.bitmap_bit_position(place).alias("at")).join(F.broadcast(maps), "chunk")
    return marked.where("shiftright(cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) & 1 = 1").select("pos", "line")


def _verified(lines: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose lines' shingle sets have a Jaccard similarity of num/den or more."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("pos")).distinct()
    # joins by merging at every size: a side that is small here is large elsewhere; an inner join, since a semi-join would be pushed below the filter
    texts = _some(lines, ids).join(ids.hint("merge"), "pos").select("pos", "line", F.size(F.array_distinct(_grams("line"))).alias("n"))
    texts = materialise(texts)
    left, right = (texts.select(F.col("pos").alias(c), F.col("line").alias(f"{c}line"), F.col("n").alias(f"{c}n")).hint("merge") for c in "ab")
    both = pairs.join(right, "b").join(left, "a").where(F.least("an", "bn").cast("long") * den >= F.greatest("an", "bn").cast("long") * num)
    # a generator, so that each set is made once and not once for each use of it
    sets = both.select("a", "b", (F.col("an") + F.col("bn")).alias("n"), F.inline(F.array(F.struct(_grams("aline").alias("x"), _grams("bline").alias("y")))))
    found = materialise(sets.where(F.size(F.array_intersect("x", "y")).cast("long") * (num + den) >= F.col("n").cast("long") * num).select("a", "b"))
    discard(texts)
    return found


def _bands(signed: DataFrame) -> DataFrame:
    """(band, part, parts, pos): the bands of each line; large ones are dealt to several parts, from 1 (0 is one that is not split)."""
    bands = signed.select("pos", F.explode(_names()).alias("band"))
    counter = F.pmod("band", F.lit(_COUNTERS))
    large = bands.groupBy(counter.alias("counter")).count().where(f"count > {_BUCKET_ROWS}")  # at most 2**16 rows
    dealt = bands.withColumn("counter", counter).join(F.broadcast(large), "counter", "left")
    parts = F.when(F.col("count").isNotNull(), F.ceil(F.col("count") / _BUCKET_ROWS)).otherwise(0).cast("int")
    return dealt.select("band", F.when(parts > 0, F.pmod(F.xxhash64("pos"), parts) + 1).otherwise(0).cast("int").alias("part"), parts.alias("parts"), "pos")


def _names() -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *[f"m{i}" for i in rows]) for b, rows in enumerate(BANDS)])


def similar_lines(lines: DataFrame, signed: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) of the different lines that are similar to another, each by its first place.

    In a small bucket of a band all lines are compared with each other, in another one with the bucket's first line, in a large one with some others too. What is then linked
    to the bucket's largest component is done with; the other lines are compared with all lines of other components in the bucket, in the first band that the two share, where
    they are many by finer sketches before their texts. So a group of copies costs its size, and no pair that shares a band is left out unless its lines are linked already or too few of
    their minima agree."""
    bucket = Window.partitionBy("band", "part")
    met = _bands(signed).select("*", F.min("pos").over(bucket).alias("first"), F.count("*").over(bucket).alias("c"))
    kept = materialise(met.where("c > 1 or part > 0"))
    firsts = kept.where("part > 0 and pos = first")
    heads = firsts.groupBy("band").agg(F.min("pos").alias("head"), F.count("*").alias("n")).where("n > 1")
    across = firsts.join(heads, "band").where("pos <> head").select(F.col("head").alias("a"), F.col("pos").alias("b"))
    star = kept.where("pos <> first").select(F.col("first").alias("a"), F.col("pos").alias("b")).union(across)
    few = kept.where(f"c > 2 and c <= {_SMALL} and part = 0 and pos <> first")
    few = few.select("band", F.col("pos").alias("a")).join(few.select("band", F.col("pos").alias("b")).hint("merge"), "band").where("a < b").select("a", "b")
    star = star.union(few).distinct()
    sketch = materialise(_sketches(signed))
    left, right = (sketch.select(F.col("pos").alias(c), F.col("s0").alias(f"{c}s0"), F.col("s1").alias(f"{c}s1")).hint("merge") for c in "ab")
    pairs = star.join(right, "b").join(left, "a").where(_agree("a", "b")).select("a", "b")
    # lines that share a passage are often similar to some of a large bucket's lines, but not to the first one
    large = kept.where(f"c > {_LARGE}").select("band", "part", "pos").join(sketch.hint("merge"), "pos")
    order = Window.partitionBy("band", "part").orderBy(F.xxhash64("band", "pos"))
    chosen = large.withColumn("n", F.row_number().over(order)).where(F.col("n") <= _CENTRES).drop("n")
    centres, others = (df.select("band", "part", F.col("pos").alias(c), F.col("s0").alias(f"{c}s0"), F.col("s1").alias(f"{c}s1")) for df, c in ((chosen, "a"), (large, "b")))
    around = others.join(centres.hint("merge"), ["band", "part"]).where((F.col("a") != F.col("b")) & _agree("a", "b"))
    pairs = materialise(pairs.union(around.select(F.least("a", "b"), F.greatest("a", "b"))).distinct())
    links = _verified(lines, pairs, num, den)
    so_far = materialise(components(links))

    # a small bucket is done with
    more = kept.where(f"c > greatest({_SMALL}, 2) or part > 0").drop("c").join(so_far.withColumnRenamed("node", "pos").hint("merge"), "pos", "left")
    placed = materialise(more.withColumn("component", F.coalesce("component", "pos")))
    counted = placed.groupBy("band", "component").agg(F.count("*").alias("c"))
    main = counted.groupBy("band").agg(F.max_by("component", F.struct("c", "component")).alias("main"), (F.sum("c") - F.max("c")).alias("outside")).where("outside > 0")
    among = placed.join(main.hint("merge"), "band").join(sketch.hint("merge"), "pos")
    among = materialise(among.select("band", "part", "parts", "pos", "first", "component", (F.col("component") == F.col("main")).alias("inside"), "outside", "s0", "s1"))
    finer = materialise(_finer(lines, _dense(among)))
    mixed = materialise(among.drop("outside").join(finer.hint("merge"), "pos", "left").withColumn("dense", F.col("size").isNotNull()))
    # a line that is not of the bucket's largest component goes to all parts of it
    others = mixed.where("not inside").withColumn("part", F.explode(F.expr("if(parts > 0, sequence(1, parts), array(0))")))
    x, y = (df.select([F.col(c).alias(f"{side}{c}") for c in df.columns if c != "parts"]) for df, side in ((others, "x"), (mixed, "y")))
    differ = (F.col("xcomponent") != F.col("ycomponent")) & (F.col("yinside") | (F.col("xpos") < F.col("ypos")))
    untried = (F.col("xpart") > 0) | ((F.col("xpos") != F.col("xfirst")) & (F.col("ypos") != F.col("xfirst")))
    here = (F.col("xband") == F.col("yband")) & (F.col("xpart") == F.col("ypart")) & _agree("x", "y") & differ & untried
    # the first join sees nearly all pairs of a bucket: it has few columns
    rest = x.hint("merge").join(y, here & ~(F.col("xdense") & F.col("ydense"))).select("xpos", "ypos")
    rest = rest.union(x.where("xdense").hint("merge").join(y.where("ydense"), here & _close("x", "y", num, den)).select("xpos", "ypos"))
    rest = rest.select(F.least("xpos", "ypos").alias("a"), F.greatest("xpos", "ypos").alias("b")).distinct()
    rest = materialise(rest.join(pairs.hint("merge"), ["a", "b"], "left_anti"))
    last = _verified(lines, rest, num, den)
    found = materialise(components(links.union(last)).repartition(tasks(lines.sparkSession), "node"))
    discard(kept, sketch, pairs, links, so_far, placed, among, finer, mixed, rest, last)
    return found


def _ranked(docs: DataFrame) -> DataFrame:
    """docs with their ids' ranks in the place of the ids, and the ids as `real`."""
    spark = docs.sparkSession
    ids = docs.select("doc_id").where("doc_id is not null").distinct().repartitionByRange(tasks(spark), "doc_id").sortWithinPartitions("doc_id")
    ids = materialise(ids.select("doc_id", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")))
    totals = ids.groupBy("pid").count()  # one row a partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = ids.join(F.broadcast(totals.select("pid", before.alias("before"))), "pid").select("doc_id", (F.col("before") + F.col("row")).alias("rank"))
    return materialise(docs.join(ranks.hint("merge"), "doc_id").select(F.col("rank").alias("doc_id"), F.col("doc_id").alias("real"), "text"))


def removed_lines(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, removed) of each document of (doc_id, text) that loses lines: an array of (line, kept_doc, kept_line), by line.

    Lines are ordered by id and number; the first of a component stays. Ids whose span, times the longest text, does not fit a long are
    replaced by their ranks meanwhile."""
    found = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max(F.octet_length("text")).alias("width")).first()
    lowest, width = found.lo or 0, (found.width or 0) + 1
    ranked = None
    if found.lo is not None and (found.hi - found.lo + 1) * width >= 2**63:
        ranked, lowest = _ranked(docs), 0
    lines = lines_of(docs if ranked is None else ranked, lowest, width)
    signed = materialise(signatures(lines))
    similar = similar_lines(lines, signed, num, den)
    classes = signed.select("k1", "k2", "pos", "last").join(similar.withColumnRenamed("node", "pos").hint("merge"), "pos", "left")
    gone = classes.select("k1", "k2", "pos", "last", F.coalesce("component", "pos").alias("kept")).where("pos <> last or pos <> kept")
    each = lines.select("pos", "k1", "k2").join(gone.drop("pos", "last").hint("merge"), ["k1", "k2"]).where("pos <> kept").select("pos", "kept").distinct()
    doc = lambda c: F.expr(f"({c} div {width}L) + {lowest}L")
    number = lambda c: F.expr(f"cast(pmod({c}, {width}L) as int)")
    listed = each.select(doc("pos").alias("doc_id"), number("pos").alias("line"), doc("kept").alias("kept_doc"), number("kept").alias("kept_line"))
    if ranked is not None:
        real = ranked.select("doc_id", "real").distinct()
        listed = listed.join(real.hint("merge"), "doc_id").drop("doc_id").withColumnRenamed("real", "doc_id")
        listed = listed.join(real.toDF("kept_doc", "real").hint("merge"), "kept_doc").drop("kept_doc").withColumnRenamed("real", "kept_doc")
    by_doc = listed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "kept_doc", "kept_line"))).alias("removed"))
    by_doc = materialise(by_doc)
    discard(signed, similar, *([ranked] if ranked is not None else []))
    return by_doc


def _judged(docs: DataFrame, num: int, den: int, id_col: str, text_col: str, row: Column) -> DataFrame:
    """(row, n_lines, removed) of each row of docs."""
    gone = removed_lines(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), num, den)
    count = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n")))
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("_doc"), count.alias("n_lines"))
    joined = rows.join(gone.withColumnRenamed("doc_id", "_doc").hint("merge"), "_doc", "left")
    return joined.select("row", "n_lines", F.coalesce("removed", F.array().cast("array<struct<line:int,kept_doc:bigint,kept_line:int>>")).alias("removed"))


def _stay(text_col: str) -> Column:
    """The text of the row without its removed lines."""
    text = F.col("row").getField(text_col)
    numbers = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.transform("removed", lambda r: r["line"]))
    one = F.transform(F.array(F.split(text, "\n")), lambda cut: F.array_join(F.transform(numbers, lambda i: F.get(cut, i)), "\n"))
    return F.when(F.size("removed") > 0, F.element_at(one, 1)).otherwise(text)


def dedup_lines(docs: DataFrame, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Keep one line of each component of similar lines of all documents; all columns of docs, n_lines, n_kept and `removed`, an array
    of (line, kept_doc, kept_line) of the lines that went, numbered from 0. The text column has the lines that stay, in order.

    Lines are cut at line feeds and compared trimmed; two are similar when the Jaccard similarity of their sets of five-character shingles
    is num/den or more; a shorter line is one shingle. The banding finds a pair of that similarity with a probability of about 0.97, more alike ones
    nearly always; equal lines always. Blank lines stay and are compared with nothing. A null text stays null, with no lines. A document
    with a null id stays as it is. Rows with one id count as one document and lose the same lines. Any ids of 64 bits will do. An empty table gives
    an empty result. Columns of docs named n_lines, n_kept or removed give way to the result's. Without with_text the text column is left out and texts are not shuffled."""
    others = [c for c in docs.columns if c not in ("n_lines", "n_kept", "removed") and (with_text or c != text_col)]
    judged = _judged(docs, num, den, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in others]))
    columns = [_stay(text_col).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in others]
    return judged.select(*columns, "n_lines", (F.col("n_lines") - F.size("removed")).alias("n_kept"), "removed")


def keep_lines(docs: DataFrame, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs, whatever their names, with the lines that stay as dedup_lines finds them; a row that loses its last line that is
    not blank goes."""
    judged = _judged(docs, num, den, id_col, text_col, F.struct("*")).withColumn("stay", _stay(text_col))
    left = judged.where((F.size("removed") == 0) | (F.btrim("stay", F.lit(" \n\r\t")) != ""))
    return left.select(*[F.col("stay").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])

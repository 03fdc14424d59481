"""Operator 7: n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row a document and a column a word 5-gram. Two rows link when their overlap reaches a bound that
depends on their sizes. Only the entries that can matter are shuffled: each row's first entries in one order of the columns,
rare ones first (a pair that shares none of these cannot reach the bound). Blocks of a column give candidate pairs, the sizes
and places of their entries give an upper bound of the overlap and drop most, and the rest are counted exactly.

Within a block every row is first paired with the block's smallest row alone; the components of what links then leave only
pairs between different components to count, so a large group of copies costs its size, not its square, and no link between
components is lost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import collect_shuffles, discard, materialise, mix64, shingle_sets, short_batches, tasks
from .components import components

#: Counters that order the columns by how common they are: 2**22, of 4 bytes, whatever the input. They bear on the order alone.
_COUNTER_BITS, _BLOCK_BITS = 22, 16
#: Bits of the filter of ids whose texts are needed.
_FILTER_BITS = 26
#: Rows of a column that make a block, and pairs of a row that are counted in one task.
_BLOCK_ROWS, _PAIRS = 1 << 15, 256


def _keys(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit keys of each set, whatever the order of its hashes."""
    ends, out = np.cumsum(n), []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(salt)))))
        out.append((sums[ends] - sums[ends - n]).view(np.int64))
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its set's size and a 128-bit key of its set; at the end the task's counters of its shingles."""
    names = ["doc_id", "n", "k1", "k2", "block", "counts"]
    counters = np.zeros(1 << _COUNTER_BITS, np.uint32)
    waiting, held = [], 0

    def count():
        nonlocal waiting, held
        if waiting:
            counters[:] += np.bincount(np.concatenate(waiting), minlength=len(counters)).astype(np.uint32)
        waiting, held = [], 0

    for b in batches:
        h, of, n = shingle_sets(b.column("text"))
        keys = _keys(h, n)
        waiting.append((h >> np.uint64(64 - _COUNTER_BITS)).astype(np.int64))
        held += len(h)
        if held > 4_000_000:
            count()
        empty = pa.nulls(len(n))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), empty.cast(pa.int32()), empty.cast(pa.binary())], names)
    count()
    size = 1 << _BLOCK_BITS
    blocks = [(i, zlib.compress(part.tobytes(), 1)) for i in range(0, len(counters) // size) if (part := counters[i * size : (i + 1) * size]).any()]
    if blocks:
        empty = pa.nulls(len(blocks)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array([i for i, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names)


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << _BLOCK_BITS, np.uint64)
    for c in table["counts"]:
        total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
    counts = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
    return pa.table({"block": table["block"][:1], "counts": pa.array([counts], pa.binary())})


def _counters(blocks: DataFrame) -> np.ndarray:
    """The sum of the tasks' counters: added in two steps, then 16 MB at most come to the driver."""
    some = blocks.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(32)))
    some = some.groupBy("block", "part").applyInArrow(_add, "block int, counts binary")
    out = np.zeros(1 << _COUNTER_BITS, np.uint32)
    for r in some.groupBy("block").applyInArrow(_add, "block int, counts binary").collect():
        out[r.block << _BLOCK_BITS : (r.block + 1) << _BLOCK_BITS] = np.frombuffer(zlib.decompress(r.counts), np.uint32)
    return out


def _entries(counters, num: int, den: int):
    """The first entries of each row in the common order: (s, part, key, doc, n, pos); key is the row's set's. Very common columns
    have several parts, from 1 (0 is a column that is not split); equal rows fall into the same one."""
    rows = _BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = counters.value
        for b in batches:
            h, of, n = shingle_sets(b.column("text"))
            key = _keys(h, n)[0]
            df = common[h >> np.uint64(64 - _COUNTER_BITS)]
            order = np.lexsort((h, np.floor(np.log2(df + 1.0)).astype(np.int8), of))
            h, of, df = h[order], of[order], df[order]
            pos = np.arange(len(h)) - (np.cumsum(n) - n)[of]
            keep = pos <= (n - -(-num * n // den))[of]
            h, of, df, pos = h[keep], of[keep], df[keep], pos[keep]
            doc = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[of]
            parts = (df // rows + 1).astype(np.uint64)
            part = np.where(parts > 1, mix64(key[of].view(np.uint64)) % parts + np.uint64(1), np.uint64(0)).astype(np.int32)
            for i in range(0, len(h), 200_000):
                x = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[x].view(np.int64)), pa.array(part[x]), pa.array(key[of[x]]), pa.array(doc[x]), pa.array(n[of[x]].astype(np.int32)), pa.array(pos[x].astype(np.int32))], ["s", "part", "key", "doc", "n", "pos"])

    return run


def _possible(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """Whether two rows whose first common entry stands at these places can overlap enough for their sizes."""
    most = F.least(n1 - p1, n2 - p2).cast("long")
    return (F.least(n1, n2).cast("long") * den >= F.greatest(n1, n2).cast("long") * num) & (most * (num + den) >= (n1 + n2).cast("long") * num)


def _count(num: int, den: int):
    """Rows come ordered by (a, part, b), a itself first; overlaps with a are counted, and pairs below the bound dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, np.empty(0, np.uint64)
        for batch in batches:
            h, _, n = shingle_sets(batch.column("text"))
            ends = np.cumsum(n)
            out = []
            for i, (a, part, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                mine = h[ends[i] - n[i] : ends[i]]
                if a == b:
                    center, own = (a, part), mine
                elif center == (a, part) and len(own) and len(mine):
                    at = np.searchsorted(own, mine)
                    overlap = int((own[np.minimum(at, len(own) - 1)] == mine).sum())
                    if den * overlap >= num * (len(own) + len(mine) - overlap):
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's filter of ids, in blocks of bits."""
    bits = np.zeros(1 << _FILTER_BITS, bool)
    for b in batches:
        bits[_bit(b.column(0))] = True
    packed = np.packbits(bits).reshape(-1, 1 << _BLOCK_BITS)
    if some := [i for i in range(len(packed)) if packed[i].any()]:
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(packed[i].tobytes(), 1) for i in some], pa.binary())], ["block", "bits"])


def _either(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << _BLOCK_BITS, np.uint8)
    for c in table["bits"]:
        total |= np.frombuffer(zlib.decompress(c.as_py()), np.uint8)
    return pa.table({"block": table["block"][:1], "bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _bit(ids) -> np.ndarray:
    return (mix64(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is among ids, and a few more: a filter of 8 MB, whatever the input, spares most texts the shuffle."""
    marked = ids.mapInArrow(_mark, "block int, bits binary").withColumn("part", F.pmod(F.xxhash64("bits"), F.lit(32)))
    marked = marked.groupBy("block", "part").applyInArrow(_either, "block int, bits binary").groupBy("block").applyInArrow(_either, "block int, bits binary")
    packed = np.zeros((1 << _FILTER_BITS) // 8, np.uint8).reshape(-1, 1 << _BLOCK_BITS)
    for r in marked.collect():
        packed[r.block] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    filter_bits = docs.sparkSession.sparkContext.broadcast(packed.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_bits.value
        for b in batches:
            at = _bit(b.column("doc_id"))
            yield b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))

    return docs.where("doc_id is not null").mapInArrow(run, docs.schema)


def _links(docs: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that link. A row with very many pairs is copied to several tasks, _PAIRS pairs to each."""
    many = pairs.groupBy("a").agg(F.count("*").alias("c"))
    split = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / _PAIRS)).cast("int").alias("part"))
    wanted = split.union(split.select("a", F.col("a").alias("b"), "part").distinct())
    few = _only(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    texts = few.join(wanted.hint("merge"), few.doc_id == wanted.b).select("a", "part", "b", F.col("a") != F.col("b"), "text").toDF("a", "part", "b", "later", "text")
    dealt = texts.repartition(tasks(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "later")
    return materialise(dealt.drop("later").mapInArrow(_count(num, den), "a long, b long").distinct())


def jaccard_components(docs: DataFrame, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of word 5-grams have a Jaccard similarity of num/den or more; (doc_id, n_shingles, component_id)
    for each row of docs.

    Words are runs of characters other than space and 09-0D, A-Z as a-z; a text of fewer than five words has its sequence as
    one shingle. Null, empty and blank texts have no shingle and link with nothing. Equal sets are one class, found by a 128-bit
    key, and count as one row in each block. Rows with one id count as one document. A row with a null id
    keeps its n_shingles and has a null component_id. An empty table gives an empty result. Other columns are ignored."""
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = materialise(docs.mapInArrow(_profile, "doc_id long, n long, k1 long, k2 long, block int, counts binary"))
    counters = spark.sparkContext.broadcast(_counters(found.where("block is not null").select("block", "counts")))
    rows = materialise(found.where("block is null").select("doc_id", "n", "k1", "k2"))
    discard(found)  # each task's counters, which are much larger
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))

    entries = docs.where("doc_id is not null").mapInArrow(_entries(counters, num, den), "s long, part int, key long, doc long, n int, pos int")
    # equal rows are one: all of them have the same entries, so that the smallest stands for its class in every block
    single = entries.repartition(tasks(spark), "s", "part").groupBy("s", "part", "key", "n", "pos").agg(F.min("doc").alias("doc"))
    block = Window.partitionBy("s", "part")
    first = F.min(F.struct("doc", "n", "pos")).over(block)
    blocks = single.select("s", "part", "doc", "n", "pos", F.count("*").over(block).alias("c"), first.alias("first"))
    kept = materialise(blocks.where("c > 1 or part > 0").select("s", "part", "doc", "n", "pos", F.col("first.doc").alias("a"), F.col("first.n").alias("an"), F.col("first.pos").alias("apos")))
    collect_shuffles(spark)  # each step's files go before the next one's come

    near = kept.where(F.col("doc") != F.col("a")).where(_possible(F.col("n"), F.col("pos"), F.col("an"), F.col("apos"), num, den))
    firsts = kept.where(F.col("doc") == F.col("a"))
    heads = firsts.groupBy("s").agg(F.min("doc").alias("head"), F.count("*").alias("parts")).where("parts > 1")
    across = firsts.join(heads, "s").where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b"))
    pairs = materialise(near.select("a", F.col("doc").alias("b")).union(across).distinct())
    links = _links(docs, pairs, num, den)

    same = rows.where("n > 0").join(classes, ["n", "k1", "k2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    so_far = materialise(components(links.union(same)))
    collect_shuffles(spark)
    # joins by merging at every size: a side that is small here is large elsewhere
    placed = kept.drop("a", "an", "apos", "part").join(so_far.withColumnRenamed("node", "doc").hint("merge"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = materialise(placed)
    discard(kept, so_far)
    mixed = placed.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("s")
    whole, placed = placed, materialise(placed.join(mixed.hint("merge"), "s"))
    discard(whole)
    collect_shuffles(spark)
    x, y = placed.alias("x"), placed.alias("y")
    rest = x.join(y, F.col("x.s") == F.col("y.s")).where(
        (F.col("x.doc") < F.col("y.doc")) & (F.col("x.component") != F.col("y.component")) & _possible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), num, den)
    )
    rest = materialise(rest.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
    discard(placed, pairs)
    more = _links(docs, rest, num, den)
    last = components(links.union(same).union(more)).withColumnRenamed("node", "doc_id")
    discard(rest, links, more)
    return rows.join(last, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


#: DuckDB SQL with the same rows, for the table documents: all pairs that share a shingle are counted, and labels go along the links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) m USING (doc_id)
"""

"""Operator 11: language-model scores by a hierarchical Pitman-Yor model of words and the words before them.

Every context word has a restaurant whose customers are the tokens that followed it in the training documents; all share one parent, a
restaurant of words whose customers are the tables below, above a uniform base over the V training words and one unknown one. Seating is sampled by Gibbs: given the
parent's sampled measure and an auxiliary gamma variable of each restaurant, the dishes of all restaurants are independent, so that Spark samples
them in parallel, in any order and place. Of a dish's seating only the number of tables bears on predictions; it is drawn for all customers of the dish at once from
its full conditional, which is proportional to S(c, t) a^t with generalised Stirling numbers S. Predictive probabilities are averaged over the rounds
after the burn-in.

Pairs of words are counted in blocks and meet at a home: a rare first word's, else a rare second word's, else one of their own, so that no frequent
word has all its pairs in one task. Which words count as common is read off a sample and decides on routes alone, never on results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import collect_shuffles, discard, materialise, mix64, short_batches, text_buffer, word_hashes

#: Common words, whose figures every task has; tokens of a block of documents, and of one home's share.
COMMON, BLOCK, SHARE = 65_535, 1 << 20, 1 << 21
#: Rounds of Gibbs sampling, those not averaged, and the strengths of both levels.
ROUNDS, BURN_IN, STRENGTH = 3, 1, 1.0
#: Dishes of more customers draw their tables from the saddle point of the same conditional.
EXACT = 1024
_END = np.uint64(0xA0761D6478BD642F)
_U, _W = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- draws, all decided by a key, so that a task that runs again draws the same ---


def _salted(key: np.ndarray, salt: int) -> np.ndarray:
    return mix64(key + np.uint64(salt * int(_U) % 2**64))


def uniforms(key: np.ndarray, salt: int) -> np.ndarray:
    return ((_salted(key, salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def normals(key: np.ndarray, salt: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniforms(key, 2 * salt))) * np.cos(2 * np.pi * uniforms(key, 2 * salt + 1))


def gammas(shape: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Gamma variables by squeezing a cubed normal; a shape below 1 is raised by 1 and its variable scaled down again."""
    key = _salted(key, -1 - salt)
    full = np.where(shape < 1, shape + 1, shape) - 1 / 3
    out, left, turn = np.zeros(len(shape)), np.arange(len(shape)), 1
    while len(left):
        x = normals(key[left], 2 * turn)
        v = (1 + x / np.sqrt(9 * full[left])) ** 3
        good = v > 0
        good[good] = np.log(uniforms(key[left[good]], 4 * turn + 3)) < 0.5 * x[good] ** 2 + full[left[good]] * (1 - v[good] + np.log(v[good]))
        out[left[good]] = full[left[good]] * v[good]
        left, turn = left[~good], turn + 1
    return out * np.where(shape < 1, uniforms(key, 1) ** (1 / np.maximum(shape, 1e-12)), 1.0)


_stirling: dict[float, np.ndarray] = {}


def log_stirling(discount: float) -> np.ndarray:
    """log S(c, t) for c and t up to EXACT, S(c+1, t) = S(c, t-1) + (c - discount * t) S(c, t)."""
    if discount not in _stirling:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[1, 1] = 0.0
        t = np.arange(1, EXACT + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in range(1, EXACT):
                out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + out[c, 1:])
        _stirling[discount] = out
    return _stirling[discount]


def _few(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    k = np.arange(260)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 260)))))
    below = np.cumsum(np.exp(k * np.log(np.maximum(mean, 1e-300))[:, None] - mean[:, None] - logs), 1)
    return (below < u[:, None]).sum(1)


def draw_tables(customers: np.ndarray, log_weight: np.ndarray, discount: float, key: np.ndarray, salt: int) -> np.ndarray:
    """Tables of dishes with so many customers, each from its conditional P(t) ~ S(c, t) exp(t * log_weight)."""
    out = np.minimum(customers, 1)
    u = uniforms(key, salt)
    table, width = log_stirling(discount), 2
    while width <= EXACT:
        at = np.flatnonzero((customers > width // 2) & (customers <= width) & (customers > 1))
        for begin in range(0, len(at), max(1, (1 << 19) // width)):
            part = at[begin : begin + max(1, (1 << 19) // width)]
            logs = table[customers[part], 1 : width + 1] + np.arange(1, width + 1) * log_weight[part, None]
            sums = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
            out[part] = np.minimum((sums < u[part, None] * sums[:, -1:]).sum(1) + 1, customers[part])
        width *= 2
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        # a sum of Poisson many table sizes, held to c: with y the tilt, a (1 - y) y^(d-1) = c; its tables but one have this mean and variance
        c, log_a, lo, hi = customers[many].astype(np.float64), log_weight[many], np.full(len(many), -700.0), np.zeros(len(many))
        for _ in range(80):
            y = (lo + hi) / 2
            above = log_a + np.log(-np.expm1(y)) + (discount - 1) * y > np.log(c)
            lo, hi = np.where(above, y, lo), np.where(above, hi, y)
        y = (lo + hi) / 2
        mean = np.exp(log_a) * -np.expm1(discount * y) / discount
        spread = c + np.exp(log_a + 2 * np.log(-np.expm1(y)) + (discount - 2) * y) * (1 - discount)
        sd = np.sqrt(np.maximum(mean - c * c / spread, 0))
        drawn = np.where(mean > 100, np.rint(mean + sd * normals(key[many], salt + 7)), _few(np.minimum(mean, 100), u[many])).astype(np.int64)
        out[many] = np.clip(1 + drawn, 1, customers[many])
    return out


# --- words, pairs and their homes ---


class Words:
    """The common words' hashes, sorted; their codes are places there. A rare word's symbol is its hash."""

    def __init__(self, hashes: np.ndarray, parts: int):
        self.hashes, self.parts = hashes, np.uint64(parts)
        places = (hashes >> np.uint64(44)).astype(np.int64)  # sorted, so the words of a place stand side by side
        self.first = np.searchsorted(places, np.arange(1 << 20)).astype(np.int32)
        self.deep = int(np.bincount(places, minlength=1).max(initial=1))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.where(hashes <= COMMON, hashes + np.uint64(COMMON + 1), hashes)
        first, last = self.first[(hashes >> np.uint64(44)).astype(np.int64)], len(self.hashes) - 1
        for step in range(self.deep):
            at = np.minimum(first + step, last)
            found = np.flatnonzero(self.hashes[at] == hashes)
            out[found] = at[found]
        return out

    def hashed(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < COMMON, self.hashes[np.minimum(symbols, len(self.hashes) - 1).astype(np.int64)], symbols)

    def homes(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (mix64(np.where(u >= COMMON, u, np.where(w >= COMMON, w, u * _U + w * _W))) % self.parts).astype(np.int64)

    def home(self, w: np.ndarray) -> np.ndarray:
        return (mix64(w) % self.parts).astype(np.int64)


def _pack(symbols: np.ndarray) -> tuple[bytes, bytes]:
    rare = symbols >= COMMON
    return np.where(rare, COMMON, symbols).astype(np.uint16).tobytes(), symbols[rare].tobytes()


def _unpack(codes: bytes, rare: bytes) -> np.ndarray:
    out = np.frombuffer(codes, np.uint16).astype(np.uint64)
    out[out == COMMON] = np.frombuffer(rare, np.uint64)
    return out


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


_FIELDS = ["b0", "b1", "b2", "b3", "b4", "b5", "b6", "b7", "b8"]
_SCHEMA = "home long, kind int, block long, " + ", ".join(f"{f} binary" for f in _FIELDS)
_PAIRS, _DOCS, _DISHES, _WORDS, _MAIL, _SUMS = range(6)


def _row(home: int, kind: int, block: int, *fields: bytes) -> pa.RecordBatch:
    values = [*fields, *[None] * (len(_FIELDS) - len(fields))]
    return pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([kind], pa.int32()), pa.array([block], pa.int64()), *(pa.array([f], pa.binary()) for f in values)], ["home", "kind", "block", *_FIELDS])


def _table(rows: list[pa.RecordBatch]) -> pa.Table:
    empty = pa.schema([("home", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), *((f, pa.binary()) for f in _FIELDS)])
    return pa.Table.from_batches(rows, empty)


def _block(words: Words, block: int, hashes: list, counts: list, ids: list, held: list, score: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a block of documents by home, with how often each stands in training documents and, to score, in each document."""
    n, held_ = np.concatenate(counts), np.concatenate(held)
    tokens = np.full(int(n.sum()) + len(n), _END)
    tokens[np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)] = np.concatenate(hashes)
    doc = np.repeat(np.arange(len(n)), n + 1)
    w = words.symbols(tokens)
    u = np.concatenate((words.symbols(np.array([_END])), w[:-1]))
    if not score:
        keep = ~held_[doc]
        u, w, doc = u[keep], w[keep], doc[keep]
    key = mix64(u * _U + mix64(w * _W))
    # by pair, within a pair by document. Pairs that share the upper bits may mix; a home then meets a pair in several rows of the block, which it adds up
    order = np.argsort(key & ~np.uint64(0xFFFF) | doc.astype(np.uint64))
    key, doc = key[order], doc[order]
    entries = _heads(key, doc) if score else _heads(key)
    times = np.diff(np.append(entries, len(key)))
    firsts = _heads(key[entries])
    u, w = u[order][entries[firsts]], w[order][entries[firsts]]
    trained = np.add.reduceat(times * ~held_[doc[entries]], firsts) if len(firsts) else times
    many = np.diff(np.append(firsts, len(entries)))
    homes = words.homes(u, w)
    by = np.argsort(homes.astype(np.uint64) << np.uint64(48) | mix64(u) >> np.uint64(16)) if int(words.parts) < 1 << 16 else np.lexsort((u, homes))
    homes = homes[by]
    for a, b in zip(starts := _heads(homes), np.append(starts[1:], len(homes)), strict=True):
        own = by[a:b]
        run = _heads(u[own])
        fields = [*_pack(u[own][run]), np.diff(np.append(run, len(own))).astype(np.uint32).tobytes(), *_pack(w[own]), trained[own].astype(np.uint32).tobytes()]
        if score:
            at = _spans(firsts[own], many[own])
            fields += [many[own].astype(np.uint32).tobytes(), doc[entries[at]].astype(np.uint16).tobytes(), times[at].astype(np.uint32).tobytes()]
        yield _row(int(homes[a]), _PAIRS, block, *fields)
    if score:
        column = pa.concat_arrays(ids)
        valid = np.array(column.is_valid())
        yield _row(-1 - block, _DOCS, block, column.fill_null(0).to_numpy().tobytes(), valid.tobytes(), held_.tobytes(), (n + 1).astype(np.int64).tobytes())


def _map(words, score: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        first, made = TaskContext.get().partitionId() << 32, 0
        hashes, counts, ids, held, size, docs = [], [], [], [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                h, n = word_hashes(*text_buffer(part.column("text")))
                hashes.append(h)
                counts.append(n)
                ids.append(part.column("doc_id"))
                held.append(np.array(part.column("held_out")))
                size, docs = size + len(h) + len(n), docs + len(n)
                if size >= BLOCK or docs > 60_000:
                    yield from _block(known, first + made, hashes, counts, ids, held, score)
                    hashes, counts, ids, held, size, docs, made = [], [], [], [], 0, 0, made + 1
        if docs:
            yield from _block(known, first + made, hashes, counts, ids, held, score)

    return run


def _read_pairs(group: pa.Table) -> Iterator[tuple]:
    """Of each row of pairs: block, first and second words, times in training documents, and the fields of documents."""
    for kind, block, *b in zip(*(group.column(n).to_pylist() for n in ("kind", "block", *_FIELDS)), strict=True):
        if kind == _PAIRS:
            yield block, np.repeat(_unpack(b[0], b[1]), np.frombuffer(b[2], np.uint32)), _unpack(b[3], b[4]), np.frombuffer(b[5], np.uint32).astype(np.int64), b[6:]


def _merge(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with their sums, and of each row its pair's place."""
    key = mix64(u * _U + mix64(w * _W))
    order = np.argsort(key)
    starts = _heads(key[order])
    of = np.empty(len(key), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    return u[order][starts], w[order][starts], np.add.reduceat(n[order], starts) if len(starts) else n, of


_COUNTS = "kind int, u long, w long, n long, m long"


def _count(group: pa.Table) -> pa.Table:
    """Rows of kind 0: dishes with two customers or more; 1 and 2: a word as context and as dish, its customers and dishes with one; 3: dishes with one and with two."""
    rows = [(u, w, n) for _, u, w, n, _ in _read_pairs(group)]
    u, w, c, _ = _merge(*(np.concatenate(x) for x in zip(*rows, strict=True)))
    u, w, c = u[c > 0], w[c > 0], c[c > 0]
    many = c > 1
    out = [(np.zeros(many.sum(), np.int32), u[many], w[many], c[many], c[many])]
    for kind, x in ((1, u), (2, w)):
        names, of = np.unique(x, return_inverse=True)
        ones = np.bincount(of, ~many, len(names)).astype(np.int64)
        keep = (names < COMMON) | (np.bincount(of, many, len(names)) > 0) if kind == 1 else np.ones(len(names), bool)
        out.append((np.full(keep.sum(), kind, np.int32), names[keep], names[keep], np.bincount(of, c, len(names)).astype(np.int64)[keep], ones[keep]))
    out.append((np.array([3], np.int32), *(np.zeros(1, np.uint64) for _ in range(2)), np.array([(c == 1).sum()]), np.array([(c == 2).sum()])))
    kind, u, w, n, m = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"kind": kind, "u": u.view(np.int64), "w": w.view(np.int64), "n": n.astype(np.int64), "m": m.astype(np.int64)})


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Short batches put together to longer ones."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _seat_parent(words, discount: float, log_weight: float, salt: int):
    """Of every word the tables of the parent's dish, and a gamma variable for its weight in the parent's measure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            w, c = _column(b, "w").view(np.uint64), _column(b, "c")
            key = words.value.hashed(w)
            t = draw_tables(c, np.full(len(c), log_weight), discount, key, salt)
            yield pa.RecordBatch.from_arrays([b.column("w"), b.column("c"), pa.array(t), pa.array(gammas(c - discount * t, key, salt + 1))], ["w", "c", "t", "g"])

    return run


def _seat(words, discount: float, strength: float, salt: int, kept: list[str], new: str | None):
    """New tables of dishes. Rows bring their restaurant's tables (tu) and their word's weight in the parent (g) where those are rare, and the
    kept samples, to which the new one is added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, aux, weight, rest, total = words.value
        for b in _gathered(batches):
            u, w, c = _column(b, "u").view(np.uint64), _column(b, "w").view(np.uint64), _column(b, "n")
            hu = known.hashed(u)
            x, g = np.nan_to_num(_column(b, "tu").astype(np.float64)), np.nan_to_num(_column(b, "g").astype(np.float64))
            rare = u >= COMMON
            x[rare] = gammas(strength / discount + x[rare], hu[rare], salt)
            x[~rare] = aux[u[~rare].astype(np.int64)]
            often = w < COMMON
            g[often] = weight[w[often].astype(np.int64)]
            t = draw_tables(c, np.log(discount * x) + np.log((g + rest) / total), discount, mix64(hu * _U + known.hashed(w)), salt)
            t = pa.array(t)
            names = ["u", "w", "n", *kept]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), t, *([t] if new else [])], [*names, "t", *([new] if new else [])])

    return run


def _dense(rows: list, name: str, size: int, *values: str) -> list[np.ndarray]:
    out = [np.zeros(size) for _ in values]
    at = np.array([r[name] for r in rows], np.int64)
    for o, v in zip(out, values, strict=True):
        o[at] = [r[v] for r in rows]
    return out


class Model:
    """What a fit leaves: tables of dishes (u, w, n, samples) and words (w, n, masses), and small figures for all tasks."""

    def __init__(self, **facts):
        self.__dict__.update(facts)


def _common_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the commonest words of one document in sixteen, and the end. They decide on routes alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sums = np.empty(0, np.uint64), np.empty(0, np.int64)
        for b in batches:
            h, _ = word_hashes(*text_buffer(b.column("text")))
            names, of = np.unique(np.concatenate((names, h)), return_inverse=True)
            sums = np.bincount(of, np.concatenate((sums, np.ones(len(h), np.int64))), len(names)).astype(np.int64)
            if len(names) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(sums)], ["w", "n"])
                names, sums = names[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(sums)], ["w", "n"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).select("text").mapInArrow(count, "w long, n long")
    rows = some.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(COMMON - 1).collect()
    return np.unique(np.append(np.array([r.w for r in rows], np.int64).view(np.uint64), _END))


def fit(docs: DataFrame, rounds: int = ROUNDS, burn_in: int = BURN_IN, strength: float = STRENGTH) -> Model:
    """Sample the seating for the training rows of docs (doc_id, text, held_out)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    common = _common_words(docs)
    size = docs.where("not held_out").agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(sc.defaultParallelism, -(-size // (4 * SHARE)))  # a word with its space has more than four characters or so
    words = sc.broadcast(Words(common, parts))
    pairs = docs.where("not held_out").mapInArrow(_map(words, False), _SCHEMA)
    counted = materialise(pairs.groupBy("home").applyInArrow(_count, _COUNTS))
    facts = counted.where("kind = 3").agg(F.sum("n").alias("one"), F.sum("m").alias("two")).first()
    bounded = lambda one, two: round(min(0.95, max(0.1, one / (one + 2 * two) if one else 0.5)), 6)
    low = bounded(facts.one or 0, facts.two or 0)
    vocabulary = materialise(counted.where("kind = 2").groupBy("w").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    contexts = counted.where("kind = 1").groupBy("u").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    dishes = materialise(counted.where("kind = 0").select("u", "w", "n", F.lit(1).cast("long").alias("t")))
    first = vocabulary.select("w", F.col("m").alias("c")).unionByName(dishes.select("w", F.col("t").alias("c"))).groupBy("w").agg(F.sum("c").alias("c"))
    heads = first.agg(F.sum((F.col("c") == 1).cast("long")).alias("one"), F.sum((F.col("c") == 2).cast("long")).alias("two"), F.count("*").alias("v")).first()
    high = bounded(heads.one or 0, heads.two or 0)
    tokens, v = vocabulary.agg(F.sum("n")).first()[0] or 0, heads.v
    is_common = lambda name: (F.col(name) >= 0) & (F.col(name) < COMMON)
    own = {r.u: (r.n, r.m) for r in contexts.where(is_common("u")).collect()}  # at most COMMON rows
    customers, singles = (np.array([own.get(u, (0, 0))[i] for u in range(COMMON)], np.float64) for i in (0, 1))
    key = np.append(common, np.zeros(COMMON - len(common), np.uint64))
    rare_singles = contexts.where(~is_common("u")).select("u", F.col("m").alias("t"))
    in_parent, parent_tables, masses, totals, kept = None, float(v), [], [], []
    # a word with one customer has one table, always; it has no dish to seat, so that of all such words only the sum of their weights is drawn
    lonely = vocabulary.where("n = 1").count()
    several = vocabulary.where("n > 1").select("w", F.col("m").alias("c"))
    for turn in range(rounds + 1):
        salt = 100 * (turn + 1)
        # the parent: its customers are the tables below
        below = several.unionByName(dishes.select("w", F.col("t").alias("c"))).groupBy("w").agg(F.sum("c").alias("c"))
        aux = float(gammas(np.array([strength / high + parent_tables]), np.array([np.uint64(1)]), salt)[0])
        before, in_parent = in_parent, materialise(below.mapInArrow(_seat_parent(words, high, float(np.log(high * aux / (v + 1))), salt), "w long, c long, t long, g double"))
        if before is not None and before not in masses:
            discard(before)
        sums = in_parent.agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.sum("g").alias("g")).first()
        parent_tables = float(sums.t or 0) + lonely
        weights = (sums.g or 0.0) + float(gammas(np.array([lonely * (1 - high)]), np.array([np.uint64(3)]), salt)[0] if lonely else 0.0)
        if turn > burn_in:
            masses.append(in_parent)
            totals.append((float(sums.c or 0) + lonely, parent_tables))
        if turn == rounds:
            break
        rest = float(gammas(np.array([strength + high * parent_tables]), np.array([np.uint64(2)]), salt)[0])
        (weight,) = _dense(in_parent.where(is_common("w")).select("w", "g").collect(), "w", COMMON, "g")
        (tables,) = _dense(dishes.where(is_common("u")).groupBy("u").agg(F.sum("t").alias("t")).collect(), "u", COMMON, "t")
        shared = sc.broadcast((words.value, gammas(strength / low + tables + singles, key, salt + 50), weight, rest / (v + 1), weights + rest))
        tu = dishes.where(~is_common("u")).select("u", "t").unionByName(rare_singles).groupBy("u").agg(F.sum("t").cast("double").alias("tu"))
        g = in_parent.where(~is_common("w")).select("w", "g")
        left, left_rare = dishes.where(is_common("u")).withColumn("tu", F.lit(None).cast("double")), dishes.where(~is_common("u")).join(tu, "u")
        both = left.unionByName(left_rare)
        routed = both.where(is_common("w")).withColumn("g", F.lit(None).cast("double")).unionByName(both.where(~is_common("w")).join(g, "w"))
        new = f"s{turn}" if turn + 1 > burn_in else None
        schema = ", ".join(f"{c} long" for c in ["u", "w", "n", *kept, "t", *([new] if new else [])])
        before, dishes = dishes, materialise(routed.mapInArrow(_seat(shared, low, strength, salt + 50, list(kept), new), schema))
        kept += [new] if new else []
        discard(before)
        shared.unpersist()
    named = vocabulary.where("n > 1").select("w", "n")
    for i, m in enumerate(masses):
        named = named.join(m.select("w", (F.col("c") - high * F.col("t")).alias(f"mass{i}")), "w")
    alone = vocabulary.where("n = 1").select("w", "n", F.array(*[F.lit(1 - high)] * len(masses)).alias("masses"))
    named = materialise(named.select("w", "n", F.array(*(f"mass{i}" for i in range(len(masses)))).alias("masses")).unionByName(alone))
    discard(*masses, vocabulary, counted)
    count = len(masses)
    often = named.where(is_common("w")).collect()
    seen, mass = np.zeros(COMMON), np.zeros((count, COMMON))
    for r in often:
        seen[r.w], mass[:, r.w] = r.n, r.masses
    tables = np.repeat(singles[None], count, 0)
    for r in dishes.where(is_common("u")).groupBy("u").agg(*(F.sum(c).alias(c) for c in kept)).collect():
        tables[:, r.u] += [r[c] for c in kept]
    # the parent's predictive probability of a word is (its mass + spread) * scale, per sample
    scale = np.array([1 / (strength + c) for c, _ in totals])
    spread = np.array([(strength + high * t) / (v + 1) for _, t in totals])
    small = dict(words=words.value, low=low, strength=strength, customers=customers, tables=tables, seen=seen, mass=mass, scale=scale, spread=spread, tokens=tokens, v=v)
    return Model(dishes=dishes.select("u", "w", *kept), named=named, words=words, small=small, parts=parts, high=high, low=low)


def _by_home(words, kind: int, count: int):
    """Rows of dishes or rare words, packed by home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for b in _gathered(batches, 1 << 20):
            w = _column(b, "w").view(np.uint64)
            if kind == _DISHES:
                u = _column(b, "u").view(np.uint64)
                homes, columns = known.homes(u, w), [u, w, np.stack([_column(b, n) for n in b.schema.names[2:]], 1).astype(np.uint32)]
            else:
                homes, columns = known.home(w), [w, _column(b, "n"), b.column("masses").flatten().to_numpy(zero_copy_only=False).reshape(-1, count)]
            order = np.argsort(homes, kind="stable")
            homes = homes[order]
            for a, e in zip(starts := _heads(homes), np.append(starts[1:], len(homes)), strict=True):
                yield _row(int(homes[a]), kind, 0, *(x[order[a:e]].tobytes() for x in columns))

    return run


def _word_table(group: pa.Table, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rare words of a home, sorted, how often each stands in training documents, and their masses."""
    rows = [(w, n, m) for k, w, n, m in zip(*(group.column(c).to_pylist() for c in ("kind", "b0", "b1", "b2")), strict=True) if k == _WORDS]
    w = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r[0], np.uint64) for r in rows)])
    n = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r[1], np.int64) for r in rows)])
    m = np.concatenate([np.empty((0, count)), *(np.frombuffer(r[2]).reshape(-1, count) for r in rows)])
    order = np.argsort(w)
    return w[order], n[order], m[order]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _sum_row(block: int, doc: np.ndarray, times: np.ndarray, log_p: np.ndarray, seen: np.ndarray, s: dict) -> pa.RecordBatch:
    """What a home adds to its documents' sums."""
    base = np.log10((seen + 0.5) / (s["tokens"] + 0.5 * (s["v"] + 1)))
    n = int(doc.max()) + 1
    touched = np.flatnonzero(np.bincount(doc, minlength=n))
    sums = [np.bincount(doc, times * x, n)[touched] for x in (log_p, base, seen > 0)]
    return _row(-1, _SUMS, block, touched.astype(np.uint16).tobytes(), sums[0].tobytes(), sums[1].tobytes(), sums[2].astype(np.uint32).tobytes())


def _predict(small, count: int):
    """At a home: predictive probabilities of its pairs, summed by document; pairs of two rare words go on to the second word's home."""

    def run(group: pa.Table) -> pa.Table:
        s = small.value
        rows = list(_read_pairs(group))
        if not rows:
            return _table([])
        u, w, c, of = _merge(*(np.concatenate([r[i] for r in rows]) for i in (1, 2, 3)))
        t = np.repeat(np.minimum(c, 1)[:, None], count, 1)
        dishes = [(a, b, d) for k, a, b, d in zip(*(group.column(x).to_pylist() for x in ("kind", "b0", "b1", "b2")), strict=True) if k == _DISHES]
        if dishes:
            keys = np.concatenate([mix64(np.frombuffer(a, np.uint64) * _U + mix64(np.frombuffer(b, np.uint64) * _W)) for a, b, _ in dishes])
            order = np.argsort(keys)
            at, there = _find(keys[order], mix64(u * _U + mix64(w * _W)))
            t[there] = np.concatenate([np.frombuffer(d, np.uint32).reshape(-1, count) for *_, d in dishes])[order][at[there]]
        rare_u, rare_w = u >= COMMON, w >= COMMON
        customers, tables = np.empty(len(u)), np.empty((len(u), count))
        code = u[~rare_u].astype(np.int64)
        customers[~rare_u], tables[~rare_u] = s["customers"][code], s["tables"][:, code].T
        _, name = np.unique(u[rare_u], return_inverse=True)
        customers[rare_u] = np.bincount(name, c[rare_u])[name] if len(name) else 0
        for i in range(count):
            tables[rare_u, i] = np.bincount(name, t[rare_u, i])[name] if len(name) else 0
        below = (s["strength"] + customers)[:, None]
        share = ((c[:, None] - s["low"] * t) / below).mean(1)
        handed = (s["strength"] + s["low"] * tables) / below / count
        mass, seen = np.zeros((len(w), count)), np.zeros(len(w))
        code = w[~rare_w].astype(np.int64)
        mass[~rare_w], seen[~rare_w] = s["mass"][:, code].T, s["seen"][code]
        names, times, masses = _word_table(group, count)
        here = np.flatnonzero(rare_w & ~rare_u)
        at, there = _find(names, w[here])
        mass[here[there]], seen[here[there]] = masses[at[there]], times[at[there]]
        log_p = np.log10(share + (handed * (mass + s["spread"]) * s["scale"]).sum(1))
        away = rare_u & rare_w
        out, go, first = [], [], 0
        for block, own_u, _, _, (many, doc, m) in rows:
            pair = np.repeat(of[first : first + len(own_u)], np.frombuffer(many, np.uint32))
            first += len(own_u)
            doc, m = np.frombuffer(doc, np.uint16).astype(np.int64), np.frombuffer(m, np.uint32).astype(np.int64)
            stay = ~away[pair]
            if stay.any():
                out.append(_sum_row(block, doc[stay], m[stay], log_p[pair[stay]], seen[pair[stay]], s))
            go.append((pair[~stay], np.full((~stay).sum(), block), doc[~stay], m[~stay]))
        p, blocks, doc, m = (np.concatenate(x) for x in zip(*go, strict=True))
        if not len(p):
            return _table(out)
        homes = s["words"].home(w[p])
        order = np.argsort(homes, kind="stable")
        homes = homes[order]
        for a, b in zip(starts := _heads(homes), np.append(starts[1:], len(homes)), strict=True):
            own = order[a:b]
            q = p[own]
            out.append(_row(int(homes[a]), _MAIL, 0, w[q].tobytes(), share[q].tobytes(), handed[q].tobytes(), blocks[own].tobytes(), doc[own].astype(np.uint16).tobytes(), m[own].astype(np.uint32).tobytes()))
        return _table(out)

    return run


def _predict_mail(small, count: int):
    """At the second word's home: pairs of two rare words."""

    def run(group: pa.Table) -> pa.Table:
        s = small.value
        names, times, masses = _word_table(group, count)
        mail = [b for kind, *b in zip(*(group.column(n).to_pylist() for n in ("kind", *_FIELDS[:6])), strict=True) if kind == _MAIL]
        if not mail:
            return _table([])
        kinds = (np.uint64, np.float64, np.float64, np.int64, np.uint16, np.uint32)
        w, share, handed, blocks, doc, m = (np.concatenate([np.frombuffer(b[i], k) for b in mail]) for i, k in enumerate(kinds))
        at, there = _find(names, w)
        mass, seen = np.zeros((len(w), count)), np.zeros(len(w))
        mass[there], seen[there] = masses[at[there]], times[at[there]]
        log_p = np.log10(share + (handed.reshape(-1, count) * (mass + s["spread"]) * s["scale"]).sum(1))
        order = np.argsort(blocks, kind="stable")
        starts = _heads(blocks[order])
        own = [order[a:b] for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True)]
        return _table([_sum_row(int(blocks[o[0]]), doc[o].astype(np.int64), m[o].astype(np.int64), log_p[o], seen[o], s) for o in own])

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _add_up(group: pa.Table) -> pa.Table:
    """The documents of a block with their sums."""
    rows = list(zip(*(group.column(n).to_pylist() for n in ("kind", *_FIELDS[:4])), strict=True))
    _, ids, valid, held, n = next(r for r in rows if r[0] == _DOCS)
    ids, n = np.frombuffer(ids, np.int64), np.frombuffer(n, np.int64)
    score, base, known = (np.zeros(len(ids)) for _ in range(3))
    for kind, doc, a, b, k in sorted(rows, key=lambda r: (r[0], r[1])):  # one order, whatever the tasks' order
        if kind == _SUMS:
            at = np.frombuffer(doc, np.uint16)
            score[at] += np.frombuffer(a)
            base[at] += np.frombuffer(b)
            known[at] += np.frombuffer(k, np.uint32)
    return pa.table(
        {"doc_id": pa.array(ids, mask=~np.frombuffer(valid, bool)), "held_out": np.frombuffer(held, bool), "n_tokens": n, "n_known": known.astype(np.int64), "base_score": base, "score": score}
    )


def lm_scores(docs: DataFrame, rounds: int = ROUNDS, burn_in: int = BURN_IN, strength: float = STRENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all texts: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a document.

    Tokens are words (runs of bytes other than 20 and 09-0D, A-Z lower-cased) and one end a document; contexts are the words before, at the
    start the end. The model learns from rows that are not held out (crc32 of the id as text modulo 5 is 1; a null id counts as no text). score is the log10
    probability of the text under the averaged predictive probabilities, base_score that of smoothed frequencies of words; a document's perplexity is
    10 ** (-score / n_tokens). Discounts are estimated from the counts of one and two of either level; strength is that of both levels.
    A null text is empty: its end alone is scored. Repeated rows and ids, and null ids, each keep a row. Without training rows all
    probabilities are 1 (one word, the unknown one). An empty table gives an empty result. Other columns are ignored. Words are
    told apart by 64-bit hashes. The same rows give the same scores, however they are dealt out."""
    spark = docs.sparkSession
    short_batches(spark)
    held = F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"))
    model = fit(source, rounds, burn_in, strength)
    collect_shuffles(spark)
    count = len(model.small["scale"])
    small = spark.sparkContext.broadcast(model.small)
    rare = model.named.where(~((F.col("w") >= 0) & (F.col("w") < COMMON))).mapInArrow(_by_home(model.words, _WORDS, count), _SCHEMA)
    dishes = model.dishes.mapInArrow(_by_home(model.words, _DISHES, count), _SCHEMA)
    mapped = source.mapInArrow(_map(model.words, True), _SCHEMA)
    met = materialise(mapped.unionByName(dishes).unionByName(rare).groupBy("home").applyInArrow(_meet(small, count), _SCHEMA))
    mail = met.where(F.col("kind") == _MAIL).unionByName(rare).groupBy("home").applyInArrow(_predict_mail(small, count), _SCHEMA)
    sums = met.where(F.col("kind") != _MAIL).unionByName(mail)
    out = sums.groupBy("block").applyInArrow(_add_up, _RESULT)
    tokens = F.lit(int(model.small["tokens"])).cast("long").alias("train_tokens")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", tokens, "base_score", "score")


def _meet(small, count: int):
    """Homes predict; rows of documents pass through."""
    predict = _predict(small, count)

    def run(group: pa.Table) -> pa.Table:
        return group if group["kind"][0].as_py() == _DOCS else predict(group)

    return run

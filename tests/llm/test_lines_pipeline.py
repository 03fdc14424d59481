import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("skein.llm.line_dedup")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from skein.llm import line_dedup  # noqa: E402
from skein.llm.line_dedup import dedup_lines, keep_lines  # noqa: E402


def grams(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def brute(data):
    """Texts after one line of each component stays."""
    place = {}
    for d, t in sorted((x for x in data if x[0] is not None), key=lambda x: x[0]):
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r"):
                place.setdefault(line.strip(" \t\r"), (d, i))
    lines = sorted(place, key=place.get)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {x: grams(x) for x in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)), key=place.get)
                root[y] = x
    keep = {place[find(x)] for x in lines}
    out = {}
    for d, t in data:
        if d is not None and t is not None:
            out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if not x.strip(" \t\r") or (d, i) in keep)
        else:
            out[d] = t
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioust nrlé") for _ in range(rng.randrange(3, 9))).strip() or "x" for _ in range(n))


def test_lines_match_brute_force(spark):
    rng = random.Random(8)
    pool = [prose(rng, rng.randrange(8, 30)) for _ in range(25)] + ["ab", "abcd", "Title"]
    data = []
    for i in range(60):
        own = [rng.choice(pool) if rng.random() < 0.5 else prose(rng, 12) for _ in range(rng.randrange(0, 8))]
        own = [x + rng.choice(["", "", "!", "\r", " "]) if rng.random() < 0.6 else x[:-1] + "z" for x in own]
        data.append((i * 7 - 20, "\n".join(own + rng.choice([[], [""], ["  "]]))))
    data += [(1000, None), (1001, ""), (None, pool[0]), (1002, ("w%d " * 9000) % tuple(range(9000)) + "\n" + pool[0])]
    df = spark.createDataFrame([(t, d, 1, "x") for d, t in data], "text string, doc_id long, pos long, line string").repartition(4)
    got = dedup_lines(df).collect()
    want = brute(data)
    assert len(got) == len(data)
    assert {r.doc_id: r.text for r in got} == want
    assert all((r.n_lines, r.n_kept) == (len(t.split("\n")) if (t := dict(data)[r.doc_id]) is not None else 0, r.n_lines - len(r.removed)) for r in got)
    assert dedup_lines(df.where("false")).count() == 0


def test_recall_at_the_threshold(spark):
    rng = random.Random(12)
    pairs = []
    while len(pairs) < 1000:
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([40, 60, 100, 200])))
        b = list(a)
        for _ in range(len(a) // 30):
            b[rng.randrange(len(a))] = rng.choice("0123456789")
        x, y = grams(a), grams("".join(b))
        if 75 * len(x | y) <= 100 * len(x & y) <= 78 * len(x | y):
            pairs.append((a, "".join(b)))
    data = [(i, line) for i, line in enumerate(x for p in pairs for x in p)]
    got = dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    gone = {r.doc_id for r in got if r.n_kept == 0}
    assert gone <= set(range(1, 2000, 2))
    assert len(gone) >= 970


def test_many_near_copies_cost_their_number(spark):
    base = "the quick brown fox jumps over the lazy dog and runs along the river bank until night falls again"
    data = [(i, base + f" {i:04d}") for i in range(400)]
    got = dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_kept} == {0}


def test_a_common_passage_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(3)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = own(200)
    lines = [own(rng.randrange(60, 80)) + passage for _ in range(200)]  # alike by 0.55 to 0.62
    lines += [x[:30] + "#" + x[31:] for x in lines[:10]]
    seen, plain = [], line_dedup._verified

    def counted(lines, pairs, num, den):
        seen.append(pairs.count())
        return plain(lines, pairs, num, den)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    monkeypatch.setattr(line_dedup, "_LARGE", 12)
    data = list(enumerate(lines))
    got = dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == brute(data)
    assert seen[1] < 1000


def test_lines_that_only_share_buckets_get_no_finer_sketch(spark, monkeypatch):
    rng = random.Random(4)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = own(100)
    lines = [own(130) + passage for _ in range(250)]  # alike by some 0.27: they meet in buckets, but few of their minima agree
    seen, plain = [], line_dedup._finer

    def counted(lines, ids):
        seen.append(ids.count())
        return plain(lines, ids)

    monkeypatch.setattr(line_dedup, "_finer", counted)
    monkeypatch.setattr(line_dedup, "_LARGE", 3)
    monkeypatch.setattr(line_dedup, "_SMALL", 2)
    data = list(enumerate(lines))
    got = dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == brute(data)
    assert seen[0] < 10, seen


def test_finer_sketches_lose_no_similar_pair(spark):
    rng = random.Random(6)
    lines = []
    for _ in range(60):
        a = prose(rng, rng.randrange(8, 200))
        b = list(a)
        for _ in range(rng.randrange(0, 1 + len(a) // 25)):
            b[rng.randrange(len(b))] = rng.choice("0123456789")
        lines += [a, "".join(b)]
    table = spark.createDataFrame(list(enumerate(lines)), "pos long, line string").localCheckpoint()
    finer = line_dedup._finer(table, table.select("pos")).localCheckpoint()
    assert {r.pos: r.size for r in finer.select("pos", "size").collect()} == {i: len(grams(x)) for i, x in enumerate(lines)}
    x, y = (finer.select([F.col(c).alias(f"{side}{c}") for c in finer.columns]) for side in "xy")
    passed = {(r.xpos, r.ypos) for r in x.join(y, F.col("xpos") < F.col("ypos")).where(line_dedup._close("x", "y", 75, 100)).select("xpos", "ypos").collect()}
    sets = [grams(x) for x in lines]
    alike = {(i, j) for j in range(len(lines)) for i in range(j) if 175 * len(sets[i] & sets[j]) >= 75 * (len(sets[i]) + len(sets[j]))}
    assert len(alike) >= 20 and alike <= passed and len(passed) <= 2 * len(alike)


def test_any_ids_and_clashing_columns(spark):
    line = "the quick brown fox jumps over the lazy dog and runs along the river bank"
    data = [(2**62, line), (-(2**62), line + "!"), (7, "own line here\n" + line), (7, "own line here\n" + line), (8, None), (None, line)]
    df = spark.createDataFrame([(d, t, "r", 5, 6, "p") for d, t in data], "doc_id long, text string, removed string, n_lines int, n_kept int, pos string")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert set(dedup_lines(df).columns) == {"doc_id", "text", "pos", "n_lines", "n_kept", "removed"}
    assert got[2**62].text == "" and got[-(2**62)].text == line + "!" and got[7].text == "own line here" and got[None].text == line and got[8].text is None
    assert [(x.line, x.kept_doc, x.kept_line) for x in got[7].removed] == [(1, -(2**62), 0)]
    kept = keep_lines(df).collect()
    assert keep_lines(df).columns == df.columns and all((r.removed, r.n_lines, r.n_kept, r.pos) == ("r", 5, 6, "p") for r in kept)
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(["7", "7", "8", "None", str(-(2**62))])


def test_split_buckets_lose_nothing(spark, monkeypatch):
    rng = random.Random(2)
    base = [prose(rng, 20) for _ in range(4)]
    lines = []
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        lines.append(" ".join(words))
    data = list(enumerate(lines))
    df = spark.createDataFrame(data, "doc_id long, text string")
    whole = {r.doc_id: r.n_kept for r in dedup_lines(df, with_text=False).collect()}
    monkeypatch.setattr(line_dedup, "_BUCKET_ROWS", 5)
    monkeypatch.setattr(line_dedup, "_LARGE", 3)
    split = {r.doc_id: r.n_kept for r in dedup_lines(df, with_text=False).collect()}
    want = brute(data)
    assert split == whole
    assert sum((n > 0) != (want[d] != "") for d, n in whole.items()) <= 2


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    clean = [" ".join(prose(rng, 10).capitalize() + "." for _ in range(6)) for _ in range(260)]
    clean[10] = clean[10] + "\npassword=b7db7aa4a5fcc78305"
    clean[20] = clean[11] + "\n" + prose(rng, 12)  # its first line is another document's
    junk = [" ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for _ in range(60)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean + junk)]
    labels = [(i, int(i < 260), 0) for i in range(320) if i % 2]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, str(tmp_path)))
        seen[name] = now
        assert name == "packing" or now.columns == columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert len(ids["quality"] & set(range(260))) >= 250 and len(ids["quality"] - set(range(260))) <= 3
    after = {r.doc_id: r for r in seen["lines"].collect()}
    assert "\n" not in after[20].text and all(r.n_chars == len(r.text) for r in after.values())
    assert "b7db7aa4a5fcc78305" not in {r.doc_id: r.text for r in seen["secrets"].collect()}.get(10, "")
    assert ids["packing"] == ids["secrets"] == ids["near_duplicates"]
    assert seen["packing"].groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    good = "The quick brown fox jumps over the lazy dog, and then it sleeps for some hours in the shade. "
    data = [(i, good + f"It met {i} others on its way home that day.", "en", "s", 1, "x") for i in range(40)] + [(i, "BUY!! NOW!! " * 30, "en", "s", 1, "x") for i in range(40, 60)]
    data += [(None, good, None, None, None, None), (60, None, "en", None, 0, "y"), (61, "", None, "s", 0, "y"), (1, data[1][1], "en", "s", 1, "x"), (62, "word " * 40_000, "en", "s", 1, "x")]
    labels = [(i, int(i < 40), 0) for i in range(60)] + [(None, 1, None), (1, 1, 0), (61, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, removed string"
    spark.createDataFrame(data if rows == "odd" else [], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels if rows == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, str(tmp_path)))
        assert name == "packing" or now.columns == columns
    assert (now.count() > 0) == (rows == "odd")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()

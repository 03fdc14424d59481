"""Streams into tables that change together, and the think filter."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions.text import without_thoughts
from skein.sources.stores import Stores
from skein.streaming import ledger, thoughts


def arriving(df, path, once=1):
    df.write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", once).parquet(path)


def test_any_cut_shows_the_same(spark):
    texts = ["<think>a</think>b", "x<THINK>y</Think> z <think>open", "no block at all, but < and <thin are shown", "</think> alone", "<think></think>", "", "a<think>b</think>" * 3 + "tail"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wanted = [r[0] for r in df.select(without_thoughts(F.col("t"))).collect()]
    rng = random.Random(2)
    for text, want in zip(texts, wanted, strict=True):
        for _ in range(60):
            cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 8)))
            held, inside, shown = "", False, ""
            for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
                more, held, inside = thoughts.feed(held, inside, text[a:b])
                shown += more
            assert (shown + ("" if inside else held)).strip() == want


def test_pieces_out_of_order_and_again(spark, tmp_path):
    pieces = [("a", 0, "hi <thi", False), ("a", 2, "t</think> you and others", True), ("b", 0, "plain", True), ("a", 1, "nk>secre", False), ("a", 1, "nk>secre", False), ("c", 1, "never starts", True)]
    path = str(tmp_path / "in")
    schema = "answer_id string, seq long, piece string, last boolean"
    for p in pieces:
        spark.createDataFrame([p], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with thoughts.named_states(spark):
        thoughts.shown_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    shown = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.answer_id, r.seq)):
        shown[r.answer_id] = shown.get(r.answer_id, "") + r.shown
    assert shown == {"a": "hi  you and others", "b": "plain"}


def test_a_killed_batch_is_taken_up_again(spark, tmp_path):
    rows = [(f"f{i % 4}", i) for i in range(20)]
    df = spark.createDataFrame(rows, "source_file string, n int")
    keys = {"chunks": "source_file", "ledger": "source_file"}

    def run(name, fail):
        stores = Stores(spark, str(tmp_path / name), keys)
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        left = [fail]

        def prepare(batch):
            if left[0]:
                left[0] -= 1
                raise RuntimeError("worker lost")
            return batch.withColumn("twice", F.col("n") * 2)

        for _ in range(fail):
            with pytest.raises(Exception, match="worker lost"):
                ledger.ingest(stream, stores, str(tmp_path / f"cp-{name}"), prepare)
            states = {(r.status, r.reason) for r in ledger.ledger(stores).collect()}
            assert states == {("failed", "RuntimeError: worker lost")} and stores.table("chunks") is None
        ledger.ingest(stream, stores, str(tmp_path / f"cp-{name}"), prepare)
        return stores

    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    clean, killed = run("clean", 0), run("killed", 2)
    table = lambda s: sorted(map(tuple, s.table("chunks").collect()))
    assert table(clean) == table(killed) == sorted((f, n, 2 * n) for f, n in rows)
    marks = lambda s: sorted((r.source_file, r.status, r.attempts, r.n_rows, r.reason) for r in ledger.ledger(s).collect())
    assert marks(clean) == [(f"f{i}", "ok", 1, 5, None) for i in range(4)] and marks(killed) == [(f"f{i}", "ok", 3, 5, None) for i in range(4)]
    # files that are ok are left out, new ones come in
    stream = arriving(spark.createDataFrame([("f0", 99), ("f9", 7)], df.schema).coalesce(1), str(tmp_path / "in"))
    ledger.ingest(stream, clean, str(tmp_path / "cp-clean"), lambda b: b.withColumn("twice", F.col("n") * 2))
    assert table(clean) == sorted([(f, n, 2 * n) for f, n in rows] + [("f9", 7, 14)])


def test_counts_after_late_and_repeated_files(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 5, "view" if i % 4 else "click") for i in range(60)] + [(100, None, "view")], "event_id long, user_id long, event_type string")
    stores, path, place = Stores(spark, str(tmp_path / "s"), {"plays": "user_id"}), str(tmp_path / "in"), str(tmp_path / "cp")
    stream = arriving(events.where("event_id < 30").repartition(3), path)
    ledger.run_counts(stream, stores, place, "user_id", event_id="event_id")
    arriving(events.where("event_id >= 20").repartition(2), path)  # late ones, and ten again
    got = ledger.run_counts(stream, stores, place, "user_id", event_id="event_id")
    want = events.where("event_type = 'view' and user_id is not null").groupBy("user_id").agg(F.count("*").alias("plays"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, ledger.run_counts(stream, stores, place, "user_id", event_id="event_id").collect())) == sorted(map(tuple, want.collect()))


def test_an_answer_costs_few_state_messages_a_batch():
    """Not some a piece: each call of a state is a message to the JVM."""
    calls = []

    class State:
        """A value, list or map state; start is what get() gives before anything is put."""

        def __init__(self, start=None):
            self.held, self.map = start, {}

        def __getattribute__(self, name):
            if name not in ("held", "map"):
                calls.append(name)
            return object.__getattribute__(self, name)

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

        put = update

        def appendList(self, x):  # noqa: N802
            self.held = [*self.held, *x]

        def clear(self):
            self.held = []

        def updateValue(self, key, x):  # noqa: N802
            self.map[key] = x

        def containsKey(self, key):  # noqa: N802
            return key in self.map

        def getValue(self, key):  # noqa: N802
            return self.map[key]

        def removeKey(self, key):  # noqa: N802
            del self.map[key]

    class Handle:
        def getValueState(self, *schema):  # noqa: N802
            return State()

        def getListState(self, *schema):  # noqa: N802
            return State([])

        getMapState = getValueState  # noqa: N815

    text = "seen <think>not</think> again " * 50
    pieces = [{"seq": i, "piece": text[7 * i : 7 * i + 7], "last": 7 * i + 7 >= len(text)} for i in range(-(-len(text) // 7))]
    shown = thoughts._Shown()
    shown.init(Handle())
    got = [r for batch in (pieces[1::2], pieces[::2]) for r in shown.handleInputRows(("a",), iter(batch), None)]
    assert "".join(r["shown"] for r in got) == "seen  again " * 50
    assert len(calls) <= 10

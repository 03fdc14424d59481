"""Answers that arrive in pieces, without the model's thoughts: a think block may begin and end anywhere, its marks split between pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OPEN, _CLOSE = re.compile(r"<think>", re.I), re.compile(r"</think>", re.I)
#: Characters held back outside and inside a block, since a mark may go on in the next piece.
HELD_OUTSIDE, HELD_INSIDE = 8, 16


def feed(held: str, inside: bool, piece: str) -> tuple[str, str, bool]:
    """What can be shown after a piece, what is held back, and whether a block is open."""
    held, shown = held + piece, ""
    while True:
        mark = (_CLOSE if inside else _OPEN).search(held)
        if not mark:
            if inside:
                return shown, held[-HELD_INSIDE:], True
            cut = max(0, len(held) - HELD_OUTSIDE)
            return shown + held[:cut], held[cut:], False
        if not inside:
            shown += held[: mark.start()]
        held, inside = held[mark.end() :], not inside


class _Shown(StatefulProcessor):
    """Per answer: the held characters, whether a block is open and the number of the next piece; pieces that came early wait in a list.

    Each call of the state store is a message to the JVM, so the pieces of a batch are put in order here: an answer costs a few messages a batch, not some a
    piece. The list is read only when the piece that it waits for has come, and appended to otherwise."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reached = handle.getValueState("reached", "held string, inside boolean, next long")
        self.early = handle.getListState("early", "seq long, piece string, last boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, inside, at = self.reached.get() or ("", False, 0)
        new = {int(r["seq"]): (r["piece"] or "", bool(r["last"])) for r in rows}
        new = {seq: piece for seq, piece in new.items() if seq >= at}  # a piece that comes again changes nothing
        if at not in new:
            if new:
                self.early.appendList([(seq, *piece) for seq, piece in new.items()])
            return
        waiting = {seq: (piece, last) for seq, piece, last in self.early.get()}
        ready, first, shown, done = waiting | new, at, [], False
        while not done and at in ready:
            piece, done = ready.pop(at)
            more, held, inside = feed(held, inside, piece)
            shown.append(more)
            at += 1
        if done:
            shown.append("" if inside else held)
            held = ""
        left = [(seq, *piece) for seq, piece in ready.items() if seq >= at]
        if left:
            self.early.put(left)
        elif waiting:
            self.early.clear()
        self.reached.update((held, inside, at))
        if text := "".join(shown):
            yield Row(answer_id=key[0], seq=first, shown=text)

    def close(self) -> None:
        pass


def shown_stream(pieces: DataFrame) -> DataFrame:
    """Of a stream of pieces (answer_id, seq from 0, piece, last) what may be shown, as it can be: (answer_id, seq of the first new piece, shown).

    Joined in the order of seq, what is shown of an answer is its text without think blocks, however it was cut and in whatever order its pieces came.
    Needs the RocksDB state store; see named_states."""
    each = pieces.select("answer_id", F.col("seq").cast("long").alias("seq"), "piece", F.coalesce("last", F.lit(False)).alias("last"))
    kind = pieces.schema["answer_id"].dataType.simpleString()
    return each.groupBy("answer_id").transformWithState(_Shown(), f"answer_id {kind}, seq long, shown string", "Append", "None")


@contextmanager
def named_states(spark: SparkSession) -> Iterator[None]:
    """Use the state store that processors with named states need for the streams started inside; the session's choice comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)

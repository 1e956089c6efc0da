"""Event streams with state for each stream: frames that are cut anywhere, and tokens that are shown while a model speaks.

Both are keyed stateful operators of Structured Streaming. What a stream needs of its past (its unfinished frame, or what was said so far, and pieces that came before their
turn) is kept in the state store with that of at most 1,023 neighbours, so a query that is stopped goes on where it was, and streams are dealt over all machines.

Defined cases: pieces may come in any order and more than once, over any number of batches; a piece without content is passed over; a frame that isn't whole yet stays in the state; a
character cut in two is put together; a frame that isn't JSON has its number and is left out of the events; without pieces there is nothing.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import FRAME

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BREAK = b"\n\n"


@contextlib.contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """State variables need the RocksDB store; set while a query starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


#: Streams whose ids differ in their last bits alone, as many as this, share a key. A call of a processor and a word with the state store cost about as much as a thousand
#: pieces, so a key for each stream would cost most of the time.
NEIGHBOURS = 10


def by_block(rows: DataFrame, stream: str) -> GroupedData:
    return rows.withColumn("block", F.shiftright(stream, NEIGHBOURS)).groupBy("block")


def ids(key: tuple, rows: pd.DataFrame, stream: str) -> list[int | None]:
    """Null is alone in its block."""
    return [None] * len(rows) if pd.isna(key[0]) else rows[stream].tolist()


class Frames(StatefulProcessor):
    """Pieces of a block's streams (at: its first byte's place, data) to whole frames (number, frame).

    State: a row for each stream with its place, the number of its next frame and the bytes of that so far, and one for each early piece (number -1)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "stream bigint, place bigint, number bigint, data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known: dict[int | None, tuple[int, int, bytes]] = {}
        come: dict[int | None, dict[int, bytes]] = {}
        for stream, place, number, data in self.held.get() if self.held.exists() else ():
            if number < 0:
                come.setdefault(stream, {})[place] = bytes(data)
            else:
                known[stream] = place, number, bytes(data)
        for own in rows:
            for stream, at, data in zip(ids(key, own, "stream"), own["at"].tolist(), own["data"].tolist(), strict=True):
                if data is not None and len(data):
                    come.setdefault(stream, {})[int(at)] = bytes(data)
        out: list[tuple[int | None, int, str]] = []
        early: list[tuple[int | None, int, int, bytes]] = []
        for stream, pieces in come.items():
            place, number, rest = known.get(stream, (0, 0, b""))
            more = [rest]
            while (data := pieces.pop(place, None)) is not None:
                more.append(data)
                place += len(data)
            *whole, last = b"".join(more).split(BREAK)
            out.extend((stream, number + i, frame.decode("utf-8", "replace")) for i, frame in enumerate(whole))
            known[stream] = place, number + len(whole), last
            early.extend((stream, at, -1, data) for at, data in pieces.items() if at > place)
        if come:
            self.held.put([(stream, *state) for stream, state in known.items()] + early)
        if out:
            yield pd.DataFrame(out, columns=["stream", "seq", "frame"])

    def close(self) -> None:
        pass


def frames(pieces: DataFrame) -> DataFrame:
    """(stream, seq, event) of the frames of ``pieces`` (stream bigint, at bigint, data binary), a stream or a table."""
    own = by_block(pieces.select("stream", "at", "data"), "stream")
    whole = own.transformWithStateInPandas(Frames(), "stream bigint, seq bigint, frame string", "Append", "None")
    own = whole.filter(F.startswith(F.col("frame"), F.lit("data: ")))
    return own.select("stream", "seq", F.from_json(F.expr("substring(frame, 7)"), FRAME).alias("event")).filter("event.type is not null")


NEXT, ENDED, EARLY, EARLY_LAST = range(4)


class Spoken(StatefulProcessor):
    """Fragments of a block's answers (n: its number, fragment, last) to tokens in their order, each as soon as those before it are there, and the whole answer at the end.

    State: a row for each answer with the number of its next fragment and what was said so far, or that it has ended, and one for each early fragment."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "query_id bigint, n bigint, kind int, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known: dict[int | None, tuple[int, int, str | None]] = {}
        come: dict[int | None, dict[int, tuple[str | None, bool]]] = {}
        for query, n, kind, text in self.held.get() if self.held.exists() else ():
            if kind in (NEXT, ENDED):
                known[query] = n, kind, text
            else:
                come.setdefault(query, {})[n] = text, kind == EARLY_LAST
        for own in rows:
            for query, n, text, last in zip(ids(key, own, "query_id"), own["n"].tolist(), own["fragment"].tolist(), own["last"].tolist(), strict=True):
                come.setdefault(query, {})[int(n)] = text if isinstance(text, str) else None, bool(last)
        out: list[tuple[int | None, int, str, str]] = []
        early: list[tuple[int | None, int, int, str | None]] = []
        for query, fragments in come.items():
            turn, kind, said = known.get(query, (0, NEXT, ""))
            more = [said or ""]
            while kind == NEXT and turn in fragments:
                text, last = fragments.pop(turn)
                more.append(text or "")
                out.append((query, turn, "token", more[-1]))
                turn, kind = turn + 1, ENDED if last else NEXT
                if last:
                    out.append((query, turn, "done", "".join(more)))
            known[query] = turn, kind, None if kind == ENDED else "".join(more)
            if kind == NEXT:
                early.extend((query, n, EARLY_LAST if last else EARLY, text) for n, (text, last) in fragments.items() if n > turn)
        if come:
            self.held.put([(query, *state) for query, state in known.items()] + early)
        if out:
            yield pd.DataFrame(out, columns=["query_id", "seq", "type", "text"])

    def close(self) -> None:
        pass


def spoken(fragments: DataFrame) -> DataFrame:
    """(query_id, seq, type, text): ``token`` events of ``fragments`` (query_id bigint, n bigint, fragment string, last boolean) while they come, and ``done`` with the whole answer."""
    own = by_block(fragments.select("query_id", "n", "fragment", "last"), "query_id")
    return own.transformWithStateInPandas(Spoken(), "query_id bigint, seq bigint, type string, text string", "Append", "None")


def run(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there, one batch for each set of files; what it wrote, with the batch (``batch``) in which each row came out."""

    def keep(own: DataFrame, number: int) -> None:
        own.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    spark.createDataFrame([], rows.schema).withColumn("batch", F.lit(0)).write.parquet(f"{folder}/out/number=-1")
    with stateful(spark):
        query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("number")

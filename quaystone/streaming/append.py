"""Resumable runs as streams: new records are appended once, over any number of starts, with state that expires and progress that is kept."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def label_stream(spark: SparkSession, source: str, schema: str, label: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, watermark: str) -> StreamingQuery:
    """Read JSON lines of documents as they arrive, drop repeated doc_ids, label, append as JSON lines; stops when the input is used up.

    The checkpoint holds the ids seen and the files read. ``watermark`` ('ts, 1 day') bounds the ids that are held: a doc_id that comes again
    later than that is labelled again.
    """
    column, delay = (x.strip() for x in watermark.split(","))
    docs = spark.readStream.schema(schema).json(source).withWatermark(column, delay).dropDuplicatesWithinWatermark(["doc_id"])
    return label(docs).writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(sink)


class Visits(StatefulProcessor):
    """One row for each visit of a key: its first event after none for ``gap_ms``. A key's last time is its state, cleared when it is over."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.last.get()
        last = held[0] if held is not None else None
        for row in sorted(rows, key=lambda r: r.ms):
            if last is None or row.ms - last > self.gap_ms:
                yield Row(key=key[0], began_ms=row.ms)
            last = row.ms if last is None else max(last, row.ms)
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.gap_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.last.get()
        if held is not None and expiredTimerInfo.getExpiryTimeInMs() > held[0] + self.gap_ms:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state where timers and several values a key are possible."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def visit_stream(spark: SparkSession, source: str, schema: str, key: str, at: str, gap: timedelta, late: str, sink: str, checkpoint: str, files: int = 1) -> StreamingQuery:
    """Append (key, began_ms) for each visit in the parquet files of ``source``, ``files`` at a time; stops when the input is used up.

    Events may come out of order by ``late`` at most, others are left out; within a batch they are sorted by key. A key's state is one
    number, and is dropped once the watermark is past the gap after its last event, so that the state holds the keys of a recent time only.
    Events without a time are left out; a null key is a key.
    """
    ship(spark)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).where(F.col(at).isNotNull())
    when = F.col(at).cast("timestamp")
    events = events.select(F.col(key).cast("long").alias("key"), when.alias("at"), F.unix_millis(when).alias("ms")).withWatermark("at", late)
    out = events.groupBy("key").transformWithState(Visits(int(gap.total_seconds() * 1000)), "key long, began_ms long", "append", "eventTime")
    with keyed_state(spark):
        return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(sink)


class Progress(StreamingQueryListener):
    """Keeps what each batch of each stream did, the last ``most`` batches."""

    def __init__(self, most: int = 10_000):
        self.rows: deque[tuple] = deque(maxlen=most)
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        state = p.stateOperators[0] if p.stateOperators else None
        self.rows.append((str(p.id), str(p.runId), p.batchId, p.numInputRows, state.numRowsTotal if state else 0, state.numRowsDroppedByWatermark if state else 0))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.runId)] = event.exception

    def table(self, spark: SparkSession) -> DataFrame:
        """(query_id, run_id, batch, rows_in, state_rows, late_rows), a row for each batch that was reported."""
        return spark.createDataFrame(list(self.rows), "query_id string, run_id string, batch long, rows_in long, state_rows long, late_rows long")


def settled(progress: Progress, stream: StreamingQuery, seconds: float = 30) -> None:
    """Wait until the listener has heard of the end of a stream; it is told of it after the stream has ended."""
    until = time.monotonic() + seconds
    while str(stream.runId) not in progress.ended and time.monotonic() < until:
        time.sleep(0.1)

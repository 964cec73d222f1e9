"""Journals as Structured Streaming: records followed by usn, the last change of each file as keyed state, grants that are spent once, and totals maintained batch by batch.

State lives in the RocksDB state store, with its checkpoint on shared storage; a stream that is started again goes on where its last finished batch ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import LIMITS
from ..operators import journal
from ..sources import scratch, segments

RECORDS = "usn long, file_id long, reason long, size_bytes long"
CHANGES = "file_id long, usn long, reason long, size_bytes long, delta long"
GRANTED = "subject string, seq long, granted boolean"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for a stream that starts inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def source(spark: SparkSession, folder: str, files_per_batch: int = 1, schema: str = RECORDS) -> DataFrame:
    """A stream of journal records from Parquet files in `folder`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", **trigger: Any) -> StreamingQuery:
    """Start writing a stream's rows as Parquet, a folder a batch: a batch that runs again replaces its own."""
    with _rocks(stream.sparkSession):
        made = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", checkpoint)
        return made.trigger(**(trigger or {"availableNow": True})).start()


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, most: int = LIMITS.journal_events, start: int | None = None) -> None:
    """Read a journal of segments (sources.segments) up to its present end, at most `most` records a batch, and write its records to `out`. The next call goes on behind it.

    `checkpoint` is a folder on shared storage; the driver opens it by its path as well.
    """
    position = scratch.local(checkpoint) + "/position/at.json"
    q = append(segments.stream(spark, folder, position, start, most), out, f"{checkpoint}/stream", processingTime="0 seconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()


class _Latest(StatefulProcessor):
    """Holds the usn and size of a file's last relevant record; tells of a change when a later one comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "usn long, size_bytes long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best = max(rows, key=lambda r: r.usn)
        old = self.last.get()
        if old is None or best.usn > old[0]:
            self.last.update((best.usn, best.size_bytes))
            delta = None if best.size_bytes is None else best.size_bytes - ((old[1] or 0) if old else 0)
            yield Row(file_id=key[0], usn=best.usn, reason=best.reason, size_bytes=best.size_bytes, delta=delta)

    def close(self) -> None:
        pass


def changes_of(stream: DataFrame) -> DataFrame:
    """file_id, usn, reason, size_bytes, delta of files whose last relevant record is a later one than before: at most one row a file and batch. State is a file's usn and
    size; a record that comes late, behind one of a higher usn, changes nothing. delta: against the size before, or 0 for a file not seen yet; null without a size.
    """
    scratch.ship(stream.sparkSession)
    rows = journal.relevant(stream).where("file_id is not null and usn is not null").select("file_id", "usn", "reason", "size_bytes")
    return rows.groupBy("file_id").transformWithState(_Latest(), CHANGES, "update", "none")


def latest_by_stream(records: DataFrame, parts: int = 4) -> DataFrame:
    """journal.latest() of a bounded table, by way of a stream of `parts` micro-batches over shared storage: what is written follows changes, not files times batches."""
    spark = records.sparkSession
    base = scratch.folder(spark, f"journal-{uuid.uuid4().hex}")
    records.repartition(parts, "usn").write.parquet(f"{base}/records")
    append(changes_of(source(spark, f"{base}/records", schema=records.schema)), f"{base}/changes", f"{base}/state", "update").awaitTermination()
    told = spark.read.schema(CHANGES).parquet(f"{base}/changes/batch=*")
    return told.groupBy("file_id").agg(F.max("usn").alias("usn"), F.max_by("reason", "usn").alias("reason"), F.max_by("size_bytes", "usn").alias("size_bytes"))


class _Grants(StatefulProcessor):
    """Holds a subject's grant that waits for its use: its time, in microseconds. A timer drops it when it is too old; the timer of one that was spent finds nothing, or a later one, which
    it leaves."""

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting = handle, handle.getValueState("waiting", "at long")

    def _until(self, at: int) -> int:
        return (at + self.micros) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self.waiting.get()
        before = at = old[0] if old else None
        for r in sorted(rows, key=lambda r: (r.micros, r.seq)):
            if r.kind == "grant":
                at = r.micros
            else:
                yield Row(subject=key[0], seq=r.seq, granted=at is not None and 0 <= r.micros - at <= self.micros)
                at = None
        if at == before:
            return
        if at is None:
            self.waiting.clear()
        else:
            self.waiting.update((at,))
            self.handle.registerTimer(self._until(at))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        old = self.waiting.get()
        if old and self._until(old[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.waiting.clear()
        return iter([])

    def close(self) -> None:
        pass


def grants_of(stream: DataFrame, seconds: int = LIMITS.grant_seconds, late: str = "0 seconds") -> DataFrame:
    """audit.granted() of a stream of subject, at (timestamp), seq, kind (`grant`, `use`): subject, seq, granted of each use. A grant is spent by the next use and is refused when it is
    more than `seconds` old, behind a restart too. Events may be out of order within a batch; those older than the watermark (`late` behind the latest) are dropped by Spark.
    State is one number a subject, gone when its grant is too old.
    """
    scratch.ship(stream.sparkSession)
    rows = stream.withWatermark("at", late).select("subject", "at", "seq", "kind", F.unix_micros("at").alias("micros"))
    return rows.groupBy("subject").transformWithState(_Grants(seconds * 1_000_000), GRANTED, "append", "eventTime")


def maintain(stream: DataFrame, files: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run `publish(changes, batch)` for each micro-batch that has relevant records: changes are path, size_bytes, delta against the files as they are
    published by then. A batch without relevant records publishes nothing. Batches come at least once; what is published must not add up twice,
    so deltas are always against the published sizes, and a late record of a file never undoes a later one (see changes_of())."""

    def one(df: DataFrame, i: int) -> None:
        last = scratch.save(df, "changes")
        if not last.isEmpty():
            publish(journal.deltas(last, files()).where("delta != 0"), i)

    with _rocks(stream.sparkSession):
        return changes_of(stream).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

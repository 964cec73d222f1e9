"""Change journals on shared storage as a stream whose offsets are usn numbers.

A journal is a folder of segments, each what one read of the device gave: the usn that the next read starts from (8 bytes), then binary records. A segment's name says where
it starts, where the next one starts, and how many records it has, so that a batch is planned without opening files. A batch takes whole segments up to a number of records.
The stream ends with an error where the journal has a gap, where a segment doesn't advance, where one is larger than a batch may be, and where
records are malformed, of an unknown version, or not those that the name promises: a consumer has to read the tree again then.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..config import LIMITS
from ..operators.budget import running
from . import records, scratch

NAME = re.compile(r"(\d{20})-(\d{20})-(\d+)\.usn")


class Broken(RuntimeError):
    """The journal can't be followed from where the reader stood."""


def listed(folder: str) -> list[tuple[int, int, int, str]]:
    """(start, next, records, path) of the segments, by start."""
    found = ((NAME.fullmatch(n), n) for n in os.listdir(folder))
    return sorted((int(m[1]), int(m[2]), int(m[3]), os.path.join(folder, n)) for m, n in found if m)


def followed(segments: list[tuple[int, int, int, str]], at: int, most: int) -> list[tuple[int, int, int, str]]:
    """The segments behind `at` that one batch takes. Broken where they don't follow each other."""
    out, n = [], 0
    for start, after, count, path in segments:
        if after <= start:
            raise Broken(f"the journal does not advance at {start}")
        if after <= at:
            continue
        if start > at:
            raise Broken(f"the journal has no records from {at} to {start}")
        if count > most:
            raise Broken(f"{count} records in one read of the journal, at most {most} are followed")
        if n + count > most:
            break
        out.append((at, after, count, path))
        n, at = n + count, after
    return out


def read_segment(path: str, at: int, after: int, count: int) -> pa.RecordBatch:
    """The records of a segment from `at` on."""
    with open(path, "rb") as f:
        raw = np.frombuffer(f.read(), np.uint8)
    if len(raw) < 8 or int(raw[:8].view("<i8")[0]) != after:
        raise Broken(f"{os.path.basename(path)} is cut off or starts wrongly")
    view, places, here = memoryview(raw.tobytes()), [], 8
    while here < len(raw):
        if len(raw) - here < records.HEADER or (size := int.from_bytes(view[here : here + 4], "little")) < records.HEADER:
            raise records.Malformed("malformed journal record: it is short")
        places.append(here)
        here += size
    begins = np.array(places, np.int64)
    batch = records.columns(raw, begins, np.append(begins[1:], len(raw)) if len(begins) else begins)
    usn = batch.column("usn").to_numpy()
    if len(usn) != count or (len(usn) and ((np.diff(usn) <= 0).any() or usn[-1] >= after)):
        raise Broken(f"{os.path.basename(path)} does not hold the records that its name promises")
    return batch.filter(pa.array(usn >= at))


class _Part(InputPartition):
    def __init__(self, at: int, after: int, count: int, path: str) -> None:
        self.at, self.after, self.count, self.path = at, after, count, path


class _Reader(DataSourceStreamReader):
    """Offsets are {"usn": n}: all records below n have been read.

    Spark asks for the latest offset without saying where the stream stands, so the end of the last planned batch is kept in a file `position`, written before the batch runs:
    behind a restart the next batch is as small as any other.
    """

    def __init__(self, options: dict) -> None:
        self.folder, self.most = options["path"], int(options.get("maxRecords", LIMITS.journal_events))
        self.position, self.start = options.get("position"), int(options.get("start", -1))
        self.at: int | None = None

    def _segments(self) -> list[tuple[int, int, int, str]]:
        return listed(self.folder)

    def initialOffset(self) -> dict:
        if self.start >= 0:
            return {"usn": self.start}
        found = self._segments()
        return {"usn": found[0][0] if found else 0}

    def latestOffset(self) -> dict:
        if self.at is None:
            if self.position and os.path.exists(self.position):
                with open(self.position, encoding="utf-8") as f:
                    self.at = json.load(f)["usn"]
            else:
                self.at = self.initialOffset()["usn"]
        taken = followed(self._segments(), self.at, self.most)
        return {"usn": taken[-1][1] if taken else self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.position:
            part = f"{self.position}.{uuid.uuid4().hex}"
            os.makedirs(os.path.dirname(self.position), exist_ok=True)
            with open(part, "w", encoding="utf-8") as f:
                json.dump(end, f)
            os.replace(part, self.position)
        self.at = end["usn"]
        inside = [s for s in self._segments() if s[0] < end["usn"]]
        return [_Part(*s) for s in followed(inside, start["usn"], 1 << 62)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        yield read_segment(partition.path, partition.at, partition.after, partition.count)

    def commit(self, end: dict) -> None:
        pass


class UsnJournal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "usn_journal"

    def schema(self) -> str:
        return records.DECODED

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def stream(spark: SparkSession, folder: str, position: str, start: int | None = None, most: int = LIMITS.journal_events) -> DataFrame:
    """A journal's records from `start` (a usn; else the first that is there) on, at most `most` a batch. `folder`: a path that driver and executors open; `position`: a file of this one stream,
    kept beside its checkpoint."""
    scratch.ship(spark)
    spark.dataSource.register(UsnJournal)
    made = spark.readStream.format("usn_journal").option("path", folder).option("position", position).option("maxRecords", most)
    return (made if start is None else made.option("start", start)).load()


def write_segment(folder: str, table: pa.Table, start: int, after: int) -> str:
    """Write records (usn, file_id, parent_id, reason, attributes, name) as a segment and return its name. A retried task writes the same again."""
    batch = table.sort_by("usn").combine_chunks().to_batches()[0]
    name = f"{start:020}-{after:020}-{batch.num_rows}.usn"
    part = os.path.join(folder, f".{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        f.write(np.array([after], "<i8").tobytes())
        f.write(records.encode(batch).buffers()[2])
    os.replace(part, os.path.join(folder, name))
    return name


def capture(rows: DataFrame, folder: str, step: int) -> DataFrame:
    """Segments out of rows (usn, file_id, parent_id, reason, attributes, name; each usn once), one for each `step` usn numbers that has any; segment, records written.

    A segment reaches to the start of the next one that has rows, so the journal has no gap; none has more than `step` records. `folder` is a path that all tasks open.
    """
    scratch.ship(rows.sparkSession)
    os.makedirs(folder, exist_ok=True)
    cut = rows.select("usn", "file_id", "parent_id", "reason", "attributes", "name", F.floor(F.col("usn") / step).cast("long").alias("cut"))
    numbered = scratch.save(running(cut.select("cut").distinct(), [F.asc("cut")], F.lit(1), "number"), "numbered")
    following = numbered.select((F.col("number") - 1).alias("number"), F.col("cut").alias("next_cut"))
    bounds = numbered.join(following, "number", "left").select("cut", (F.col("cut") * step).alias("start"), (F.coalesce("next_cut", F.col("cut") + 1) * step).alias("next"))

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        name = write_segment(folder, table, table["start"][0].as_py(), table["next"][0].as_py())
        return pa.table({"segment": [name], "records": pa.array([table.num_rows], pa.int64())})

    return scratch.save(cut.join(bounds, "cut").groupBy("cut").applyInArrow(one, "segment string, records long"), "captured")

"""Digests of file content, read where the task runs.

A file is read in ranges of LIMITS.hash_chunk bytes, which are dealt out to tasks by bytes, so one large file is read by many. A file of one range has the digest of its content;
one of more has the digest of its ranges' digests in order. As files are only held against files of the same size, equal digests mean equal content.
Nothing is read beyond the size that the inventory has.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from . import scratch

#: Bytes that a task reads, about, and tasks at most; ranges of a file that follow each other in one task.
TASK_BYTES, TASKS, TOGETHER = 256 << 20, 8192, 16
_RANGE, _PART, _FOUND = "__range", "__part", "__found"


def _facts(path: str | bytes) -> tuple | None:
    try:
        s = os.lstat(path)
    except OSError:
        return None
    return (s.st_mode, s.st_size, s.st_mtime_ns)


def digest(path: str | bytes, size: int, modified_ns: int, edges: bool, start: int = 0, end: int | None = None) -> tuple[str | None, str, int]:
    """(digest or None, `ok`, `changed` or `error`, bytes really read) of bytes start to end, or with `edges` of both ends of a file of some size. Facts are held
    against the inventory before, and against these behind the reading; a file that ends early has changed, and what it has beyond its size is not read."""
    before, end = _facts(path), size if end is None else min(end, size)
    if before is None:
        return None, "error", 0
    if before[1:] != (size, modified_ns):
        return None, "changed", 0
    h, read, edge = hashlib.sha256(), 0, LIMITS.edge_bytes
    spans = [(0, edge), (size - edge, size)] if edges and size > 2 * edge else [(start, end)]
    try:
        with open(path, "rb", buffering=0) as f:
            for at, to in spans:
                f.seek(at)
                while at < to and (part := f.read(min(to - at, 1 << 20))):
                    read, at = read + len(part), at + len(part)
                    h.update(part)
    except OSError:
        return None, "error", read
    whole = read == sum(to - at for at, to in spans)
    return (h.hexdigest(), "ok", read) if whole and _facts(path) == before else (None, "changed", read)


def _digested(files: DataFrame, edges: bool, column: str, read=None) -> DataFrame:
    """One digest a row; of the range that its number in _RANGE names, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = LIMITS.hash_chunk
        for batch in batches:
            names = ["path", "size_bytes", "modified_ns", *(c for c in ("raw_path", _RANGE) if c in batch.schema.names)]
            found = []
            for r in batch.select(names).to_pylist():
                at = (r.get(_RANGE) or 0) * chunk
                found.append(digest(r.get("raw_path") or r["path"], r["size_bytes"], r["modified_ns"], edges, at, at + chunk if _RANGE in r else None))
                if read is not None:
                    read.add(found[-1][2])
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, column, "status", "bytes_read"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{schema}, `{column}` string, status string, bytes_read long")


def _dealt(rows: DataFrame, cost, by: list) -> DataFrame:
    """Rows dealt out so that a task has TASK_BYTES to read, or a few rows."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(cost), F.lit(0))).first()
    tasks = max(-(-total // TASK_BYTES), min(n, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    return rows.repartition(max(1, min(int(tasks), TASKS)), *by)


def digests(files: DataFrame, edges: bool, column: str, read=None) -> DataFrame:
    """`files` (path, size_bytes, modified_ns, ...) with `column`, status and bytes_read. Running it again gives the same, so retries are harmless. read: an accumulator
    that counts bytes as tasks end. status: `ok` if all ranges are, `error` if one is, else `changed`."""
    scratch.ship(files.sparkSession)
    base = files.drop("status", "bytes_read")
    if edges:
        return _digested(_dealt(base, F.least(F.col("size_bytes"), F.lit(2 * LIMITS.edge_bytes)), ["path"]), True, column, read)
    chunk, size = LIMITS.hash_chunk, F.col("size_bytes")
    small = _digested(_dealt(base.where(size <= chunk), size, ["path"]), False, column, read)
    ranges = base.where(size > chunk).withColumn(_RANGE, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / chunk).cast("long"))))
    parts = _digested(_dealt(ranges, F.lit(chunk), ["path", F.floor(F.col(_RANGE) / TOGETHER)]), False, _PART, read)
    whole = parts.groupBy(*base.columns).agg(F.sort_array(F.collect_list(F.struct(_RANGE, _PART))).alias(_FOUND), F.max_by("status", F.when(F.col("status") == "error", 2).when(F.col("status") == "changed", 1).otherwise(0)).alias("status"), F.sum("bytes_read").alias("bytes_read"))
    root = F.when(F.col("status") == "ok", F.sha2(F.concat_ws("", F.transform(_FOUND, lambda x: x[_PART])), 256))
    return small.unionByName(whole.withColumn(column, root).select(*base.columns, column, "status", "bytes_read"))

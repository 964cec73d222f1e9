"""Intermediate tables on storage that all executors share, and this package's code on the executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR, BATCH = "spark.checkpoint.dir", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch while a table is written, so that a Python worker's memory doesn't follow the longest rows.
BATCH_BYTES = "16m"
_shipped: set[str] = set()
_open: list[list[tuple[SparkSession, str]]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: they need not have it installed."""
    sc, package = spark.sparkContext, Path(__file__).parents[1]
    if sc.applicationId in _shipped or not package.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="stockroom-")) / f"{package.name}-code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, Path(package.name) / p.relative_to(package))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def folder(spark: SparkSession, name: str) -> str:
    """A folder under spark.checkpoint.dir. Where that is unset, one on this machine, if all of Spark runs on it; else an error."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stockroom-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/stockroom/{name}"


def local(path: str) -> str:
    """The path that open() takes, of one on a file system that all machines mount; an error for any other."""
    if "://" in path and not path.startswith("file:"):
        raise RuntimeError(f"{path} can't be opened by its path: a mounted folder is needed")
    return "/" + path.removeprefix("file:").lstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended before; the folder is the cluster's to clean
        pass


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES at most for what is planned inside; the session's own setting holds again behind it."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, before)


@contextmanager
def released() -> Iterator[None]:
    """Tables saved inside are deleted at its end: for work whose result no longer reads them."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            _drop(spark, path)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet on shared storage and read it back: what follows reads it as often as it likes, and a lost executor costs no more than its
    running tasks. It goes at the end of the innermost released(), or at exit."""
    spark = df.sparkSession
    path = folder(spark, f"{name}-{uuid.uuid4().hex}")
    with small_batches(spark):
        df.write.parquet(path)
    if _open:
        _open[-1].append((spark, path))
    else:
        atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)

"""File trees as tables: one row for each entry below a root that executors can reach.

Built-in file sources leave out empty files and names that begin with a dot or an underscore, and give neither ids nor attributes; an inventory needs all.

A tree is walked in rounds. Each task of a round opens its directories, and those below them, until it has seen a number of entries; what it has not opened by then is dealt
out evenly to the tasks of the next round. So where the mass of a tree lies makes no difference, and a round's tasks do about equal work. Directories
whose attributes say that they are not kept on this disk have a row and are never opened.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NO_CONTENT_MASK
from . import scratch

SCHEMA = "path string, kind string, size_bytes long, modified_ns long, attributes long, identity string, hardlink_count long, allocated_bytes long, error string, raw_path binary"
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size_bytes", pa.int64()), ("modified_ns", pa.int64()), ("attributes", pa.int64()), ("identity", pa.string()), ("hardlink_count", pa.int64()), ("allocated_bytes", pa.int64()), ("error", pa.string()), ("raw_path", pa.binary())])
#: Entries that a task sees in the first round, and at most in any; tasks of a round, at most.
FIRST, MOST, TASKS = 1000, 250_000, 1024
ORDINARY = 0x20
#: Kind of the rows that stand for directories left to the next round.
LEFT = "left"
Attributes = Callable[[str, os.stat_result], int]


def _text(path: str) -> tuple[str, bytes | None]:
    """A path as text, with a mark for what is no UTF-8, and its bytes if the text can't be turned back into them."""
    raw = os.fsencode(path)
    text = raw.decode("utf-8", "replace")
    return text, None if text.encode() == raw else raw


def _error(path: str, e: OSError) -> tuple:
    text, raw = _text(path)
    return (text, "error", 0, 0, 0, None, None, None, f"{text}: {e.strerror}", raw)


def own_attributes(path: str, s: os.stat_result) -> int:
    return getattr(s, "st_file_attributes", ORDINARY)


def _row(path: str, attributes: Attributes = own_attributes) -> tuple:
    text, raw = _text(path)
    try:
        s = os.lstat(path)
    except OSError as e:
        return _error(path, e)
    kind = "symlink" if stat.S_ISLNK(s.st_mode) else "directory" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
    return (text, kind, s.st_size if kind == "file" else 0, s.st_mtime_ns, attributes(path, s), f"{s.st_dev}:{s.st_ino}", s.st_nlink, getattr(s, "st_blocks", 0) * 512, None, raw)


def walk(paths: Iterator[str], most: int, deep: bool = True, closed: int = NO_CONTENT_MASK, attributes: Attributes = own_attributes) -> Iterator[tuple]:
    """Rows of the entries of directories and of what lies below them, links not followed; an entry that can't be read gives an error row, and so does a directory. Behind `most`
    entries the directories that are still to be opened come as rows of kind LEFT. Directories with an attribute of `closed` are not opened."""
    todo, seen = deque(), 0
    for path in paths:
        todo.append(path)
        while todo and seen < most:
            here = todo.popleft()
            try:
                with os.scandir(here) as entries:
                    for name in (e.name for e in entries):  # as they come, so memory does not follow a directory's length
                        path = os.path.join(here, name)
                        row = _row(path, attributes)
                        seen += 1
                        yield row
                        if deep and row[1] == "directory" and not row[4] & closed:
                            if seen < most:
                                todo.append(path)
                            else:
                                yield _left(path)
            except OSError as e:
                yield _error(here, e)
    for path in todo:
        yield _left(path)


def _left(path: str) -> tuple:
    text, raw = _text(path)
    return (text, LEFT, 0, 0, 0, None, None, None, None, raw)


def _round(most: int, deep: bool, closed: int, attributes: Attributes, seen=None):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (os.fsdecode(r["raw_path"] or r["path"].encode()) for b in batches for r in b.to_pylist())
        rows: list[tuple] = []
        for row in walk(paths, most, deep, closed, attributes):
            rows.append(row)
            if len(rows) == 4096:
                yield _batch(rows, seen)
                rows = []
        if rows:
            yield _batch(rows, seen)

    return one


def _batch(rows: list[tuple], seen) -> pa.RecordBatch:
    if seen is not None:
        seen.add(sum(r[1] == "file" for r in rows))
    return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], schema=_ARROW)


def read(spark: SparkSession, root: str, depth: str = "all", closed: int = NO_CONTENT_MASK, attributes: Attributes = own_attributes, seen=None, between: Callable[[], None] | None = None) -> DataFrame:
    """Entries below `root`; depth "1": its own entries only. closed: attribute bits of directories that are not opened; attributes: gives a path's bits, on the executors;
    seen: an accumulator that counts files as tasks end; between: called before each round, where a job may wait or be cancelled. The table of each round lies in scratch space (see scratch.released())."""
    scratch.ship(spark)
    text, raw = _text(checked_root(root))
    rounds, left, most = [], spark.createDataFrame([(text, raw)], "path string, raw_path binary"), FIRST
    while True:
        if between is not None:
            between()
        found = scratch.save(left.mapInArrow(_round(most if depth == "all" else 0x7FFFFFFF, depth == "all", closed, attributes, seen), SCHEMA), "walk")
        rounds.append(found.where(F.col("kind") != LEFT))
        left = found.where(F.col("kind") == LEFT).select("path", "raw_path")
        n = left.count()
        if not n:
            return reduce(DataFrame.unionAll, rounds)
        left, most = left.repartition(min(n, TASKS, max(8, 4 * spark.sparkContext.defaultParallelism))), min(4 * most, MOST)


def plain(path: str) -> str:
    """The absolute path, with one slash in front: two are kept by os.path and would make another name of the same place."""
    return "/" + os.path.abspath(path).lstrip("/")


def checked_root(root: str) -> str:
    """The root's absolute path; ValueError unless it is a directory, no link, and not virtual."""
    if not os.path.isdir(root) or os.path.islink(root):
        raise ValueError(f"{root} is no directory, or is a link")
    if getattr(os.lstat(root), "st_file_attributes", ORDINARY) & NO_CONTENT_MASK:
        raise ValueError(f"{root} is not kept on this disk")
    return plain(root)


def files_of(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("kind") == "file").select("path", "size_bytes", "modified_ns", "attributes", "identity", "hardlink_count", "allocated_bytes", *(c for c in ("raw_path",) if c in entries.columns))


def directories_of(entries: DataFrame, root: str) -> DataFrame:
    """path, attributes of all directories, the root too."""
    spark = entries.sparkSession
    return entries.where(F.col("kind") == "directory").select("path", "attributes").unionAll(spark.createDataFrame([(root, ORDINARY)], "path string, attributes long"))

"""Change journals: relevance, the last change of a file, and what changes mean for directory totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OFFLINE_MASK, REPARSE, STRUCTURAL_MASK
from ..functions import paths


@dataclass(frozen=True)
class Watermark:
    journal: int
    first: int
    next: int
    volume: int
    root: str


def continues(old: Watermark, now: Watermark) -> bool:
    """Whether records from old.next on are all there: same journal, volume and root, nothing cut off in front, no rewind."""
    return (old.journal, old.volume, old.root) == (now.journal, now.volume, now.root) and now.first <= old.next <= now.next


def between(records: DataFrame, old: Watermark, now: Watermark) -> DataFrame:
    return records.where((F.col("usn") >= old.next) & (F.col("usn") < now.next))


def relevant(records: DataFrame) -> DataFrame:
    """Records that say more than that a handle was closed."""
    return records.where(paths.relevant_reason(F.col("reason")))


def structural(records: DataFrame) -> DataFrame:
    """Records of creation, deletion, renaming, links or streams: they need a full refresh."""
    return records.where(F.col("reason").bitwiseAND(F.lit(STRUCTURAL_MASK).cast("long")) != 0)


def latest(records: DataFrame) -> DataFrame:
    """The last relevant record of each file. Partial aggregation keeps one row of a file for each task."""
    return relevant(records).groupBy("file_id").agg(F.max("usn").alias("usn"), F.max_by("reason", "usn").alias("reason"), F.max_by("size_bytes", "usn").alias("size_bytes"))


def deltas(last: DataFrame, files: DataFrame) -> DataFrame:
    """path, size_bytes (new), delta of changed files. files: file_id, path, size_bytes."""
    return files.withColumnRenamed("size_bytes", "old").join(last.select("file_id", "size_bytes"), "file_id").select("path", "size_bytes", (F.col("size_bytes") - F.col("old")).alias("delta"))


def directory_deltas(changed: DataFrame, root: str) -> DataFrame:
    """path, delta of every directory above a changed file."""
    own = changed.groupBy(paths.parent(F.col("path")).alias("dir")).agg(F.sum("delta").alias("delta"))
    up = own.select(F.explode(F.array_append(paths.ancestors(F.col("dir"), root), F.col("dir"))).alias("path"), "delta").where(paths.is_under(F.col("path"), root))
    return up.groupBy("path").agg(F.sum("delta").alias("delta"))


def apply(directories: DataFrame, changed: DataFrame, root: str) -> DataFrame:
    """Directories with the deltas added; a total that leaves the range of sizes is an error."""
    d = directory_deltas(changed, root).withColumnRenamed("delta", "__delta")
    names = directories.columns
    total = F.when(F.col("__delta").isNull(), F.col("size_bytes")).otherwise(paths.add_checked(F.col("size_bytes"), F.col("__delta")))
    return directories.join(d, "path", "left").withColumn("size_bytes", total).select(*names)


def cursor(records: DataFrame) -> DataFrame:
    """One row: first and next, the records that are there and the number of the one to come (0 and 0 of an empty journal)."""
    return records.agg(F.coalesce(F.min("usn"), F.lit(0)).alias("first"), F.coalesce(F.max("usn") + 1, F.lit(0)).alias("next"))


def continues_column(old: Column, now: Column) -> Column:
    """continues() for rows with two watermarks (structs of journal, first, next, volume, root); false if one is missing."""
    same = (old["journal"] == now["journal"]) & (old["volume"] == now["volume"]) & (old["root"] == now["root"])
    return F.coalesce(same & (now["first"] <= old["next"]) & (old["next"] <= now["next"]), F.lit(False))


def resolved(last: DataFrame, ids: DataFrame, root: str) -> DataFrame:
    """file_id, path, problem of changed files. ids: file_id, path, hardlink_count, attributes, a row a name. problem, the first of: `missing` (no such file),
    `names` (several rows, or several links), `virtual` (offline or reparse attributes), `outside` (not under the root); null if the delta may use it.
    """
    known = ids.groupBy("file_id").agg(F.count("*").alias("names"), F.min("path").alias("path"), F.max("hardlink_count").alias("links"), F.max(F.col("attributes").bitwiseAND(OFFLINE_MASK | REPARSE)).alias("virtual"))
    found = last.select("file_id").distinct().join(known, "file_id", "left")
    problem = F.when(F.col("names").isNull(), "missing").when((F.col("names") > 1) | (F.col("links") != 1), "names").when(F.col("virtual") != 0, "virtual").when(~paths.is_under(F.col("path"), root), "outside")
    return found.select("file_id", F.when(problem.isNull(), F.col("path")).alias("path"), problem.alias("problem"))

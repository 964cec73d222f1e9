"""Storage report: totals, types, directory rollups and rankings of an inventory (path, size_bytes, attributes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions import display, paths
from . import intervals


def directories_of(files: DataFrame, root: str) -> DataFrame:
    """(path) of every directory that holds a file, at any depth, with the root."""
    own = files.select(paths.parent(F.col("path")).alias("path")).distinct()
    return own.select(F.explode(F.array_append(paths.ancestors(F.col("path"), root), F.col("path"))).alias("path")).distinct()


def totals(files: DataFrame, root: str, directories: DataFrame | None = None) -> DataFrame:
    """One row: files_scanned, directories_scanned (without the root), logical_bytes."""
    dirs = (directories if directories is not None else rollup(files, root)).where(F.col("path") != root).agg(F.count("*").alias("directories_scanned"))
    return files.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("logical_bytes")).join(F.broadcast(dirs)).select("files_scanned", "directories_scanned", "logical_bytes")


def by_status(files: DataFrame) -> DataFrame:
    return files.groupBy(paths.content_status(F.col("attributes")).alias("content_status")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))


def by_type(files: DataFrame) -> DataFrame:
    return files.groupBy(paths.extension(F.col("path")).alias("extension")).agg(F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("files"))


def top_types(files: DataFrame, n: int = LIMITS.top_types) -> DataFrame:
    return by_type(files).orderBy(F.desc("size_bytes"), "extension").limit(n)


def type_shares(files: DataFrame) -> DataFrame:
    """Every type with its percent of all bytes and its bar against the largest type."""
    types = by_type(files)
    whole = types.agg(F.sum("size_bytes").alias("whole"), F.max("size_bytes").alias("largest"))
    return types.join(F.broadcast(whole)).select("extension", F.round(display.share(F.col("size_bytes"), F.col("whole")), 6).alias("share"), F.round(display.bar_height(F.col("size_bytes"), F.col("largest")), 6).alias("bar"))


def rollup(files: DataFrame, root: str, directories: DataFrame | None = None) -> DataFrame:
    """path, parent_path, size_bytes, files of every directory: inclusive of all below it. Directories given and without files count 0.

    Files are summed into their own directories first. With `directories`, all of the tree, sums are differences of running totals over the order of paths, so what is shuffled follows
    directories; without, the directories that files have are told by spreading their own directories' sums to those above.
    """
    own = files.groupBy(paths.parent(F.col("path")).alias("dir")).agg(F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("files"))
    if directories is not None:
        sums = intervals.totals(directories.select("path").distinct(), own.withColumnRenamed("dir", "path"), ["size_bytes", "files"])
    else:
        up = own.select(F.explode(F.array_append(paths.ancestors(F.col("dir"), root), F.col("dir"))).alias("path"), "size_bytes", "files").where(paths.is_under(F.col("path"), root))
        sums = up.groupBy("path").agg(F.sum("size_bytes").alias("size_bytes"), F.sum("files").alias("files"))
    return sums.select("path", F.when(F.col("path") == root, "").otherwise(paths.parent(F.col("path"))).alias("parent_path"), "size_bytes", "files")


def top_directories(files: DataFrame, root: str, directories: DataFrame | None = None, n: int = LIMITS.top) -> DataFrame:
    """Largest directories without the root."""
    return rollup(files, root, directories).where(F.col("path") != root).orderBy(F.desc("size_bytes"), "path").limit(n).select(paths.name(F.col("path")).alias("name"), "path", "size_bytes", "files")


def results(files: DataFrame) -> DataFrame:
    """What is listed of a file."""
    p = F.col("path")
    return files.select(paths.name(p).alias("name"), "path", "size_bytes", paths.extension(p).alias("extension"), paths.content_status(F.col("attributes")).alias("content_status"))


def top_files(files: DataFrame, n: int = LIMITS.top) -> DataFrame:
    """Largest files; of equal sizes the last path first."""
    return results(files).orderBy(F.desc("size_bytes"), F.desc("path")).limit(n)


def error_samples(entries: DataFrame, n: int = LIMITS.scan_errors) -> DataFrame:
    """The first `n` errors of a walk, in order. entries: error (null where there is none)."""
    return entries.where("error is not null").select("error").orderBy("error").limit(n)


def complete(*left_out: Column) -> Column:
    """Whether an analysis left nothing out: every count or flag given is 0, false or null."""
    return F.coalesce(F.greatest(F.lit(0).cast("long"), *(c.cast("long") for c in left_out)) == 0, F.lit(True))


def cards(directories: DataFrame, n: int = LIMITS.cards) -> DataFrame:
    """The first rows of a ranking of directories, with each one's share of the bytes of all files (columns path, size_bytes, logical_bytes), at least 1 percent."""
    share = F.when(F.col("logical_bytes") > 0, F.greatest(F.lit(1.0), F.col("size_bytes") * 100.0 / F.col("logical_bytes"))).otherwise(F.lit(0.0))
    return directories.orderBy(F.desc("size_bytes"), "path").limit(n).withColumn("bar", share)


def listed(found: DataFrame, *order: str | Column, n: int = LIMITS.listed_matches) -> DataFrame:
    """The first rows of findings, as a list of them has."""
    return found.orderBy(*order).limit(n)


def chart(types: DataFrame, n: int = LIMITS.chart_types) -> DataFrame:
    """The first rows of a ranking of types, as a chart has them."""
    return types.orderBy(F.desc("size_bytes"), "extension").limit(n)

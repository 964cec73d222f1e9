"""Differences between snapshots, and pages of a published tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions import paths


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: added, changed, unchanged or removed, by size, time and attributes. Both: path, size_bytes, modified_ns, attributes. One full outer join."""
    facts = ["size_bytes", "modified_ns", "attributes"]
    a = old.select("path", F.struct(*facts).alias("a"))
    b = new.select("path", F.struct(*facts).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def change_counts(found: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col("change") == c).alias(c)
    return found.agg(F.count_if(F.col("change") != "removed").alias("files"), n("added"), n("changed"), n("unchanged"), n("removed"))


def children(files: DataFrame, directories: DataFrame, parent: str) -> DataFrame:
    """kind_rank, kind, path, name, size_bytes, files, content_status of what lies directly in `parent`: directories (path, parent_path, size_bytes, files)
    and files (path, parent_path, size_bytes, attributes)."""
    p = F.col("path")
    dirs = directories.where((F.col("parent_path") == parent) & (p != parent)).select(F.lit(0).alias("kind_rank"), F.lit("directory").alias("kind"), "path", paths.name(p).alias("name"), "size_bytes", "files", F.lit("local").alias("content_status"))
    plain = files.where(F.col("parent_path") == parent).select(F.lit(1), F.lit("file"), "path", paths.name(p), "size_bytes", F.lit(1).cast("long"), paths.content_status(F.col("attributes")))
    return dirs.unionAll(plain)


def page(nodes: DataFrame, after: tuple[str, int, str] | None = None, limit: int | None = None) -> DataFrame:
    """One row more than the page, directories first, then files, each largest first, then by path; behind the cursor (kind, size_bytes, path)."""
    n = max(1, min(limit if limit is not None else LIMITS.page, LIMITS.page_most))
    if after is not None:
        kind, size, path = after
        if kind not in ("directory", "file"):
            raise ValueError("a cursor stands on a directory or a file")
        rank = 0 if kind == "directory" else 1
        s = F.col("size_bytes")
        nodes = nodes.where((F.col("kind_rank") > rank) | ((F.col("kind_rank") == rank) & ((s < size) | ((s == size) & (F.col("path") > path)))))
    return nodes.orderBy("kind_rank", F.desc("size_bytes"), "path").limit(n + 1)

"""Trees from parent pointers, pruning below virtual directories, and flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS, OFFLINE_MASK, REPARSE
from ..functions import paths
from ..sources import scratch
from . import intervals


def placed(edges: DataFrame, root_id: str, root: str) -> DataFrame:
    """id, path, depth, verdict of every edge (id, parent, name), each id once, but the root's own.

    verdict: `reached` (path and depth are set, depth is LIMITS.tree_depth at most), `missing` (an id above is not there), `deep` (the chain is longer), or `cycle` (it never ends); path and depth
    are null then. Only nodes that are parents are resolved by jumps, in seven rounds; the others take their parent's path. An edge without a parent is missing.
    """
    rounds = (LIMITS.tree_depth - 1).bit_length()
    edges = edges.select(*(F.col(c).cast("string").alias(c) for c in ("id", "parent", "name"))).where(F.col("id") != F.lit(root_id))
    parents = edges.select(F.col("parent").alias("id")).distinct()
    inner = scratch.save(edges.join(parents, "id", "left_semi"), "parents")
    anc = F.when(F.coalesce(F.col("parent"), F.lit("")) != F.lit(root_id), F.coalesce("parent", F.lit("")))
    found = intervals.along(inner.select("id", anc.alias("anc"), F.col("name").alias("path"), F.lit(1).alias("depth")), {"path": lambda own, above: F.concat(above, F.lit("/"), own), "depth": lambda own, above: own + above}, rounds)
    verdict = F.when(F.col("lost"), "missing").when(F.col("anc").isNull(), "reached")
    found = found.select("id", "path", "depth", verdict.alias("verdict"))
    open_ = found.where("verdict is null").select("id")
    n = open_.count()
    if n:  # longer than the limit, or endless: the same jumps without paths, as many as the longest chain of all can need
        chain = intervals.along(inner.select("id", anc.alias("anc")), {}, inner.count().bit_length() + 1).join(open_, "id", "left_semi")
        late = chain.select("id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("depth"), F.when(F.col("lost"), "missing").when(F.col("anc").isNull(), "deep").otherwise("cycle").alias("verdict"))
        found = found.where("verdict is not null").unionByName(late)
    found = scratch.save(found, "placed")
    leaves = edges.join(parents, "id", "left_anti")
    above = found.select(F.col("id").alias("parent"), F.col("path").alias("__path"), F.col("depth").alias("__depth"), F.col("verdict").alias("__verdict"))
    top = F.col("parent") == F.lit(root_id)
    leaves = leaves.join(above, "parent", "left").select("id", F.when(top, F.col("name")).otherwise(F.concat("__path", F.lit("/"), "name")).alias("path"), F.when(top, 1).otherwise(F.col("__depth") + 1).alias("depth"), F.when(top, "reached").otherwise(F.coalesce("__verdict", F.lit("missing"))).alias("verdict"))
    every = found.unionByName(leaves).withColumn("verdict", F.when((F.col("verdict") == "reached") & (F.col("depth") > LIMITS.tree_depth), "deep").otherwise(F.col("verdict")))
    reached = F.col("verdict") == "reached"
    return every.select("id", F.when(reached, F.concat(F.lit(root.rstrip("/") + "/"), "path")).alias("path"), F.when(reached, F.col("depth")).alias("depth"), "verdict")


def resolved_paths(edges: DataFrame, root_id: str, root: str) -> DataFrame:
    """id, path, depth of the root and of all that hangs below it; see placed()."""
    found = placed(edges, root_id, root).where("verdict = 'reached'").drop("verdict")
    return found.unionByName(edges.sparkSession.createDataFrame([(root_id, root, 0)], "id string, path string, depth int"))


def without_virtual(files: DataFrame, directories: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Files that have no directory with offline or reparse attributes above them, and those directories (path). directories: path, attributes, of the tree below `root`."""
    virtual = directories.where(paths.avoids_content(F.col("attributes"))).select("path")
    return intervals.not_below(files, virtual), virtual


def visible(directories: DataFrame, root: str, expanded: DataFrame) -> DataFrame:
    """The directories (path, parent_path, ...) of which all directories above are in `expanded` (path); the root always."""
    top = F.col("path") == root
    marked = directories.join(expanded.select(F.col("path").alias("parent_path"), F.lit(True).alias("__open")).distinct(), "parent_path", "left")
    nodes = marked.select(F.col("path").alias("id"), F.when(~top, F.col("parent_path")).alias("anc"), (top | F.coalesce("__open", F.lit(False))).alias("shown"))
    shown = intervals.along(nodes, {"shown": lambda own, above: own & above}, LIMITS.tree_depth.bit_length()).where("shown and anc is null and not lost")
    return directories.join(shown.select(F.col("id").alias("path")), "path", "left_semi")


def flattened(directories: DataFrame, root: str, start: int = 0, rows: int | None = None, expanded: DataFrame | None = None) -> DataFrame:
    """Pre-order: position, depth, path, name, size_bytes, files; children by size (largest first), then path. Rows `start` to `start + rows`, all without `rows`.

    directories: path, parent_path, size_bytes, files (all of the tree). expanded: path of the directories whose children are shown; all without it. A node stands one behind its parent,
    and behind all nodes of the subtrees of the siblings in front of it; these offsets are running totals, and are added up along the pointers to the root.
    """
    if expanded is not None:
        directories = visible(directories, root, expanded)
    directories = scratch.save(directories.select("path", "parent_path", "size_bytes", "files"), "directories")
    counted = intervals.totals(directories.select("path"), directories.select("path", F.lit(1).alias("n")), ["n"]).join(directories, "path")
    below = counted.where(F.col("path") != root)
    ranked = scratch.save(intervals.prefix(below, [F.asc("parent_path"), F.desc("size_bytes"), F.asc("path")], {"__before": F.col("n")}), "ranked")
    first = ranked.groupBy("parent_path").agg(F.min("__before").alias("__first"))
    offset = (F.col("__before") - F.col("__first") + 1).cast("long")
    nodes = ranked.join(first, "parent_path").select(F.col("path").alias("id"), F.col("parent_path").alias("anc"), offset.alias("position"), F.lit(1).alias("depth"))
    nodes = nodes.unionByName(directories.where(F.col("path") == root).select(F.col("path").alias("id"), F.lit(None).cast("string").alias("anc"), F.lit(0).cast("long").alias("position"), F.lit(0).alias("depth")))
    add = lambda own, above: own + above
    out = intervals.along(nodes, {"position": add, "depth": add}, LIMITS.tree_depth.bit_length()).where("anc is null and not lost")
    if rows is not None:
        out = out.where(F.col("position").between(start, start + rows - 1))
    out = out.join(directories, F.col("id") == F.col("path"))
    return out.select(F.col("position").cast("int").alias("position"), "depth", "path", paths.name(F.col("path")).alias("name"), "size_bytes", "files")


def enumerated(records: DataFrame, root_id: str, root: str, most: int = LIMITS.bulk_records) -> DataFrame:
    """path, depth and the other columns of all below the root, from records (id, parent, name, is_directory, size_bytes, attributes, ...) of a bulk enumeration.

    What can't be trusted is refused by a ValueError: more than `most` records, an id that repeats, a name that is `.`, `..`, empty or has a separator, a record that does not hang below the root (missing
    parent, cycle, too deep), an offline file, and a file of several links where hardlink_count is given: an enumeration has one name a file. Links and what hangs below them are left out.
    """
    n, ids, bad = records.agg(F.count("*"), F.count_distinct("id"), F.count_if(F.col("name").isin(".", "..", "") | F.col("name").contains("/") | F.col("name").isNull())).first()
    if n > most or ids != n or bad:
        raise ValueError("too many records" if n > most else "an id repeats" if ids != n else "a name is no name")
    found = scratch.save(placed(records.select("id", "parent", "name"), root_id, root), "enumerated")
    if wrong := {r["verdict"]: r["count"] for r in found.where("verdict != 'reached'").groupBy("verdict").count().collect()}:
        raise ValueError(f"records do not hang below the root: {wrong}")
    rows = found.drop("verdict").join(records.drop("parent", "name").withColumn("id", F.col("id").cast("string")), "id").drop("id")
    link = F.col("attributes").bitwiseAND(REPARSE) != 0
    closed = rows.where(link & F.col("is_directory")).select("path")
    rows = scratch.save(intervals.not_below(rows, closed).where(~link), "enumerated")
    plain = ~F.col("is_directory")
    refused = [("offline files", plain & (F.col("attributes").bitwiseAND(OFFLINE_MASK) != 0))]
    if "hardlink_count" in rows.columns:
        refused.append(("files of several links", plain & (F.coalesce("hardlink_count", F.lit(0)) != 1)))
    counts = rows.agg(*(F.count_if(c).alias(f"c{i}") for i, (_, c) in enumerate(refused))).first()
    for (what, _), count in zip(refused, counts, strict=True):
        if count:
            raise ValueError(f"{count} {what}")
    return rows

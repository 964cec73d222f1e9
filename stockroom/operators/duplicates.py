"""Exact duplicates by stages: size, edge digest, full digest, physical identity.

Over a table that holds content, digests are made where the row is read and only digests are shuffled. Over a file tree, `digest` gives the bytes that
each stage really reads (see sources.content); the stages here only decide which files go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions import paths
from ..sources import scratch
from . import budget


def _few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """`df` marked for broadcast if it has no more than `most` rows, else for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def staged(files: DataFrame) -> DataFrame:
    """path, size_bytes, attributes, identity, fingerprint, hash of the files (content) that share their size with others and may be read. hash is null where no
    other file of the size has the same fingerprint: only the edges of those are read. The edges of a small file are all of it, so its fingerprint is its hash; content is read again for
    large files only, and is not shuffled while the keys are few."""
    c, n = F.col("content"), F.col("size_bytes")
    shared = _few(scratch.save(size_buckets(files).select("size_bytes"), "shared-sizes"))
    readable = files.where((n > 0) & ~paths.avoids_content(F.col("attributes"))).select("path", "size_bytes", "attributes", "identity", "content").join(shared, "size_bytes", "left_semi")
    edges = scratch.save(readable.withColumn("fingerprint", paths.edge_digest(c, n)).drop("content"), "edges")
    twice = _few(scratch.save(fingerprint_groups(edges).select("size_bytes", "fingerprint", F.lit(True).alias("twice")), "shared-fingerprints"))
    small = paths.edge_bytes(n) == n
    again = edges.where(~small).join(twice, ["size_bytes", "fingerprint"], "left_semi").select("path")
    out = edges.join(twice, ["size_bytes", "fingerprint"], "left").withColumn("hash", F.when(F.col("twice") & small, F.col("fingerprint")))
    if not (again := scratch.save(again, "again")).isEmpty():
        full = readable.where(~small).select("path", "content").join(_few(again), "path", "left_semi").select("path", F.sha2(c, 256).alias("__full"))
        out = out.join(scratch.save(full, "hashes"), "path", "left").withColumn("hash", F.coalesce("hash", "__full"))
    return scratch.save(out.select("path", "size_bytes", "attributes", "identity", "fingerprint", "hash"), "digests")


def size_buckets(files: DataFrame) -> DataFrame:
    """size_bytes, n of non-empty sizes that two or more files have."""
    return files.where("size_bytes > 0").groupBy("size_bytes").agg(F.count("*").alias("n")).where("n > 1")


def fingerprint_groups(digests: DataFrame) -> DataFrame:
    """size_bytes, fingerprint, n of edge digests that two or more files share."""
    return digests.groupBy("size_bytes", "fingerprint").agg(F.count("*").alias("n")).where("n > 1")


def hash_groups(digests: DataFrame) -> DataFrame:
    """size_bytes, hash, members, independent, aliases: files that share a full digest, counted by physical identity."""
    by_identity = digests.where("hash is not null").groupBy("size_bytes", "hash", "identity").agg(F.count("*").alias("n"))
    groups = by_identity.groupBy("size_bytes", "hash").agg(F.sum("n").alias("members"), F.count("*").alias("independent")).where("members > 1")
    return groups.withColumn("aliases", F.col("members") - F.col("independent"))


def groups(digests: DataFrame, most: int = LIMITS.identity_group) -> DataFrame:
    """hash, size_bytes, copies (one path of each identity, in order), potential_savings_bytes. Groups of more than `most` members are left out: they are not
    shown as verified; hash_groups() has them."""
    good = hash_groups(digests).where((F.col("members") <= most) & (F.col("independent") > 1))
    first = digests.where("hash is not null").groupBy("size_bytes", "hash", "identity").agg(F.min("path").alias("path")).join(good.select("size_bytes", "hash"), ["size_bytes", "hash"], "left_semi")
    listed = first.groupBy("size_bytes", "hash").agg(F.sort_array(F.collect_list("path")).alias("copies"))  # `most` paths at most
    return listed.select("hash", "size_bytes", "copies", paths.multiply_capped(F.col("size_bytes"), F.size("copies").cast("long") - 1).alias("potential_savings_bytes"))


def top_groups(digests: DataFrame, n: int = LIMITS.top) -> DataFrame:
    return groups(digests).orderBy(F.desc("potential_savings_bytes"), "size_bytes", "hash").limit(n)


def top_listed(digests: DataFrame, n: int = LIMITS.top, listed: int = LIMITS.identity_group) -> DataFrame:
    """top_groups() of groups of any size: hash, size_bytes, copies (the first `listed` in order), independent_copies (all), potential_savings_bytes."""
    best = [F.desc("potential_savings_bytes"), F.col("size_bytes"), F.col("hash")]
    good = hash_groups(digests).where("independent > 1").select("hash", "size_bytes", F.col("independent").alias("independent_copies"), paths.multiply_capped(F.col("size_bytes"), F.col("independent") - 1).alias("potential_savings_bytes"))
    first = digests.where("hash is not null").groupBy("size_bytes", "hash", "identity").agg(F.min("path").alias("path")).join(F.broadcast(good.orderBy(*best).limit(n)), ["size_bytes", "hash"])
    some = first.withColumn("__place", F.row_number().over(Window.partitionBy("size_bytes", "hash").orderBy("path"))).where(F.col("__place") <= listed)
    return some.groupBy("hash", "size_bytes", "independent_copies", "potential_savings_bytes").agg(F.sort_array(F.collect_list("path")).alias("copies")).orderBy(*best)


def summary(digests: DataFrame, most: int | None = LIMITS.identity_group) -> DataFrame:
    """One row over all groups, also those that a ranking does not show: groups, potential_savings_bytes, hardlink_aliases, oversize_groups. Without `most`, groups of any size count."""
    g = hash_groups(digests)
    small, real = F.lit(True) if most is None else F.col("members") <= most, F.col("independent") > 1
    total = lambda v, where: F.coalesce(F.sum(F.when(where, v)), F.lit(0)).cast("long")
    return g.agg(F.count_if(small & real).alias("groups"), total(F.col("size_bytes") * (F.col("independent") - 1), small & real).alias("potential_savings_bytes"), total(F.col("aliases"), small).alias("hardlink_aliases"), F.count_if(~small).alias("oversize_groups"))


def stage_bytes(files: DataFrame, digests: DataFrame) -> DataFrame:
    """One row: fingerprint_bytes_read, full_hash_bytes_read, hash_bytes_read that the stages need without a budget."""
    first = digests.agg(F.coalesce(F.sum(paths.edge_bytes(F.col("size_bytes"))), F.lit(0)).cast("long").alias("fingerprint_bytes_read"))
    second = fingerprint_groups(digests).agg(F.coalesce(F.sum(F.col("size_bytes") * F.col("n")), F.lit(0)).cast("long").alias("full_hash_bytes_read"))
    return first.join(F.broadcast(second)).withColumn("hash_bytes_read", F.col("fingerprint_bytes_read") + F.col("full_hash_bytes_read"))


def within_budget(files: DataFrame, limit: int | None, cost: Column) -> DataFrame:
    """`files` with `admitted`, by the greedy budget over sizes; all without a limit."""
    if limit is None:
        return files.withColumn("admitted", F.lit(True))
    sizes = files.groupBy("size_bytes").agg(F.count("*").alias("n"))
    return budget.admit(files, budget.greedy(sizes, limit, cost))

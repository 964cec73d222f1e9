"""Exact comparison of two trees: which candidates are independent copies of a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from . import budget


def same_sizes(files: DataFrame, other: DataFrame) -> DataFrame:
    """Non-empty files of a size that `other` has too."""
    return files.where("size_bytes > 0").join(other.select("size_bytes").distinct(), "size_bytes", "left_semi")


def within_prefix(files: DataFrame, limit: int | None) -> DataFrame:
    """`files` with `admitted`: smallest first, as far as the budget goes; all without a limit. References are admitted first; candidates get what their reading left."""
    if limit is None:
        return files.withColumn("admitted", F.lit(True))
    return budget.admit(files, budget.prefix(files.groupBy("size_bytes").agg(F.count("*").alias("n")), limit))


def classified(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Candidates whose (size_bytes, hash) a reference has: candidate_path, identity, size_bytes, hash, reference_path, outcome.

    Both sides: path, size_bytes, identity, hash. outcome: `match`, with the first reference in component order; `alias` where the candidate is physically
    some reference, or physically a candidate that came before it. All references of a key are independent of a candidate that is none of them, so
    the first one serves every candidate of the key: no pairs are made.
    """
    key = ["size_bytes", "hash"]
    order = F.split("path", "/")
    first = reference.groupBy(key).agg(F.min_by("path", order).alias("reference_path"))
    same = reference.select(*key, "identity").distinct().withColumn("__same", F.lit(True))
    found = candidate.select("path", *key, "identity").join(first, key).join(same, [*key, "identity"], "left")
    earlier = F.row_number().over(Window.partitionBy(*key, "identity").orderBy(order)) > 1
    outcome = F.when(F.col("__same") | earlier, "alias").otherwise("match")
    return found.select(F.col("path").alias("candidate_path"), "identity", *key, "reference_path", F.coalesce(outcome, F.lit("match")).alias("outcome"))


def top_matches(found: DataFrame, n: int = LIMITS.top) -> DataFrame:
    return found.where("outcome = 'match'").orderBy(F.desc("size_bytes"), F.desc("candidate_path")).limit(n).select("candidate_path", "reference_path", "size_bytes", "hash")


def totals(found: DataFrame) -> DataFrame:
    """One row: matched_candidates, hardlink_aliases, potential_logical_savings_bytes."""
    match = F.col("outcome") == "match"
    return found.agg(F.count_if(match).alias("matched_candidates"), F.count_if(~match).alias("hardlink_aliases"), F.coalesce(F.sum(F.when(match, F.col("size_bytes"))), F.lit(0)).cast("long").alias("potential_logical_savings_bytes"))

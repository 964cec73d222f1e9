"""Audit of a manifest against a directory listing, and measured allocation of chosen files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS, NO_CONTENT_MASK, SYSTEM
from ..functions import paths


def issues(manifest: DataFrame, listing: DataFrame, truncated: bool = False, check_ids: bool = True) -> DataFrame:
    """id, original_path, kind of what does not fit. manifest: id, original_path, size_bytes, state; listing: name, size_bytes, is_regular.

    kind: `invalid_id` (no canonical UUID), `pending` (prepared), `missing` (quarantined, not there), `changed` (quarantined, no regular file or of another
    size), `unexpected` (restored or failed, yet there), `orphan` (there, in no entry; not looked for if the manifest was truncated).
    """
    m = manifest.select("id", "original_path", F.col("size_bytes").alias("expected"), "state", F.lit(True).alias("listed"))
    l = listing.select(F.col("name").alias("id"), F.col("size_bytes").alias("found"), "is_regular", F.lit(True).alias("there"))  # noqa: E741
    there, invalid = F.col("there").isNotNull(), ~paths.valid_uuid(F.col("id")) if check_ids else F.lit(False)
    kind = (
        F.when(F.col("listed").isNull(), "orphan").when(invalid, "invalid_id").when(F.col("state") == "prepared", "pending")
        .when((F.col("state") == "quarantined") & ~there, "missing")
        .when((F.col("state") == "quarantined") & (~F.col("is_regular") | (F.col("found") != F.col("expected"))), "changed")
        .when(F.col("state").isin("restored", "failed") & there, "unexpected")
    )
    found = m.join(l, "id", "left" if truncated else "full_outer").select(F.left("id", F.lit(120)).alias("id"), "original_path", kind.alias("kind"))
    return found.where("kind is not null")


def counters(found: DataFrame) -> DataFrame:
    """One row of what issues() found; an invalid id counts as unexpected."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return found.agg(n("missing").alias("missing_files"), n("orphan").alias("orphan_files"), n("pending").alias("pending_entries"), n("unexpected", "invalid_id").alias("unexpected_files"), n("changed").alias("changed_files"))


def audit(manifest: DataFrame, listing: DataFrame, limit: int = LIMITS.audit_rows) -> tuple[DataFrame, bool]:
    """Issues of the first `limit` entries by `seq`, and whether there were more entries or files."""
    some = manifest.orderBy("seq").limit(limit)
    truncated = manifest.limit(limit + 1).count() > limit or listing.limit(limit + 1).count() > limit
    return issues(some, listing, truncated), truncated


def quarantined(manifest: DataFrame, listing: DataFrame, n: int = LIMITS.quarantine_rows, check_ids: bool = True) -> DataFrame:
    """The latest `n` entries that are prepared or quarantined; of these, those with a valid id and a regular file. The limit comes first."""
    some = manifest.where(F.col("state").isin("prepared", "quarantined")).orderBy(F.desc("created_at_unix"), "id").limit(n)
    some = some.where(paths.valid_uuid(F.col("id"))) if check_ids else some
    return some.join(listing.where("is_regular").select(F.col("name").alias("id")), "id", "left_semi")


def state_of(log: DataFrame) -> DataFrame:
    """The last state of each entry of an append-only log (id, seq, state, ...)."""
    return log.groupBy("id").agg(F.max_by(F.struct("*"), "seq").alias("r")).select("r.*")


def allocation(targets: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """path, logical_bytes, allocated_bytes, hardlink_count, status of targets (path, expected_size_bytes).

    files: path, size_bytes, attributes, allocated_bytes, hardlink_count, is_regular. status, the first of: `outside` (not absolute), `unavailable` (not
    there), `excluded` (no local regular file), `changed` (another size), `outside` (not under the root), `measured`. Only measured ones have figures.
    """
    f = files.select("path", "size_bytes", "attributes", "allocated_bytes", "hardlink_count", "is_regular", F.lit(True).alias("there"))
    status = (
        F.when(~F.col("path").startswith("/"), "outside").when(F.col("there").isNull(), "unavailable")
        .when(~F.col("is_regular") | paths.avoids_content(F.col("attributes")), "excluded").when(F.col("size_bytes") != F.col("expected_size_bytes"), "changed")
        .when(~paths.is_under(F.col("path"), root), "outside").when(F.col("allocated_bytes").isNull(), "unavailable").otherwise("measured")
    )
    out = targets.join(f, "path", "left").withColumn("status", status)
    only = lambda c: F.when(F.col("status") == "measured", F.col(c)).alias(c)
    return out.select("path", F.col("expected_size_bytes").alias("logical_bytes"), only("allocated_bytes"), only("hardlink_count"), "status")


def allocation_counters(items: DataFrame) -> DataFrame:
    s = F.col("status")
    return items.agg(F.count_if(s == "measured").alias("measured"), F.count_if(s.isin("outside", "excluded", "changed")).alias("skipped"), F.count_if(s == "unavailable").alias("failed"))


def step_of(log: DataFrame) -> DataFrame:
    """`log` (id, seq, state, ...) with `previous` state and `allowed`: an entry begins as prepared, goes on to quarantined or failed, and from
    quarantined to restored; nothing follows restored or failed."""
    previous = F.lag("state").over(Window.partitionBy("id").orderBy("seq"))
    allowed = F.when(F.col("previous").isNull(), F.col("state") == "prepared").when(F.col("previous") == "prepared", F.col("state").isin("quarantined", "failed")).when(F.col("previous") == "quarantined", F.col("state") == "restored")
    return log.withColumn("previous", previous).withColumn("allowed", F.coalesce(allowed, F.lit(False)))


def eligible(files: DataFrame, protected: list[str], exempt: list[str] = ()) -> Column:
    """Whether a file may be put away: an absolute path, a regular local file that isn't a system file, one link, not under a protected folder, except
    under an exempt one. files: path, kind, attributes, hardlink_count."""
    path, under = F.col("path"), F.lit(False)
    for folder in protected:
        under = under | paths.is_under(path, folder)
    free = F.lit(False)
    for folder in exempt:
        free = free | paths.is_under(path, folder)
    plain = (F.col("kind") == "file") & (F.col("attributes").bitwiseAND(NO_CONTENT_MASK | SYSTEM) == 0) & (F.col("hardlink_count") == 1)
    return F.coalesce(path.startswith("/") & plain & (~under | free), F.lit(False))


def granted(events: DataFrame, seconds: int = LIMITS.grant_seconds) -> DataFrame:
    """Uses with whether they were granted. events: subject, at (timestamp), seq, kind (`grant`, `use`). A use needs a grant right before it, at most `seconds`
    old; it spends that grant, granted or not."""
    order = Window.partitionBy("subject").orderBy("at", "seq")
    seen = events.withColumn("before", F.lag(F.struct("kind", "at")).over(order)).where("kind = 'use'")
    age = F.unix_micros("at") - F.unix_micros("before.at")
    return seen.select("subject", "seq", F.coalesce((F.col("before.kind") == "grant") & (age <= seconds * 1_000_000), F.lit(False)).alias("granted"))

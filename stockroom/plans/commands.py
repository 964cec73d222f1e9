"""The commands: each takes a request, runs DataFrame queries over a file tree or a published snapshot, and gives a report with bounded lists.

Reports are dicts with camel-case keys. What was not measured is None, never 0. A report that left anything out says so.
"""

from __future__ import annotations

import functools
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BUDGETS, LIMITS, REPARSE
from ..functions import paths
from ..operators import audit, compare, duplicates, hierarchy, report, search, snapshot
from ..sources import content, scratch, tree
from . import store
from .jobs import Cancelled, Job, watched


#: Rows of changed paths that are broadcast, at most.
FEW = 100_000


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def _rows(df: DataFrame) -> list[dict]:
    return [{_camel(k): v for k, v in r.asDict().items()} for r in df.collect()]


def _one(df: DataFrame) -> dict:
    return df.first().asDict()


def _releasing(command):
    """The command, whose intermediate tables go when its report is made. What fails because its job was cancelled, within a stage too, is Cancelled."""

    @functools.wraps(command)
    def run(*args, **kwargs):
        job = kwargs.get("job")
        try:
            with scratch.released():
                return command(*args, **kwargs)
        except Exception as e:
            if isinstance(job, Job) and job.cancelled and not isinstance(e, Cancelled):
                raise Cancelled(job.id) from e
            raise

    return run


class _Clock:
    def __init__(self) -> None:
        self._at = time.monotonic()

    def ms(self) -> int:
        return int(1000 * (time.monotonic() - self._at))


def _inventory(spark: SparkSession, root: str, job: Job | None = None) -> tuple[str, DataFrame, DataFrame, dict]:
    """(root, files, directories, counts): entries of a tree without links. Directories that are not local are counted and never opened."""
    root = tree.checked_root(root)
    with watched(job, spark, "scanning", "files") as (seen,):
        entries = tree.read(spark, root, seen=seen, between=job and job.check)
    directories = tree.directories_of(entries, root)
    virtual = paths.avoids_content(F.col("attributes"))
    errors = entries.where("error is not null")
    counts = {"errors": errors.count(), "samples": [r[0] for r in errors.select("error").orderBy("error").limit(LIMITS.scan_errors).collect()], "pruned": directories.where(virtual).count(), "entries": entries}
    return root, tree.files_of(entries), directories.where(~virtual), counts


@_releasing
def scan_path(spark: SparkSession, root: str, regex: str | None = None, min_size_bytes: int = 0, max_files: int | None = None, analyze_duplicates: bool = True, hash_budget: str | None = None, job: Job | None = None) -> dict:
    """Storage report of a tree, with exact duplicates unless told otherwise. hash_budget: standard (default), deep or unlimited."""
    if hash_budget not in BUDGETS:
        raise ValueError(f"unknown budget {hash_budget}")
    budget, clock, check = BUDGETS[hash_budget], _Clock(), job.check if job else lambda *a, **k: None
    search.checked_pattern(regex)
    root, files, directories, seen = _inventory(spark, root, job)
    files, truncated = search.sample(files, max_files)
    files = scratch.save(files, "files")
    check("scanned", files=files.count(), errors=seen["errors"])
    out = {"root": root, **{_camel(k): v for k, v in _one(report.totals(files, root, directories)).items()}, "errors": seen["errors"], "errorSamples": seen["samples"], "truncated": truncated}
    out |= {
        "topFiles": _rows(report.top_files(files)), "topDirectories": _rows(report.top_directories(files, root, directories)), "fileTypes": _rows(report.top_types(files)),
        "matches": [{k: v for k, v in r.items() if k != "totalMatches"} for r in _rows(search.search(files, regex, min_size_bytes))], "totalMatches": search.counts(files, regex, min_size_bytes).first()["total_matches"],
    }
    check()
    if not analyze_duplicates:
        out |= {"hashingSkipped": True, "duplicateAnalysisComplete": False, "duplicates": [], "potentialSavingsBytes": 0, "hardlinkAliases": 0, "skippedContentFiles": 0, "hashBytesRead": 0, "fingerprintBytesRead": 0, "fullHashBytesRead": 0, "hashReadBudgetBytes": None}
    else:
        out |= _duplicates(files, budget, seen, truncated, check, job)
    return out | {"elapsedMs": clock.ms()}


def _hashed(files: DataFrame, edges: bool, column: str, name: str, job: Job | None, phase: str) -> DataFrame:
    """Digests of files, saved, with events of the bytes that are read meanwhile."""
    with watched(job, files.sparkSession, phase, "bytesRead") as (read,):
        return scratch.save(content.digests(files, edges, column, read), name)


def _duplicates(files: DataFrame, budget: int | None, seen: dict, truncated: bool, check, job: Job | None = None) -> dict:
    shared = files.where("size_bytes > 0").join(duplicates.size_buckets(files).select("size_bytes"), "size_bytes", "left_semi")
    skipped = shared.where(paths.avoids_content(F.col("attributes"))).count()
    readable = shared.where(~paths.avoids_content(F.col("attributes")))
    clock = _Clock()
    sampled = duplicates.within_budget(readable, budget, paths.edge_bytes(F.col("size_bytes")))
    sampled = scratch.save(sampled, "sampled")
    edges = _hashed(sampled.where("admitted").drop("admitted"), True, "fingerprint", "edges", job, "fingerprinting")
    read = edges.agg(F.coalesce(F.sum("bytes_read"), F.lit(0))).first()[0]
    edge_ms, check_clock = clock.ms(), _Clock()
    check("fingerprinted", bytesRead=read)
    good = edges.where("status = 'ok'")
    pairs = good.join(duplicates.fingerprint_groups(good).select("size_bytes", "fingerprint"), ["size_bytes", "fingerprint"], "left_semi")
    wanted = scratch.save(duplicates.within_budget(pairs, None if budget is None else budget - read, F.col("size_bytes")), "wanted")
    full = _hashed(wanted.where("admitted").drop("admitted"), False, "hash", "full", job, "hashing")
    read_full = full.agg(F.coalesce(F.sum("bytes_read"), F.lit(0))).first()[0]
    full_ms = check_clock.ms()
    check("hashed", bytesRead=read + read_full)
    hashed = full.where("status = 'ok'")
    total = _one(duplicates.summary(hashed, None))  # identities come with the walk, so groups of any size are verified
    bad = edges.where("status != 'ok'").count() + full.where("status != 'ok'").count()
    over = sampled.where("not admitted").count() + wanted.where("not admitted").count()
    complete = not (seen["pruned"] or seen["errors"] or truncated or skipped or bad or over)
    found = {
        "hashingSkipped": False, "duplicateAnalysisComplete": complete, "duplicates": _rows(duplicates.top_listed(hashed)), "potentialSavingsBytes": total["potential_savings_bytes"],
        "hardlinkAliases": total["hardlink_aliases"], "skippedContentFiles": skipped + seen["pruned"], "hashBytesRead": read + read_full, "fingerprintBytesRead": read, "fullHashBytesRead": read_full,
        "fingerprintElapsedMs": edge_ms, "fullHashElapsedMs": full_ms, "hashReadBudgetBytes": budget, "errors": seen["errors"] + bad,
    }
    return found


@_releasing
def search_path(spark: SparkSession, root: str, regex: str | None = None, min_size_bytes: int = 0, max_files: int | None = None) -> dict:
    clock = _Clock()
    search.checked_pattern(regex)
    root, files, _, seen = _inventory(spark, root)
    files, truncated = search.sample(files, max_files)
    rows = _rows(search.search(files, regex, min_size_bytes))
    n = _one(search.counts(files, regex, min_size_bytes))
    return {"root": root, "filesScanned": n["files_scanned"], "totalMatches": n["total_matches"], "matches": [{k: v for k, v in r.items() if k != "totalMatches"} for r in rows], "errors": seen["errors"], "truncated": truncated, "elapsedMs": clock.ms()}


@_releasing
def compare_folders(spark: SparkSession, reference_root: str, candidate_root: str, max_files: int | None = None, job: Job | None = None, read_budget: int | None = None) -> dict:
    """Candidates that are independent copies of a reference, by content: of all files, unless `max_files` a tree or `read_budget` bytes in all are set. A report that left anything out is not complete."""
    clock, check = _Clock(), job.check if job else lambda *a, **k: None
    a, b = tree.checked_root(reference_root), tree.checked_root(candidate_root)
    if a == b or a.startswith(b.rstrip("/") + "/") or b.startswith(a.rstrip("/") + "/"):
        raise ValueError("the two trees overlap")
    sides = []
    for root in (a, b):
        _, files, _, seen = _inventory(spark, root, job)
        links = seen["entries"].where("kind = 'symlink'").count()
        some, cut = search.sample(files.where("size_bytes > 0"), None if max_files is None else max(1, max_files))
        sides.append((scratch.save(some, "side"), cut, seen, links))
        check()
    (ref, cut_a, seen_a, links_a), (cand, cut_b, seen_b, links_b) = sides
    hash_clock = _Clock()
    wanted = compare.within_prefix(compare.same_sizes(ref, cand), read_budget)
    wanted = scratch.save(wanted, "wanted")
    left = _hashed(wanted.where("admitted").drop("admitted"), False, "hash", "left", job, "hashing reference")
    used = left.agg(F.coalesce(F.sum("bytes_read"), F.lit(0))).first()[0]
    check("reference hashed", bytesRead=used)
    good = left.where("status = 'ok'")
    right_wanted = compare.within_prefix(compare.same_sizes(cand, good), None if read_budget is None else read_budget - used)
    right_wanted = scratch.save(right_wanted, "wanted")
    right = _hashed(right_wanted.where("admitted").drop("admitted"), False, "hash", "right", job, "hashing candidates")
    read = used + right.agg(F.coalesce(F.sum("bytes_read"), F.lit(0))).first()[0]
    check("candidates hashed", bytesRead=read)
    found = compare.classified(good, right.where("status = 'ok'"))
    found = scratch.save(found, "classified")
    total = _one(compare.totals(found))
    bad = left.where("status != 'ok'").count() + right.where("status != 'ok'").count()
    over = wanted.where("not admitted").count() + right_wanted.where("not admitted").count()
    skipped = seen_a["pruned"] + seen_b["pruned"] + links_a + links_b
    errors = seen_a["errors"] + seen_b["errors"] + bad
    out = {
        "referenceRoot": a, "candidateRoot": b, "referenceFiles": ref.count(), "candidateFiles": cand.count(), **{_camel(k): v for k, v in total.items()}, "matches": _rows(compare.top_matches(found)),
        "hashBytesRead": read, "hashStageElapsedMs": hash_clock.ms(), "skippedCloudFiles": skipped, "errors": errors, "errorSamples": (seen_a["samples"] + seen_b["samples"])[: LIMITS.compare_errors],
        "truncated": cut_a or cut_b, "complete": not (cut_a or cut_b or errors or skipped or over), "elapsedMs": clock.ms(),
    }
    return out


def measure_allocated_sizes(spark: SparkSession, root: str, targets: list[tuple[str, int]]) -> dict:
    if len(targets) > LIMITS.allocation_targets:
        raise ValueError(f"at most {LIMITS.allocation_targets} targets")
    clock = _Clock()
    root = tree.checked_root(root)
    asked = spark.createDataFrame(targets, "path string, expected_size_bytes long")
    rows = [(*r, r[1] == "file") for r in (tree._row(p) for p, _ in targets if os.path.isabs(p)) if r[1] != "error"]
    facts = spark.createDataFrame(rows, tree.SCHEMA + ", is_regular boolean").dropDuplicates(["path"])
    items = audit.allocation(asked, facts, root)
    return {"items": _rows(items), **_one(audit.allocation_counters(items)), "elapsedMs": clock.ms()}


def _enumerated(bulk: tuple, root: str) -> DataFrame | None:
    """Entries out of a bulk enumeration, or None if it can't be trusted. bulk: (records, id of the root), or these and the journal's watermarks before and after the enumeration, which must be equal;
    records: see hierarchy.enumerated(), with modified_ns."""
    if len(bulk) == 4 and bulk[2] != bulk[3]:  # the volume has changed meanwhile
        return None
    try:
        found = hierarchy.enumerated(scratch.save(bulk[0], "bulk"), bulk[1], root)
    except ValueError:
        return None
    return found.select("path", F.when(F.col("is_directory"), "directory").otherwise("file").alias("kind"), "size_bytes", "modified_ns", F.col("attributes").cast("long").alias("attributes"), F.lit(None).cast("string").alias("identity"), F.lit(None).cast("long").alias("hardlink_count"), F.lit(None).cast("long").alias("allocated_bytes"), F.lit(None).cast("string").alias("error"))


@_releasing
def refresh_index(spark: SparkSession, base: str, root: str, max_files: int | None = None, watermark: dict | None = None, job: Job | None = None, bulk: tuple | None = None) -> dict:
    """Take a snapshot of a tree and publish it: out of `bulk` (see _enumerated()), where it is given and sound, else by a walk. Anything unreadable, a cap that is exceeded, or a cancel
    publishes nothing. The watermark is the journal's position before the walk, so changes meanwhile are read again. With an unchanged watermark the last result stands."""
    clock, s, check = _Clock(), store.Store(spark, base), job.check if job else lambda *a, **k: None
    root = tree.checked_root(root)
    old = s.scope(root)
    if old is not None and watermark is not None and old.watermark == watermark:
        return {"root": root, "files": old.file_count, "added": 0, "changed": 0, "unchanged": old.file_count, "removed": 0, "skippedDirectories": 0, "completedAtUnix": old.completed_at_unix, "batchesWritten": 0, "indexMethod": "unchanged", "elapsedMs": clock.ms()}
    own = tree.plain(s.base.removeprefix("file:")) if "://" not in s.base or s.base.startswith("file:") else None
    entries = _enumerated(bulk, root) if bulk is not None else None
    method = "walk" if entries is None else "bulk"
    with watched(job, spark, "indexing", "files") as (seen,):
        entries = tree.read(spark, root, closed=REPARSE, seen=seen, between=job and job.check) if entries is None else scratch.save(entries, "entries")
    if own is not None:  # the store's own files change while it is written
        entries = entries.where(~paths.is_under(F.col("path"), own))
    if (first := entries.where("error is not null").first()) is not None:
        raise OSError(first["error"])
    check()
    dirs = tree.directories_of(entries, root)
    reparse = F.col("attributes").bitwiseAND(REPARSE) != 0
    skipped = dirs.where(reparse).count()
    files, dirs = tree.files_of(entries).where(~reparse), dirs.where(~reparse)
    files = files.withColumn("parent_path", paths.parent(F.col("path")))
    if max_files is not None and files.limit(max_files + 1).count() > max_files:
        raise ValueError(f"more than {max_files} files")
    staged = s.stage(root, files, report.rollup(files, root, dirs))
    check("staged")
    new = s.staged_files(root, staged)
    counts = _one(snapshot.change_counts(snapshot.changes(s.files(old) if old else new.limit(0), new)))
    check()
    scope = s.publish(root, staged, watermark)
    s.vacuum(root)
    return {"root": root, **counts, "skippedDirectories": skipped, "completedAtUnix": scope.completed_at_unix, "batchesWritten": s.parts(root, staged), "indexMethod": method, "elapsedMs": clock.ms()}


@_releasing
def apply_changes(spark: SparkSession, base: str, root: str, changed: list[tuple[str, int]] | DataFrame, watermark: dict | None = None) -> store.Scope:
    """Publish new sizes of known files, with the totals of all directories above them, as a new revision. An unknown path undoes the whole batch. changed: pairs, or a table of
    path and size_bytes of any length; of rows that repeat a path the largest size counts."""
    from ..operators import journal

    s = store.Store(spark, base)
    scope = s.scope(root)
    if scope is None:
        raise ValueError("nothing is published for this root")
    if isinstance(changed, DataFrame):
        new = scratch.save(changed.groupBy("path").agg(F.max("size_bytes").alias("new_size")), "changed")
    else:
        new = spark.createDataFrame(list(dict(changed).items()), "path string, new_size long")
    n = new.count()
    files, dirs = s.files(scope), s.directories(scope)
    hit = scratch.save(files.join(F.broadcast(new) if n <= FEW else new, "path"), "hit")
    if hit.count() != n:
        raise ValueError("a changed path is not in the snapshot")
    deltas = hit.select("path", (F.col("new_size") - F.col("size_bytes")).alias("delta"))
    rows = hit.select("path", "parent_path", F.col("new_size").alias("size_bytes"), "modified_ns", "attributes")
    above = journal.directory_deltas(deltas, root).select("path")
    touched = journal.apply(dirs.join(above, "path", "left_semi"), deltas, root)
    return s.overlay(scope, rows, touched, watermark)


def search_index(spark: SparkSession, base: str, root: str, regex: str | None = None, min_size_bytes: int = 0) -> dict:
    s = store.Store(spark, base)
    scope = s.scope(root)
    if scope is None:
        raise ValueError("nothing is published for this root")
    files = s.files(scope)
    rows = _rows(search.search(files, regex, min_size_bytes))
    n = _one(search.counts(files, regex, min_size_bytes, indexed=True))
    return {"report": {"root": root, "filesScanned": n["files_scanned"], "totalMatches": n["total_matches"], "matches": [{k: v for k, v in r.items() if k != "totalMatches"} for r in rows]}, "completedAtUnix": scope.completed_at_unix}


def list_indexed_scopes(spark: SparkSession, base: str) -> list[dict]:
    return [{"root": s.root, "files": s.file_count, "completedAtUnix": s.completed_at_unix, "hasTree": s.has_tree} for s in store.Store(spark, base).scopes(LIMITS.scopes)]


@_releasing
def browse_index_tree(spark: SparkSession, base: str, root: str, parent_path: str, after: dict | None = None, limit: int | None = None, generation: int | None = None) -> dict:
    """A page of a directory's children. `generation` in requests and pages is the revision: it changes with every publication."""
    if not (parent_path == root or parent_path.startswith(root.rstrip("/") + "/")):
        raise ValueError("the directory is not in this root")
    if after is not None and (after["kind"] not in ("directory", "file") or os.path.dirname(after["path"]) != parent_path):
        raise ValueError("the cursor belongs to another directory")
    s = store.Store(spark, base)
    scope = s.scope(root)
    if scope is None:
        raise ValueError("nothing is published for this root")
    if not scope.has_tree:
        raise ValueError("the snapshot has no tree yet: refresh it")
    if generation is not None and generation != scope.revision:
        raise ValueError("the snapshot has been replaced meanwhile")
    n = max(1, min(limit if limit is not None else LIMITS.page, LIMITS.page_most))
    cursor = (after["sizeBytes"], after["path"]) if after else None
    rows = []
    if after is None or after["kind"] == "directory":
        found = s.children(scope, "directories", parent_path, cursor, n + 1)
        rows, cursor = _rows(snapshot.children(found.limit(0).selectExpr("path", "parent_path", "size_bytes", "0 as attributes"), found, parent_path).drop("kind_rank")), None
    if len(rows) <= n:
        found = s.children(scope, "files", parent_path, cursor, n + 1 - len(rows))
        rows += _rows(snapshot.children(found, found.limit(0).selectExpr("path", "parent_path", "size_bytes", "0L as files"), parent_path).drop("kind_rank"))
    rows.sort(key=lambda r: (r["kind"] != "directory", -r["sizeBytes"], r["path"].encode()))
    last = rows[n - 1] if len(rows) > n else None
    return {"root": root, "parentPath": parent_path, "nodes": rows[:n], "nextCursor": last and {"kind": last["kind"], "sizeBytes": last["sizeBytes"], "path": last["path"]}, "completedAtUnix": scope.completed_at_unix, "generation": scope.revision}


def audit_quarantine(spark: SparkSession, manifest: DataFrame, folder: str, limit: int = LIMITS.audit_rows) -> dict:
    entries = tree.read(spark, folder, depth="1")
    listing = entries.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "size_bytes", (F.col("kind") == "file").alias("is_regular"))
    found, truncated = audit.audit(manifest, listing, limit)
    counts = _one(audit.counters(found))
    return {"checkedEntries": manifest.limit(limit).count(), "checkedFiles": listing.limit(limit).count(), **{_camel(k): v for k, v in counts.items()}, "truncated": truncated, "issues": _rows(found.orderBy("id", "kind"))}


def list_quarantine(spark: SparkSession, manifest: DataFrame, folder: str) -> list[dict]:
    entries = tree.read(spark, folder, depth="1")
    listing = entries.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "size_bytes", (F.col("kind") == "file").alias("is_regular"))
    return _rows(audit.quarantined(manifest, listing).orderBy(F.desc("created_at_unix"), "id"))


@_releasing
def refresh_from_journal(spark: SparkSession, base: str, root: str, now, records: DataFrame, ids: DataFrame, job: Job | None = None, bulk: tuple | None = None) -> dict:
    """Bring a snapshot up to `now` (a journal.Watermark) by the cheapest way that holds: `unchanged`, `delta`, `bulk` (see refresh_index()), or `walk`.

    records: usn, file_id, reason, size_bytes; ids: file_id, path, one row a file. A delta needs an unbroken journal, no structural change,
    and every changed file in the snapshot; it may have any number of files. An unchanged tree keeps its watermark, so the next refresh reads these records again.
    """
    from dataclasses import asdict

    from ..operators import journal

    s, clock = store.Store(spark, base), _Clock()
    scope = s.scope(root)
    old = journal.Watermark(**scope.watermark) if scope is not None and scope.watermark else None
    if old is not None and journal.continues(old, now):
        some = scratch.save(journal.relevant(journal.between(records, old, now)), "records")
        try:
            stats = {"root": root, "files": scope.file_count, "added": 0, "removed": 0, "skippedDirectories": 0, "completedAtUnix": scope.completed_at_unix}
            if some.isEmpty():
                return stats | {"changed": 0, "unchanged": scope.file_count, "batchesWritten": 0, "indexMethod": "unchanged", "elapsedMs": clock.ms()}
            last = journal.latest(some)
            if {"hardlink_count", "attributes"} <= set(ids.columns):  # one name and one link a file, and none of it virtual
                ids = journal.resolved(last, ids, root)
            changed = last.join(ids, "file_id", "left").select("path", F.col("size_bytes"))
            if journal.structural(some).isEmpty() and changed.where("path is null").isEmpty():
                changed = scratch.save(changed, "changed")
                n = changed.select("path").distinct().count()
                new = apply_changes(spark, base, root, changed, asdict(now))
                return stats | {"changed": n, "unchanged": scope.file_count - n, "batchesWritten": 1, "completedAtUnix": new.completed_at_unix, "indexMethod": "delta", "elapsedMs": clock.ms()}
        except ValueError:
            pass  # a changed file that the snapshot does not have: read the tree
    return refresh_index(spark, base, root, watermark=asdict(now), job=job, bulk=bulk)


def quick_progress(df: DataFrame, name: str = "progress") -> tuple[DataFrame, object]:
    """`df` with counters that are filled while it runs: files and bytes, and no names."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("files_scanned"), F.sum("size_bytes").alias("logical_bytes")), seen

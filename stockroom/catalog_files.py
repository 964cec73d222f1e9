"""Registered queries over real files: all documents are written as files on shared storage first, so walks, content, reports and refreshes meet a file system."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _files, query
from .functions import display
from .operators import journal, report
from .plans import commands, jobs, store
from .sources import content, scratch, tree
from .sources.adapter import FILES_SQL, ROOT

_WHOLE = f"{FILES_SQL}, w AS (SELECT * FROM files WHERE path IS NOT NULL AND text IS NOT NULL)"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content_ in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(content_.as_buffer())  # no copy of a batch's content
            os.replace(part, path)
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])


def _put(rows: DataFrame, root: str) -> None:
    """Write rows (path below ROOT, content) as files below `root`, which all tasks open by its path."""
    scratch.ship(rows.sparkSession)
    with scratch.small_batches(rows.sparkSession):
        rows.where("path is not null and content is not null").select(F.concat(F.lit(root), F.substr("path", F.lit(len(ROOT) + 1))).alias("path"), "content").mapInArrow(_write, "n long").agg(F.sum("n")).first()


def _folder(spark: SparkSession) -> str:
    return scratch.local(scratch.folder(spark, f"files-{uuid.uuid4().hex}"))


def _tree(spark: SparkSession, sf_dir: str) -> str:
    root = _folder(spark)
    _put(_files(spark, sf_dir), root)
    return root


def _inside(path: str, root: str):
    return F.concat(F.lit(ROOT), F.substr(path, F.lit(len(root) + 1)))


@query(f"""WITH {_WHOLE}, d AS (SELECT DISTINCT '/corpus/' || source AS path FROM w UNION SELECT DISTINCT '/corpus/' || source || '/' || lang FROM w)
SELECT path, 'file' AS kind, size_bytes, true AS has_facts FROM w UNION ALL SELECT path, 'directory', 0, true FROM d""")
def walked_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree(spark, sf_dir)
    facts = F.col("identity").rlike("^[0-9]+:[0-9]+$") & (F.col("modified_ns") > 0) & (F.col("hardlink_count") >= 1) & (F.col("allocated_bytes") >= 0) & F.col("error").isNull()
    return tree.read(spark, root).select(_inside("path", root).alias("path"), "kind", "size_bytes", facts.alias("has_facts"))


@query(f"WITH {_WHOLE} SELECT path, sha256(text) AS hash, 'ok' AS status, size_bytes AS bytes_read FROM w WHERE doc_id % 11 <> 0 UNION ALL SELECT path, NULL, 'changed', 0 FROM w WHERE doc_id % 11 = 0 AND size_bytes > 0")
def content_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of files as they were walked; some have grown since and are told to have changed, unread."""
    root = _tree(spark, sf_dir)
    found = scratch.save(tree.files_of(tree.read(spark, root)), "walked")
    grown = _files(spark, sf_dir).where("doc_id % 11 = 0").withColumn("content", F.concat("content", F.lit(b"more")))
    _put(grown, root)
    empty = _files(spark, sf_dir).where("doc_id % 11 = 0 and size_bytes = 0").select("path")
    out = content.digests(found, False, "hash").select(_inside("path", root).alias("path"), "hash", "status", "bytes_read")
    return out.join(empty, "path", "left_anti")


def _one(spark: SparkSession, report: dict, names: str) -> DataFrame:
    columns = [n.split() for n in names.split(", ")]
    return spark.createDataFrame([tuple(report[n] for n, *_ in columns)], ", ".join(f"{alias} {kind}" for _, alias, kind in columns))


_GROUPS = "g AS (SELECT text, size_bytes, count(*) AS n FROM w WHERE size_bytes > 0 GROUP BY 1, 2 HAVING count(*) > 1)"


@query(f"""WITH {_WHOLE}, {_GROUPS} SELECT count(*) AS files_scanned, CAST(sum(size_bytes) AS BIGINT) AS logical_bytes, (SELECT count(*) FROM (SELECT DISTINCT source FROM w)) + (SELECT count(*) FROM (SELECT DISTINCT source, lang FROM w)) AS directories_scanned,
count(*) FILTER (WHERE size_bytes >= 500 AND regexp_matches(path, '(?i)\\.(txt|md)$')) AS total_matches, (SELECT CAST(coalesce(sum((n - 1) * size_bytes), 0) AS BIGINT) FROM g) AS potential_savings_bytes, 0 AS errors, true AS complete, false AS truncated FROM w""")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a scan with exact duplicates."""
    report = commands.scan_path(spark, _tree(spark, sf_dir), r"\.(txt|md)$", 500, hash_budget="unlimited")
    return _one(spark, report, "filesScanned files_scanned long, logicalBytes logical_bytes long, directoriesScanned directories_scanned long, totalMatches total_matches long, potentialSavingsBytes potential_savings_bytes long, errors errors int, duplicateAnalysisComplete complete boolean, truncated truncated boolean")


@query(f"WITH {_WHOLE}, m AS (SELECT path, size_bytes FROM w WHERE size_bytes >= 700 AND regexp_matches(path, '(?i)/EN/.*\\.TXT$') ORDER BY size_bytes DESC, path DESC LIMIT 500) SELECT path, size_bytes, (SELECT count(*) FROM w) AS files_scanned FROM m")
def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree(spark, sf_dir)
    report = commands.search_path(spark, root, r"/EN/.*\.TXT$", 700)
    rows = [(ROOT + m["path"][len(root) :], m["sizeBytes"], report["filesScanned"]) for m in report["matches"]]  # LIMITS.matches at most
    return spark.createDataFrame(rows, "path string, size_bytes long, files_scanned long")


@query(f"""WITH {_WHOLE}, a AS (SELECT * FROM w WHERE doc_id % 2 = 0 AND size_bytes > 0), b AS (SELECT * FROM w WHERE doc_id % 2 = 1 AND size_bytes > 0), m AS (SELECT b.size_bytes FROM b WHERE text IN (SELECT text FROM a))
SELECT (SELECT count(*) FROM a) AS reference_files, (SELECT count(*) FROM b) AS candidate_files, (SELECT count(*) FROM m) AS matched_candidates, CAST(coalesce((SELECT sum(size_bytes) FROM m), 0) AS BIGINT) AS potential_savings_bytes, true AS complete""")
def compare_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even ids as the reference, of odd ids as candidates: two trees that may not overlap."""
    base, files = _folder(spark), _files(spark, sf_dir)
    for side, name in ((0, "reference"), (1, "candidate")):
        os.makedirs(f"{base}/{name}")
        _put(files.where(F.col("doc_id") % 2 == side), f"{base}/{name}")
    report = commands.compare_folders(spark, f"{base}/reference", f"{base}/candidate")
    return _one(spark, report, "referenceFiles reference_files long, candidateFiles candidate_files long, matchedCandidates matched_candidates long, potentialLogicalSavingsBytes potential_savings_bytes long, complete complete boolean")


_STEPS = "step int, index_method string, files long, added long, changed long, unchanged long, removed long, batches long"


@query(f"""WITH {_WHOLE}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 10 = 3) AS x, count(*) FILTER (WHERE doc_id % 10 = 7) AS d, count(*) FILTER (WHERE doc_id % 10 = 5) AS a FROM w)
SELECT 1 AS step, 'walk' AS index_method, n AS files, n AS added, 0 AS changed, 0 AS unchanged, 0 AS removed, ceil(n / 1000000)::BIGINT AS batches FROM c UNION ALL SELECT 2, 'unchanged', n, 0, 0, n, 0, 0 FROM c
UNION ALL SELECT 3, 'walk', n + a - d, a, x, n - x - d, d, ceil((n + a - d) / 1000000)::BIGINT FROM c UNION ALL SELECT 4, 'walk', n + a - d, 0, 0, n + a - d, 0, ceil((n + a - d) / 1000000)::BIGINT FROM c""")
def index_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index is made; the watermark has not moved; files change, come and go; nothing changes but the watermark. The index lies inside the tree and is no part of it."""
    root, files, out = _tree(spark, sf_dir), _files(spark, sf_dir), []

    def step(mark: int) -> None:
        r = commands.refresh_index(spark, f"file://{root}/store", root, watermark={"next": mark})
        out.append((len(out) + 1, r["indexMethod"], r["files"], r["added"], r["changed"], r["unchanged"], r["removed"], r["batchesWritten"]))

    step(1)
    step(1)
    _put(files.where("doc_id % 10 = 3").withColumn("content", F.concat("content", F.lit(b"x"))), root)
    _put(files.where("doc_id % 10 = 5").withColumn("path", F.concat("path", F.lit(".new"))), root)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if os.path.exists(row["path"]):  # a task that runs again finds some gone
                    os.unlink(row["path"])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.where("doc_id % 10 = 7 and path is not null and content is not null").select(F.concat(F.lit(root), F.substr("path", F.lit(len(ROOT) + 1))).alias("path")).mapInArrow(remove, "n long").agg(F.sum("n")).first()
    step(2)
    step(3)
    return spark.createDataFrame(out, _STEPS)


@query(f"""WITH {_WHOLE}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 100 = 3) AS x FROM w) SELECT 1 AS step, 'walk' AS index_method, 0 AS changed, n AS files FROM c UNION ALL SELECT 2, 'unchanged', 0, n FROM c
UNION ALL SELECT 3, 'delta', x, n FROM c UNION ALL SELECT 4, 'walk', x, n FROM c UNION ALL SELECT 5, 'walk', 0, n FROM c""")
def refresh_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest way that holds: a first walk; records that say nothing; sizes of some files; a record of a new file; a journal that was begun anew. Step 4 finds on the disk what the
    delta had said of its files."""
    root, out, i = _tree(spark, sf_dir), [], F.col("doc_id")
    files = _files(spark, sf_dir).where("path is not null and content is not null")
    ids = scratch.save(files.select(i.alias("file_id"), F.concat(F.lit(root), F.substr("path", F.lit(len(ROOT) + 1))).alias("path")), "ids")
    some = files.where(i % 100 == 3).select((1000 + i).alias("usn"), i.alias("file_id"), F.lit(2).cast("long").alias("reason"), (F.col("size_bytes") + 5).alias("size_bytes"))
    n = files.agg(F.max("doc_id")).first()[0]
    quiet = files.where(i % 7 == 1).select((i % 500 + 100).alias("usn"), i.alias("file_id"), F.lit(0x80000000).cast("long").alias("reason"), F.col("size_bytes"))
    new = spark.createDataFrame([(n + 5000, 1, 0x100, 1)], "usn long, file_id long, reason long, size_bytes long")
    records = scratch.save(some.unionByName(quiet).unionByName(new), "records")
    for mark in (journal.Watermark(7, 1, 50, 5, "r"), journal.Watermark(7, 1, 900, 5, "r"), journal.Watermark(7, 1, n + 2000, 5, "r"), journal.Watermark(7, 1, n + 6000, 5, "r"), journal.Watermark(8, 1, n + 7000, 5, "r")):
        r = commands.refresh_from_journal(spark, f"file://{root}-store", root, mark, records, ids)
        out.append((len(out) + 1, r["indexMethod"], r["changed"], r["files"]))
    return spark.createDataFrame(out, "step int, index_method string, changed long, files long")


@query(f"WITH {_WHOLE}, g AS (SELECT text, size_bytes, count(*) AS n FROM w WHERE size_bytes > 0 GROUP BY 1, 2), r AS (SELECT size_bytes FROM (SELECT size_bytes, count(*) AS n FROM w WHERE size_bytes > 0 GROUP BY 1) WHERE n > 1), s AS (SELECT w.size_bytes FROM w JOIN r USING (size_bytes)) SELECT phase, CASE phase WHEN 'scanned' THEN (SELECT count(*) FROM w) ELSE (SELECT CAST(sum(CASE WHEN size_bytes > 32768 THEN 32768 ELSE size_bytes END) AS BIGINT) FROM s) END AS counted FROM (SELECT unnest(['scanned', 'fingerprinted']) AS phase)")
def progress_of_a_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job's listener is told at the ends of the first two phases of a scan."""
    events: list[dict] = []
    registry, root = jobs.Jobs(spark, events.append), _tree(spark, sf_dir)
    with registry.run("progress-of-a-scan") as job:
        commands.scan_path(spark, root, hash_budget="unlimited", job=job)
    rows = [(e["phase"], e["files"] if e["phase"] == "scanned" else e["bytesRead"]) for e in events if e["phase"] in ("scanned", "fingerprinted")]
    return spark.createDataFrame(rows, "phase string, counted long")


@query("SELECT event_id, CASE WHEN value - 100 >= 0 THEN CAST(floor((value - 100) * 1048576) AS BIGINT) END AS least_bytes FROM (SELECT event_id, CAST(value AS DOUBLE) AS value FROM events)")
def sizes_in_megabytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as a person types them, of which those below 0 are refused."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", display.megabytes_column(F.col("value").cast("double") - 100).alias("least_bytes"))


@query(f"WITH {_WHOLE} SELECT 'd' || doc_id AS name, size_bytes FROM w WHERE doc_id % 4 <> 0")
def flat_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of one directory without those of the directories in it, where every fourth document lies."""
    root = _folder(spark)
    name = F.concat(F.lit("/d"), F.col("doc_id").cast("string"))
    _put(_files(spark, sf_dir).where("path is not null").withColumn("path", F.concat(F.lit(ROOT), F.when(F.col("doc_id") % 4 == 0, "/sub").otherwise(""), name)), root)
    return tree.files_of(tree.read(spark, root, depth="1")).select(F.substr("path", F.lit(len(root) + 2)).alias("name"), "size_bytes")


def _published(spark: SparkSession, sf_dir: str, watermark: dict | None = None) -> tuple[store.Store, store.Scope]:
    """All documents as files of one directory."""
    s = store.Store(spark, scratch.folder(spark, f"store-{uuid.uuid4().hex}"))
    files = _files(spark, sf_dir).where("path is not null and size_bytes is not null").select(F.concat(F.lit("/all/d"), F.col("doc_id").cast("string")).alias("path"), F.lit("/all").alias("parent_path"), F.floor(F.col("size_bytes") / 50).cast("long").alias("size_bytes"), "modified_ns", "attributes")
    return s, s.publish("/all", s.stage("/all", files, report.rollup(files, "/all")), watermark)


@query(f"""WITH {_WHOLE}, n AS (SELECT '/all/d' || doc_id AS path, size_bytes // 50 AS size_bytes FROM w), k AS (SELECT *, row_number() OVER (ORDER BY size_bytes DESC, path) - 1 AS place FROM n)
SELECT CAST(place // 60 AS INTEGER) + 1 AS page, path, size_bytes, true AS stale_refused FROM k WHERE place < 180""")
def browsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of 60, each behind the cursor of the one before; a page of another generation is refused."""
    s, scope = _published(spark, sf_dir)
    rows, cursor, refused = [], None, False
    for page in (1, 2, 3):
        got = commands.browse_index_tree(spark, s.base, "/all", "/all", cursor, 60, scope.revision)
        rows += [(page, n["path"], n["sizeBytes"]) for n in got["nodes"]]
        cursor = got["nextCursor"]
        if cursor is None:
            break
    try:
        commands.browse_index_tree(spark, s.base, "/all", "/all", None, 60, scope.revision + 1)
    except ValueError:
        refused = True
    return spark.createDataFrame([(*r, refused) for r in rows], "page int, path string, size_bytes long, stale_refused boolean")


@query(f"WITH {_WHOLE} SELECT 'published' AS step, max(doc_id) AS next, count(*) AS files FROM w UNION ALL SELECT 'delta', max(doc_id) + 7, count(*) FROM w")
def checkpoint_of_a_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal's position, kept and replaced together with the rows that it stands for."""
    n = _files(spark, sf_dir).where("path is not null and size_bytes is not null").agg(F.max("doc_id")).first()[0]
    s, scope = _published(spark, sf_dir, {"next": n})
    out = [("published", s.scope("/all").watermark["next"], s.scope("/all").file_count)]
    some = s.files(scope).where("size_bytes > 0").withColumn("size_bytes", F.col("size_bytes") + 1)
    s.overlay(scope, some, s.directories(scope), {"next": n + 7})
    return spark.createDataFrame([*out, ("delta", s.scope("/all").watermark["next"], s.files(s.scope("/all")).count())], "step string, next long, files long")

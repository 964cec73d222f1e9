"""More registered queries: values for people and ids, predicates over requests, journals and manifests, the snapshot store, and bulk enumeration."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _EXT, _NAME, _RECORDS, _ROLLUP, _STATUS, _files, _records, query
from .functions import display, paths
from .operators import audit, hierarchy, journal, report, search
from .plans import requests, store
from .sources import records, scratch, segments, tree
from .sources.adapter import FILES_SQL, ROOT
from .streaming import journal as stream


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_DIGIT = lambda x: f"CASE WHEN round({x}, 1) = floor(round({x}, 1)) THEN translate(format('{{:,}}', CAST(round({x}, 1) AS BIGINT)), ',', '.') ELSE translate(format('{{:,}}', CAST(floor(round({x}, 1)) AS BIGINT)), ',', '.') || ',' || CAST(CAST(round(round({x}, 1) * 10) AS BIGINT) % 10 AS VARCHAR) END"


@query(f"""WITH s AS (SELECT doc_id, (strlen(text) * (1 + doc_id % 7 * 1000))::BIGINT * CASE WHEN doc_id % 11 = 0 THEN -1 ELSE 1 END AS n, text FROM documents), p AS (SELECT *, CASE WHEN n > 0 THEN least(floor(log2(n) / 10), 5) ELSE 0 END AS k FROM s), v AS (SELECT *, n / pow(1024.0::DOUBLE, k) AS x FROM p)
SELECT doc_id, CASE WHEN n <= 0 THEN '0 B' ELSE {_DIGIT('x')} || ' ' || ['B', 'KB', 'MB', 'GB', 'TB', 'PB'][CAST(k AS INTEGER) + 1] END AS bytes, CASE WHEN n < 0 THEN '-' ELSE '' END || translate(format('{{:,}}', abs(n)), ',', '.') AS number,
left(sha256(text), 16) AS digest, CASE WHEN n > 0 THEN round(n / 1048576.0::DOUBLE / 0.25::DOUBLE, 1) END AS mib_a_second FROM v""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.octet_length("text").cast("long") * (1 + F.col("doc_id") % 7 * 1000)) * F.when(F.col("doc_id") % 11 == 0, -1).otherwise(1)
    d = _docs(spark, sf_dir).select("doc_id", n.alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return d.select("doc_id", display.bytes_text(F.col("n")).alias("bytes"), display.number_text(F.col("n")).alias("number"), display.digest_text(F.col("hash")).alias("digest"), display.throughput(F.col("n"), F.lit(250)).alias("mib_a_second"))


@query("WITH s AS (SELECT event_id, event_id * 37 % 5000000 AS ms FROM events) SELECT event_id, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms % 1000 = 250 THEN ms // 1000 || ',3 s' ELSE replace(format('{:.1f}', ms / 1000.0::DOUBLE), '.', ',') || ' s' END AS duration FROM s")
def display_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", display.duration_text(F.col("event_id") * 37 % 5000000).alias("duration"))


@query("""WITH s AS (SELECT doc_id, ['c:', ' D: ', 'ee:', '7:', '', 'x', 'Z::'][1 + doc_id % 7] AS drive, CASE WHEN doc_id % 5 = 0 THEN 'short' WHEN doc_id % 5 = 1 THEN 'job_' || (100000 + doc_id) ELSE 'job-' || (100000 + doc_id) END AS job, md5(text) AS h FROM documents),
u AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN upper(g) WHEN doc_id % 10 = 1 THEN '{' || g || '}' ELSE g END AS guid FROM (SELECT *, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS g FROM s))
SELECT doc_id, nullif(regexp_extract(upper(trim(drive)), '^([A-Z]):*$', 1), '') AS letter, regexp_full_match(job, '[A-Za-z0-9-]{8,100}') AS job_ok, regexp_full_match(guid, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') AS uuid_ok,
(doc_id % 3) || ':' || doc_id AS identity, lpad(lower(to_hex(doc_id * 1099511627776 + 7)), 16, '0') AS hex, doc_id * 1099511627776 + 7 AS back FROM u""")
def id_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, h = F.col("doc_id"), F.md5(F.col("text").cast("binary"))
    drive = F.element_at(F.array(*map(F.lit, ["c:", " D: ", "ee:", "7:", "", "x", "Z::"])), (i % 7 + 1).cast("int"))
    number = (i + 100000).cast("string")
    job = F.when(i % 5 == 0, "short").when(i % 5 == 1, F.concat(F.lit("job_"), number)).otherwise(F.concat(F.lit("job-"), number))
    g = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    guid = F.when(i % 3 == 0, F.upper(g)).when(i % 10 == 1, F.concat(F.lit("{"), g, F.lit("}"))).otherwise(g)
    wide = i * 1099511627776 + 7
    return _docs(spark, sf_dir).select("doc_id", paths.drive_letter(drive).alias("letter"), paths.valid_job_id(job).alias("job_ok"), paths.valid_uuid(guid).alias("uuid_ok"), paths.identity(i % 3, i).alias("identity"), paths.hex_id(wide).alias("hex"), paths.from_hex_id(paths.hex_id(wide)).alias("back"))


@query(f"WITH {FILES_SQL} SELECT path, modified_ns, CAST(modified_ns // 1000000000 AS BIGINT) AS seconds, size_bytes + doc_id AS moved FROM files")
def modified_and_checked_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modification times in nanoseconds, and sums that would be an error if they left the range of sizes."""
    return _files(spark, sf_dir).select("path", "modified_ns", F.floor(F.col("modified_ns") / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long").alias("seconds"), paths.add_checked(F.col("size_bytes"), F.col("doc_id")).alias("moved"))


_KIND = "CASE doc_id % 9 WHEN 0 THEN 'directory' WHEN 1 THEN 'symlink' WHEN 2 THEN 'other' WHEN 3 THEN 'error' ELSE 'file' END"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 9
    kind = F.when(k == 0, "directory").when(k == 1, "symlink").when(k == 2, "other").when(k == 3, "error").otherwise("file")
    return _files(spark, sf_dir).withColumn("kind", kind).withColumn("hardlink_count", 1 + F.col("doc_id") % 2).withColumn("allocated_bytes", F.col("size_bytes")).withColumn("error", F.when(kind == "error", F.concat("path", F.lit(": denied"))))


@query(f"WITH {FILES_SQL} SELECT path, size_bytes FROM files WHERE {_KIND} = 'file'")
def regular_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.files_of(_entries(spark, sf_dir)).select("path", "size_bytes")


@query(f"WITH {FILES_SQL} SELECT path || ': denied' AS error FROM files WHERE {_KIND} = 'error' ORDER BY 1 LIMIT 12")
def walk_error_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.error_samples(_entries(spark, sf_dir))


@query(f"WITH {FILES_SQL}, s AS (SELECT * FROM files ORDER BY path LIMIT 150) SELECT path, size_bytes, (SELECT count(*) FROM files) > 150 AS truncated FROM s")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    some, cut = search.sample(_files(spark, sf_dir).select("path", "size_bytes"), 150)
    return some.withColumn("truncated", F.lit(cut))


@query(f"WITH {FILES_SQL}, t AS (SELECT {_EXT} AS extension, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) AS files FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30) SELECT * FROM t ORDER BY size_bytes DESC, extension LIMIT 7")
def chart_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.chart(report.top_types(_files(spark, sf_dir)))


@query("SELECT event_id // 3 AS three, count(*) FILTER (WHERE event_type = 'error') = 0 AND max(CASE WHEN value > 100 THEN 1 ELSE 0 END) = 0 AS complete FROM events GROUP BY 1")
def completeness_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analysis is complete if it met no error and skipped nothing."""
    counts = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.floor(F.col("event_id") / 3).alias("three")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.col("value") > 100).alias("skipped"))
    return counts.select("three", report.complete(F.col("errors"), F.col("skipped")).alias("complete"))


@query(f"WITH {_RECORDS} SELECT min(usn) AS first, max(usn) + 1 AS next FROM r")
def journal_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.cursor(_records(spark, sf_dir))


@query("SELECT event_id AS usn, CAST(CASE event_type WHEN 'click' THEN 256 WHEN 'purchase' THEN 4097 ELSE 1048576 END AS BIGINT) AS reason FROM events WHERE event_type IN ('click', 'purchase', 'signup')")
def journal_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    reason = F.when(t == "click", 0x100).when(t == "purchase", 0x1001).when(t == "signup", 0x100000).when(t == "error", 0x8000).otherwise(F.lit(0x80000000))
    return journal.structural(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("usn"), reason.cast("long").alias("reason")))


@query("""SELECT event_id, event_id % 5 <> 0 AND user_id % 4 <> 0 AND event_id % 7 <> 0 AND event_id // 2 <= event_id AND event_id <= event_id + user_id % 3 - 1 AS continues FROM events""")
def journal_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks of which some belong to another journal, volume or root, or lie behind the present end."""
    e, u = F.col("event_id"), F.col("user_id")
    mark = lambda j, first, next_, v, r: F.struct(j.alias("journal"), first.alias("first"), next_.alias("next"), v.alias("volume"), r.alias("root"))
    old = mark(F.lit(7), F.lit(1).cast("long"), e, F.lit(55), F.lit("/a"))
    now = mark(F.when(e % 5 == 0, 8).otherwise(7), F.floor(e / 2), e + u % 3 - 1, F.when(u % 4 == 0, 56).otherwise(55), F.when(e % 7 == 0, "/b").otherwise("/a"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", journal.continues_column(old, now).alias("continues"))


@query(f"""WITH {FILES_SQL}, {_RECORDS}, l AS (SELECT DISTINCT file_id FROM r WHERE reason & 2147483647 <> 0),
ids AS (SELECT doc_id AS file_id, path, 1 + (doc_id % 10 = 3)::INT AS links, attributes FROM files WHERE doc_id % 8 <> 0 UNION ALL SELECT doc_id, path || '.2', 1, attributes FROM files WHERE doc_id % 12 = 5),
k AS (SELECT file_id, count(*) AS names, min(path) AS path, max(links) AS links, max(attributes & 4461568) AS virtual FROM ids GROUP BY 1),
p AS (SELECT l.file_id, path, CASE WHEN names IS NULL THEN 'missing' WHEN names > 1 OR links <> 1 THEN 'names' WHEN virtual <> 0 THEN 'virtual' WHEN NOT starts_with(path, '/corpus/src1/') THEN 'outside' END AS problem FROM l LEFT JOIN k USING (file_id))
SELECT file_id, CASE WHEN problem IS NULL THEN path END AS path, problem FROM p""")
def journal_resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    files = _files(spark, sf_dir)
    ids = files.where(i % 8 != 0).select(i.alias("file_id"), "path", (1 + (i % 10 == 3).cast("int")).alias("hardlink_count"), "attributes")
    ids = ids.unionAll(files.where(i % 12 == 5).select(i, F.concat("path", F.lit(".2")), F.lit(1), "attributes"))
    return journal.resolved(journal.latest(_records(spark, sf_dir)), ids, f"{ROOT}/src1")


_BULK = """b AS (SELECT DISTINCT 's:' || source AS id, 'root' AS parent, source AS name, true AS is_directory, 0::BIGINT AS size_bytes, 16 AS attributes FROM documents
  UNION ALL SELECT 'd:' || doc_id, 's:' || source, 'd' || doc_id, false, strlen(text), CASE WHEN doc_id % 13 = 0 THEN 1024 ELSE 32 END FROM documents)"""


@query(f"WITH {_BULK}, t AS (SELECT id, '/corpus/' || name AS path, 1 AS depth FROM b WHERE parent = 'root'), u AS (SELECT * FROM t UNION ALL SELECT b.id, t.path || '/' || b.name, 2 FROM t JOIN b ON b.parent = t.id) SELECT path, depth, is_directory, size_bytes, attributes FROM u JOIN b USING (id) WHERE attributes <> 1024")
def bulk_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory out of a table of records with parent ids, without links."""
    d, i = _docs(spark, sf_dir), F.col("doc_id").cast("string")
    source = F.concat(F.lit("s:"), "source")
    rows = d.select(source.alias("id"), F.lit("root").alias("parent"), F.col("source").alias("name"), F.lit(True).alias("is_directory"), F.lit(0).cast("long").alias("size_bytes"), F.lit(16).alias("attributes")).distinct()
    rows = rows.unionAll(d.select(F.concat(F.lit("d:"), i), source, F.concat(F.lit("d"), i), F.lit(False), F.octet_length("text").cast("long"), F.when(F.col("doc_id") % 13 == 0, 1024).otherwise(32)))
    return hierarchy.enumerated(scratch.save(rows, "bulk"), "root", ROOT)


@query("""WITH RECURSIVE e AS (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 7 THEN doc_id + 1 WHEN doc_id % 50 = 8 THEN doc_id - 1 WHEN doc_id % 50 = 20 THEN 1000000000 WHEN doc_id % 50 = 0 THEN -1 ELSE doc_id - 1 END AS parent FROM documents),
t(id, path, depth) AS (SELECT -1, '/corpus', 0 UNION ALL SELECT e.id, t.path || '/n' || e.id, t.depth + 1 FROM t JOIN e ON e.parent = t.id),
b(id, verdict) AS (SELECT id, CASE WHEN id % 50 = 20 THEN 'missing' ELSE 'cycle' END FROM e WHERE id % 50 IN (7, 8, 20) UNION SELECT e.id, b.verdict FROM b JOIN e ON e.parent = b.id)
SELECT CAST(e.id AS VARCHAR) AS id, path, depth, coalesce(b.verdict, CASE WHEN path IS NULL THEN 'missing' ELSE 'reached' END) AS verdict FROM e LEFT JOIN t ON t.id = e.id LEFT JOIN b ON b.id = e.id""")
def bulk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of documents, of which some run into a circle of two and some end at a parent that is not there."""
    i = F.col("doc_id")
    parent = F.when(i % 50 == 7, i + 1).when(i % 50 == 20, 1000000000).when(i % 50 == 0, -1).otherwise(i - 1)
    edges = _docs(spark, sf_dir).select(i.cast("string").alias("id"), parent.cast("string").alias("parent"), F.concat(F.lit("n"), i.cast("string")).alias("name"))
    return hierarchy.placed(edges, "-1", ROOT)


@query(f"""WITH {FILES_SQL}, {_ROLLUP}, s AS (SELECT * FROM dirs WHERE path = '/corpus' OR regexp_replace(path, '/[^/]*$', '') IN ('/corpus', '/corpus/src3', '/corpus/src1')), k AS (SELECT a.path, list({{'s': -b.size_bytes, 'p': b.path}} ORDER BY strlen(b.path)) AS key FROM s a JOIN dirs b ON a.path = b.path OR starts_with(a.path, b.path || '/') GROUP BY 1),
f AS (SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS INTEGER) AS position, CAST(len(key) - 1 AS INTEGER) AS depth, path, {_NAME} AS name, size_bytes, files FROM s JOIN k USING (path)) SELECT * FROM f WHERE position BETWEEN 3 AND 22""")
def tree_viewport_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows of a tree of which the root and three directories are expanded, one of these below a closed one."""
    files = _files(spark, sf_dir)
    expanded = spark.createDataFrame([(ROOT,), (f"{ROOT}/src3",), (f"{ROOT}/src1",), (f"{ROOT}/src9/en",)], "path string")
    return hierarchy.flattened(report.rollup(files, ROOT), ROOT, 3, 20, expanded)


@query(f"WITH {FILES_SQL}, {_ROLLUP}, x AS (SELECT path FROM dirs UNION SELECT '/corpus/empty' UNION SELECT '/corpus/src1/empty') SELECT path, CASE WHEN path = '/corpus' THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent_path, coalesce(size_bytes, 0) AS size_bytes, coalesce(files, 0) AS files FROM x LEFT JOIN (SELECT path, size_bytes, files FROM dirs) USING (path)")
def directory_totals_by_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollup over a given list of directories, of which two hold nothing, by running totals."""
    files = _files(spark, sf_dir)
    more = spark.createDataFrame([(f"{ROOT}/empty",), (f"{ROOT}/src1/empty",)], "path string")
    return report.rollup(files, ROOT, report.directories_of(files, ROOT).unionByName(more))


@query(f"WITH {FILES_SQL}, {_ROLLUP} SELECT path, size_bytes, round(greatest(1.0, size_bytes * 100.0 / (SELECT sum(size_bytes) FROM files)), 6) AS bar FROM dirs WHERE path <> '/corpus' ORDER BY size_bytes DESC, path LIMIT 6")
def directory_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    top = report.top_directories(files, ROOT).crossJoin(files.agg(F.sum("size_bytes").alias("logical_bytes")))
    return report.cards(top).select("path", "size_bytes", F.round("bar", 6).alias("bar"))


@query(f"WITH {FILES_SQL} SELECT path || ': denied' AS error FROM files WHERE {_KIND} = 'error' ORDER BY 1 LIMIT 50")
def listed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.listed(_entries(spark, sf_dir).where("error is not null").select("error"), "error")


@query(f"""WITH {FILES_SQL} SELECT path, {_KIND} = 'file' AND (attributes + CASE WHEN doc_id % 17 = 0 THEN 4 ELSE 0 END) & 4461572 = 0 AND doc_id % 2 = 0 AND (NOT starts_with(path, '/corpus/src2/') OR starts_with(path, '/corpus/src2/en/')) AS eligible FROM files""")
def quarantine_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir).withColumn("attributes", F.col("attributes") + F.when(F.col("doc_id") % 17 == 0, 4).otherwise(0))
    return entries.select("path", audit.eligible(entries, [f"{ROOT}/src2"], [f"{ROOT}/src2/en"]).alias("eligible"))


_LOG = "g AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'click' THEN 'prepared' WHEN 'purchase' THEN 'quarantined' WHEN 'signup' THEN 'failed' ELSE 'restored' END AS state FROM events)"


@query(f"WITH {_LOG}, p AS (SELECT *, lag(state) OVER (PARTITION BY id ORDER BY seq) AS previous FROM g) SELECT id, seq, state, previous, coalesce(CASE WHEN previous IS NULL THEN state = 'prepared' WHEN previous = 'prepared' THEN state IN ('quarantined', 'failed') WHEN previous = 'quarantined' THEN state = 'restored' END, false) AS allowed FROM p")
def manifest_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.step_of(_log(spark, sf_dir))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    state = F.when(t == "click", "prepared").when(t == "purchase", "quarantined").when(t == "signup", "failed").otherwise("restored")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), state.alias("state"))


@query(f"WITH {_LOG} SELECT id, max(seq) AS seq, arg_max(state, seq) AS state FROM g GROUP BY 1")
def manifest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.state_of(_log(spark, sf_dir)).select("id", "seq", "state")


@query("""WITH e AS (SELECT user_id AS subject, ts, event_id AS seq, CASE WHEN event_type = 'click' THEN 'use' ELSE 'grant' END AS kind FROM events), b AS (SELECT *, lag(kind) OVER w AS bk, lag(ts) OVER w AS bt FROM e WINDOW w AS (PARTITION BY subject ORDER BY ts, seq))
SELECT subject, seq, coalesce(bk = 'grant' AND epoch_us(ts) - epoch_us(bt) <= 36000000000, false) AS granted FROM b WHERE kind = 'use'""")
def single_use_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants that hold ten hours, as events of one user lie far apart."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("subject"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "use").otherwise("grant").alias("kind"))
    return audit.granted(e, 36_000)


_USE_SQL = """WITH e AS (SELECT user_id AS subject, ts, event_id AS seq, CASE WHEN event_type = 'click' THEN 'use' ELSE 'grant' END AS kind FROM events), b AS (SELECT *, lag(kind) OVER w AS bk, lag(ts) OVER w AS bt FROM e WINDOW w AS (PARTITION BY subject ORDER BY ts, seq))
SELECT CAST(subject AS VARCHAR) AS subject, seq, coalesce(bk = 'grant' AND epoch_us(ts) - epoch_us(bt) <= 36000000000, false) AS granted FROM b WHERE kind = 'use'"""


@query(_USE_SQL)
def grants_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grants as keyed state with a time to live: events arrive in four parts, in order of time, and the stream is started again after each of them."""
    base = scratch.folder(spark, f"grants-{uuid.uuid4().hex}")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("subject"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "use").otherwise("grant").alias("kind"))
    first, last = e.agg(F.unix_micros(F.min("at")), F.unix_micros(F.max("at"))).first()
    part = F.floor((F.unix_micros("at") - first) * 4 / (last - first + 1))
    for i in range(4):
        e.where(part == i).write.mode("append").parquet(f"{base}/in")
        stream.append(stream.grants_of(stream.source(spark, f"{base}/in", 0x7FFFFFFF, e.schema), 36_000), f"{base}/out", f"{base}/state").awaitTermination()  # a part is one batch
    return spark.read.schema(stream.GRANTED).parquet(f"{base}/out/batch=*")


_REASON = "CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 4097 WHEN 'signup' THEN 256 WHEN 'error' THEN 32768 ELSE 2147483648 END"


@query(f"SELECT event_id AS usn, lpad(lower(to_hex(user_id * 4294967311)), 16, '0') AS file_id, lpad(lower(to_hex(event_id % 97)), 16, '0') AS parent_id, CAST({_REASON} AS BIGINT) AS reason, CASE WHEN event_id % 10 = 0 THEN 16 ELSE 32 END::BIGINT AS attributes, event_type || ' é漢😀 ' || event_id AS name FROM events")
def journal_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as binary journal records in segments, followed by usn a bounded number at a time; half of them come while the reader is stopped."""
    base = scratch.folder(spark, f"journal-{uuid.uuid4().hex}")
    i, name = F.col("event_id"), F.concat("event_type", F.lit(" é漢😀 "), F.col("event_id").cast("string"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(i.alias("usn"), (F.col("user_id") * 4294967311).alias("file_id"), (i % 97).alias("parent_id"), F.expr(_REASON).cast("long").alias("reason"), F.when(i % 10 == 0, 16).otherwise(32).cast("long").alias("attributes"), name.alias("name"))
    n, folder = e.count(), scratch.local(base) + "/segments"
    step = max(100, n // 20)
    segments.capture(e.where(F.col("usn") < n // 2 // step * step), folder, step)
    stream.follow(spark, folder, f"{base}/out", f"{base}/state", most=5 * step)
    segments.capture(e.where(F.col("usn") >= n // 2 // step * step), folder, step)
    stream.follow(spark, folder, f"{base}/out", f"{base}/state", most=5 * step)
    return spark.read.schema(records.DECODED).parquet(f"{base}/out/batch=*")


@query(f"WITH {_RECORDS} SELECT file_id, max(usn) AS usn, arg_max(size_bytes, usn) AS size_bytes FROM r WHERE reason & 2147483647 <> 0 GROUP BY 1")
def journal_deltas_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of files out of keyed state, summed up over four batches: they lead to each file's last size."""
    base, r = scratch.folder(spark, f"deltas-{uuid.uuid4().hex}"), _records(spark, sf_dir)
    r.repartition(4, "usn").write.parquet(f"{base}/in")
    stream.append(stream.changes_of(stream.source(spark, f"{base}/in", schema=r.schema)), f"{base}/out", f"{base}/state", "update").awaitTermination()
    told = spark.read.schema(stream.CHANGES).parquet(f"{base}/out/batch=*")
    return told.groupBy("file_id").agg(F.max("usn").alias("usn"), F.sum("delta").alias("size_bytes"))


@query(f"WITH {FILES_SQL}, t AS (SELECT {_NAME} AS name, path, size_bytes, {_EXT} AS extension, {_STATUS} AS content_status FROM files ORDER BY size_bytes DESC, path DESC LIMIT 300) SELECT CAST(json_object('name', name, 'path', path, 'sizeBytes', size_bytes, 'extension', extension, 'contentStatus', content_status) AS VARCHAR) AS value FROM t")
def report_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.as_json(report.top_files(_files(spark, sf_dir)))


_LINE = "CASE doc_id % 6 WHEN 0 THEN '{\"root\":\"/r' || doc_id || '\"}' WHEN 1 THEN '{\"root\":\"/r\",\"hashBudget\":\"deep\",\"analyzeDuplicates\":false}' WHEN 2 THEN '{\"root\":\"/r\",\"hashBudget\":\"endless\"}' WHEN 3 THEN '{\"regex\":\"x\",\"minSizeBytes\":' || doc_id || '}' WHEN 4 THEN '{\"root\":' ELSE '{\"root\":\"/r\",\"maxFiles\":' || doc_id || ',\"regex\":null}' END"


@query("""SELECT doc_id, CASE k WHEN 0 THEN '/r' || doc_id WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE '/r' END AS root, CASE k WHEN 3 THEN 'x' END AS regex, CASE k WHEN 3 THEN doc_id ELSE 0 END AS min_size_bytes, CASE k WHEN 5 THEN doc_id END AS max_files, k <> 1 AS analyze_duplicates,
CASE k WHEN 1 THEN 'deep' WHEN 2 THEN 'endless' ELSE 'standard' END AS hash_budget, CASE k WHEN 4 THEN 'malformed' WHEN 3 THEN 'root' WHEN 2 THEN 'budget' END AS problem FROM (SELECT doc_id, doc_id % 6 AS k FROM documents)""")
def requests_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.expr(_LINE).alias("value"))
    return requests.decoded(lines, keep=["doc_id"])


_PROBE = "CASE doc_id % 5 WHEN 0 THEN '{\"drive\":\"C\",\"healthStatus\":\"Healthy\",\"sizeBytes\":' || doc_id || ',\"temperatureCelsius\":' || (20 + doc_id % 40) || ',\"wearPercent\":null}' WHEN 1 THEN '{\"drive\":\"c\",\"readErrors\":' || doc_id || '}' WHEN 2 THEN '{\"drive\":\"D\",\"sizeBytes\":1}' WHEN 3 THEN '{\"drive\":' ELSE '{}' END"


@query("""SELECT CASE k WHEN 0 THEN 'C' WHEN 1 THEN 'c' WHEN 2 THEN 'D' END AS drive, CASE k WHEN 0 THEN 'Healthy' END AS health_status, CASE k WHEN 0 THEN doc_id WHEN 2 THEN 1 END AS size_bytes, CASE k WHEN 0 THEN CAST(20 + doc_id % 40 AS INTEGER) END AS temperature_celsius, CAST(NULL AS INTEGER) AS wear_percent,
CASE k WHEN 1 THEN doc_id END AS read_errors, CASE k WHEN 2 THEN 'drive' WHEN 3 THEN 'malformed' WHEN 4 THEN 'malformed' END AS problem FROM (SELECT doc_id, doc_id % 5 AS k FROM documents)""")
def device_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe's line for each document: whole ones, such with few fields, of another drive, cut off, and empty ones."""
    h = records.health_rows(_docs(spark, sf_dir).select(F.expr(_PROBE).alias("value")), "c")
    return h.select("drive", F.col("healthStatus").alias("health_status"), F.col("sizeBytes").alias("size_bytes"), F.col("temperatureCelsius").alias("temperature_celsius"), F.col("wearPercent").alias("wear_percent"), F.col("readErrors").alias("read_errors"), "problem")


def _store(spark: SparkSession) -> store.Store:
    return store.Store(spark, scratch.folder(spark, f"store-{uuid.uuid4().hex}"))


def _published(spark: SparkSession, sf_dir: str, s: store.Store, root: str, least: int = 0) -> store.Scope:
    files = _files(spark, sf_dir).where(paths.is_under(F.col("path"), root) & (F.col("size_bytes") >= least)).withColumn("parent_path", paths.parent(F.col("path")))
    return s.publish(root, s.stage(root, files, report.rollup(files, root)))


@query(f"WITH {FILES_SQL} SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent_path, size_bytes, modified_ns, CAST(attributes AS BIGINT) AS attributes FROM files")
def snapshot_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, published and read through the pointer; a second publication replaces the first."""
    s = _store(spark)
    _published(spark, sf_dir, s, ROOT, 1000)
    return s.files(_published(spark, sf_dir, s, ROOT))


@query(f"WITH {FILES_SQL}, up AS (SELECT unnest(list_transform(range(2, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path, size_bytes FROM files) SELECT path, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) AS files FROM up GROUP BY 1")
def snapshot_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark)
    return s.directories(_published(spark, sf_dir, s, ROOT)).select("path", "size_bytes", "files")


@query(f"WITH {FILES_SQL} SELECT path, size_bytes + CASE WHEN doc_id % 50 = 0 THEN 11 ELSE 0 END AS size_bytes FROM files")
def snapshot_after_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sizes of some files laid over a published generation in place of them."""
    s = _store(spark)
    scope = _published(spark, sf_dir, s, ROOT)
    some = _files(spark, sf_dir).where("doc_id % 50 = 0").withColumn("parent_path", paths.parent(F.col("path"))).withColumn("size_bytes", F.col("size_bytes") + 11)
    deltas = some.select("path", F.lit(11).cast("long").alias("delta"))
    dirs = s.directories(scope)
    touched = journal.apply(dirs.join(journal.directory_deltas(deltas, ROOT).select("path"), "path", "left_semi"), deltas, ROOT)
    return s.files(s.overlay(scope, some, touched)).select("path", "size_bytes")


@query(f"""WITH {FILES_SQL} SELECT path, size_bytes + CASE WHEN doc_id % 30 = 0 THEN 5 WHEN doc_id % 50 = 0 THEN 11 ELSE 0 END AS size_bytes FROM files""")
def snapshot_after_a_refused_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delta is published, one that began before it is refused, and a third follows the first: files of the refused one keep what they had."""
    s = _store(spark)
    scope = _published(spark, sf_dir, s, ROOT)
    files = _files(spark, sf_dir).withColumn("parent_path", paths.parent(F.col("path")))
    some = lambda every, more: (files.where(F.col("doc_id") % every == 0).withColumn("size_bytes", F.col("size_bytes") + more), s.directories(scope).limit(0))
    second = s.overlay(scope, *some(50, 11))
    try:
        s.overlay(scope, *some(20, 999))
    except ValueError:
        s.overlay(second, *some(30, 5))
    return s.files(s.scope(ROOT)).select("path", "size_bytes")


@query(f"WITH {FILES_SQL} SELECT '/by/' || lang AS root, count(*) AS files, true AS has_tree, 1 AS revision FROM files WHERE lang IS NOT NULL GROUP BY 1")
def published_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files, in a scope for each language."""
    s = _store(spark)
    files = scratch.save(_files(spark, sf_dir).where("lang is not null").withColumn("path", F.concat(F.lit("/by/"), "lang", "path")).withColumn("parent_path", paths.parent(F.col("path"))), "files")
    for (lang,) in files.select(F.split("path", "/")[2]).distinct().collect():
        root = f"/by/{lang}"
        mine = files.where(paths.is_under(F.col("path"), root))
        s.publish(root, s.stage(root, mine, report.rollup(mine, root)))
    found = [(x.root, x.file_count, x.has_tree, x.revision) for x in s.scopes()]
    return spark.createDataFrame(found, "root string, files long, has_tree boolean, revision int")


@query(f"WITH {FILES_SQL} SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent_path, size_bytes + CASE WHEN doc_id % 40 = 0 THEN 3 ELSE 0 END AS size_bytes, modified_ns, CASE WHEN doc_id % 40 = 0 THEN CAST(attributes AS BIGINT) ELSE 32 END AS attributes FROM files")
def snapshot_of_older_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that an earlier version wrote without parent paths and attributes, behind a pointer file, read through the store, and with a delta over them."""
    s, files = _store(spark), _files(spark, sf_dir)
    files.select("path", "size_bytes", "modified_ns").write.parquet(s._at(ROOT, "files", "generation=1"))
    s._fs.mkdirs(s._path(f"{s.base}/scopes"))
    s._create(f"{s.base}/scopes/{s._key(ROOT)}.json", json.dumps({"root": ROOT, "generation": 1, "completed_at_unix": 1, "file_count": files.count()}))
    old = s.scope(ROOT)
    some = files.where("doc_id % 40 = 0").withColumn("parent_path", paths.parent(F.col("path"))).withColumn("size_bytes", F.col("size_bytes") + 3)
    return s.files(s.overlay(old, some, report.rollup(s.files(old), ROOT)))


@query("WITH f AS (SELECT '/all/' || doc_id AS path, strlen(text) // 7 AS size_bytes FROM documents) SELECT path, size_bytes FROM f WHERE size_bytes < 300 OR size_bytes = 300 AND path > '/all/3' ORDER BY size_bytes DESC, path LIMIT 201")
def stored_page_of_one_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of one published directory; a page behind a cursor reads the rows between marks only."""
    s, i = _store(spark), F.col("doc_id").cast("string")
    files = _docs(spark, sf_dir).where("text is not null").select(F.concat(F.lit("/all/"), i).alias("path"), F.lit("/all").alias("parent_path"), F.floor(F.octet_length("text") / 7).cast("long").alias("size_bytes"), F.col("doc_id").alias("modified_ns"), F.lit(32).cast("long").alias("attributes"))
    scope = s.publish("/all", s.stage("/all", files, report.rollup(files, "/all")))
    return s.children(scope, "files", "/all", (300, "/all/3"), 201).select("path", "size_bytes")

"""All registered queries of the library, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import LIMITS
from .functions import display, paths
from .operators import audit, budget, compare, duplicates, hierarchy, journal, report, search, snapshot
from .sources import adapter, scratch
from .sources.adapter import FILES_SQL, PAGES_SQL, ROOT, URLS

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Extension, name and status of a file in DuckDB.
_EXT = "coalesce(nullif(translate(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), 'sem extensão')"
_NAME = "regexp_extract(path, '[^/]*$')"
_STATUS = "CASE WHEN attributes & 4460544 <> 0 THEN 'offline' WHEN attributes & 1024 <> 0 THEN 'reparse' ELSE 'local' END"
_READABLE = "size_bytes > 0 AND attributes & 4461568 = 0"
_BUDGET = 600_000
PATTERN, MIN_SIZE = r"/src1\d?/.*\.(txt|md)$", 500


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_files = adapter.documents

# The ancestors of a path within a root of one component, in DuckDB.
_UP = "unnest(list_transform(range(2, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')))"
_ROLLUP = f"""up AS (SELECT {_UP} AS dir, size_bytes FROM files), dirs AS (SELECT dir AS path, CASE WHEN dir = '/corpus' THEN '' ELSE regexp_replace(dir, '/[^/]*$', '') END AS parent_path,
  CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) AS files FROM up GROUP BY 1)"""


@query(f"WITH {FILES_SQL}, {_ROLLUP} SELECT (SELECT count(*) FROM files) AS files_scanned, (SELECT count(*) FROM dirs WHERE path <> '/corpus') AS directories_scanned, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM files) AS logical_bytes")
def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(_files(spark, sf_dir), ROOT)


@query(f"WITH {FILES_SQL} SELECT {_STATUS} AS content_status, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM files GROUP BY 1")
def content_status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_status(_files(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT {_EXT} AS extension, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) AS files FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def types_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_types(_files(spark, sf_dir))


@query(f"""WITH {FILES_SQL}, t AS (SELECT {_EXT} AS extension, CAST(sum(size_bytes) AS BIGINT) AS n FROM files GROUP BY 1), w AS (SELECT CAST(sum(n) AS BIGINT) AS whole, max(n) AS largest FROM t)
SELECT extension, round(CASE WHEN whole = 0 THEN 0 ELSE n * 100.0::DOUBLE / whole END, 6) AS share, round(greatest(3.0::DOUBLE, n * 100.0::DOUBLE / greatest(largest, 1)), 6) AS bar FROM t, w""")
def type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.type_shares(_files(spark, sf_dir))


@query(f"WITH {FILES_SQL}, {_ROLLUP} SELECT * FROM dirs")
def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rollup(_files(spark, sf_dir), ROOT)


@query(f"WITH {FILES_SQL}, {_ROLLUP} SELECT {_NAME} AS name, path, size_bytes, files FROM dirs WHERE path <> '/corpus' ORDER BY size_bytes DESC, path LIMIT 300")
def top_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_directories(_files(spark, sf_dir), ROOT)


@query(f"WITH {FILES_SQL} SELECT {_NAME} AS name, path, size_bytes, {_EXT} AS extension, {_STATUS} AS content_status FROM files ORDER BY size_bytes DESC, path DESC LIMIT 300")
def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_files(_files(spark, sf_dir))


_FOUND = f"found AS (SELECT * FROM files WHERE size_bytes >= {MIN_SIZE} AND regexp_matches(path, '(?i){PATTERN}'))"


@query(f"WITH {FILES_SQL}, {_FOUND} SELECT {_NAME} AS name, path, size_bytes, {_EXT} AS extension, {_STATUS} AS content_status, (SELECT count(*) FROM found) AS total_matches FROM found ORDER BY size_bytes DESC, path DESC LIMIT 500")
def search_regex_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_files(spark, sf_dir), PATTERN, MIN_SIZE)


@query(f"WITH {FILES_SQL}, {_FOUND} SELECT (SELECT count(*) FROM files) AS files_scanned, (SELECT count(*) FROM found) AS total_matches")
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.counts(_files(spark, sf_dir), PATTERN, MIN_SIZE)


@query(f"WITH {FILES_SQL}, {_FOUND} SELECT (SELECT count(*) FROM files WHERE size_bytes >= {MIN_SIZE}) AS files_scanned, (SELECT count(*) FROM found) AS total_matches")
def search_indexed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.counts(_files(spark, sf_dir), PATTERN, MIN_SIZE, indexed=True)


_DIGESTS = f"""d AS (SELECT path, size_bytes, identity, sha256(text) AS hash,
  CASE WHEN size_bytes > 32768 THEN sha256(concat(hex(encode(text))[1:32768], hex(encode(text))[-32768:])) ELSE sha256(hex(encode(text))) END AS fingerprint FROM files
  WHERE {_READABLE} AND size_bytes IN (SELECT size_bytes FROM files WHERE size_bytes > 0 GROUP BY 1 HAVING count(*) > 1))"""
_GROUPS = "g AS (SELECT size_bytes, hash, count(*) AS members, count(DISTINCT identity) AS independent FROM d GROUP BY 1, 2 HAVING count(*) > 1)"
_FIRST = "f AS (SELECT size_bytes, hash, identity, min(path) AS path FROM d GROUP BY 1, 2, 3)"


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.staged(_files(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT size_bytes, count(*) AS n FROM files WHERE size_bytes > 0 GROUP BY 1 HAVING count(*) > 1")
def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.size_buckets(_files(spark, sf_dir))


@query(f"WITH {FILES_SQL}, {_DIGESTS}, x AS (SELECT size_bytes, count(*) AS n FROM d GROUP BY size_bytes, fingerprint HAVING count(*) > 1) SELECT size_bytes, n, count(*) AS groups FROM x GROUP BY 1, 2")
def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.fingerprint_groups(_digests(spark, sf_dir)).groupBy("size_bytes", "n").agg(F.count("*").alias("groups"))


@query(f"""WITH {FILES_SQL}, {_DIGESTS}, {_GROUPS}, {_FIRST} SELECT hash, size_bytes, string_agg(path, '|' ORDER BY path) AS copies, CAST(size_bytes * (count(*) - 1) AS BIGINT) AS potential_savings_bytes
FROM f JOIN g USING (size_bytes, hash) WHERE members <= 1024 AND independent > 1 GROUP BY hash, size_bytes ORDER BY 4 DESC, 2, 1 LIMIT 300""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.top_groups(_digests(spark, sf_dir)).withColumn("copies", F.array_join("copies", "|"))


@query(f"""WITH {FILES_SQL}, {_DIGESTS}, {_GROUPS} SELECT count(*) FILTER (WHERE members <= 1024 AND independent > 1) AS groups,
CAST(coalesce(sum(size_bytes * (independent - 1)) FILTER (WHERE members <= 1024 AND independent > 1), 0) AS BIGINT) AS potential_savings_bytes,
CAST(coalesce(sum(members - independent) FILTER (WHERE members <= 1024), 0) AS BIGINT) AS hardlink_aliases, count(*) FILTER (WHERE members > 1024) AS oversize_groups FROM g""")
def duplicate_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.summary(_digests(spark, sf_dir))


@query(f"WITH {FILES_SQL}, {_DIGESTS}, {_GROUPS} SELECT size_bytes, hash, members, independent, members - independent AS aliases FROM g WHERE members > independent")
def hardlink_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.hash_groups(_digests(spark, sf_dir)).where("aliases > 0")


@query(f"""WITH {FILES_SQL}, {_DIGESTS}, a AS (SELECT CAST(coalesce(sum(least(size_bytes, 32768)), 0) AS BIGINT) AS fingerprint_bytes_read FROM d),
b AS (SELECT CAST(coalesce(sum(size_bytes * n), 0) AS BIGINT) AS full_hash_bytes_read FROM (SELECT size_bytes, count(*) AS n FROM d GROUP BY size_bytes, fingerprint HAVING count(*) > 1))
SELECT *, fingerprint_bytes_read + full_hash_bytes_read AS hash_bytes_read FROM a, b""")
def duplicate_stage_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return duplicates.stage_bytes(files, _digests(spark, sf_dir))


_SIZES = f"s AS (SELECT size_bytes, count(*) AS n, row_number() OVER (ORDER BY size_bytes DESC) AS k FROM files WHERE {_READABLE} GROUP BY 1)"


@query(f"""WITH RECURSIVE {FILES_SQL}, {_SIZES}, walk(k, rest, size_bytes, admitted) AS (SELECT 0::BIGINT, {_BUDGET}::BIGINT, 0::BIGINT, 0::BIGINT
  UNION ALL SELECT s.k, rest - least(s.n, rest // s.size_bytes) * s.size_bytes, s.size_bytes, least(s.n, rest // s.size_bytes) FROM walk w JOIN s ON s.k = w.k + 1),
r AS (SELECT path, size_bytes, row_number() OVER (PARTITION BY size_bytes ORDER BY path) AS i FROM files WHERE {_READABLE})
SELECT r.path, r.size_bytes FROM r JOIN walk w ON r.size_bytes = w.size_bytes AND w.k > 0 AND r.i <= w.admitted""")
def budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).where((F.col("size_bytes") > 0) & ~paths.avoids_content(F.col("attributes"))).select("path", "size_bytes")
    return duplicates.within_budget(files, _BUDGET, F.col("size_bytes")).where("admitted").select("path", "size_bytes")


@query(f"""WITH {FILES_SQL}, r AS (SELECT path, size_bytes, sum(size_bytes) OVER (ORDER BY size_bytes, path ROWS UNBOUNDED PRECEDING) AS running FROM files WHERE {_READABLE})
SELECT path, size_bytes FROM r WHERE running <= {_BUDGET}""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).where((F.col("size_bytes") > 0) & ~paths.avoids_content(F.col("attributes"))).select("path", "size_bytes")
    counts = budget.prefix(files.groupBy("size_bytes").agg(F.count("*").alias("n")), _BUDGET)
    return budget.admit(files, counts).where("admitted").select("path", "size_bytes")


# Two trees: sources 0 to 6 are the reference, all others the candidates; together they are the whole table.
_REFERENCE = ("src0", "src1", "src2", "src3", "src4", "src5", "src6")
_IN = "source IN ('" + "', '".join(_REFERENCE) + "')"
_CLASSED = f"""ref AS (SELECT path, size_bytes, identity, sha256(text) AS hash FROM files WHERE size_bytes > 0 AND {_IN}), cand AS (SELECT path, size_bytes, identity, sha256(text) AS hash FROM files WHERE size_bytes > 0 AND NOT {_IN}),
firsts AS (SELECT size_bytes, hash, arg_min(path, string_split(path, '/')) AS reference_path FROM ref GROUP BY 1, 2),
c AS (SELECT cand.path AS candidate_path, size_bytes, hash, reference_path,
  CASE WHEN EXISTS (SELECT 1 FROM ref r WHERE r.size_bytes = cand.size_bytes AND r.hash = cand.hash AND r.identity = cand.identity)
    OR row_number() OVER (PARTITION BY size_bytes, hash, identity ORDER BY string_split(path, '/')) > 1 THEN 'alias' ELSE 'match' END AS outcome
  FROM cand JOIN firsts USING (size_bytes, hash))"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scratch.save(_files(spark, sf_dir).where("size_bytes > 0").select("path", "size_bytes", "identity", "source", F.sha2("content", 256).alias("hash")), "digests")
    inside = F.col("source").isin(*_REFERENCE)
    return compare.classified(f.where(inside).drop("source"), f.where(~inside).drop("source"))


@query(f"WITH {FILES_SQL}, {_CLASSED} SELECT candidate_path, reference_path, size_bytes, hash FROM c WHERE outcome = 'match' ORDER BY size_bytes DESC, candidate_path DESC LIMIT 300")
def compare_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.top_matches(_classified(spark, sf_dir))


@query(f"WITH {FILES_SQL}, {_CLASSED} SELECT count(*) FILTER (WHERE outcome = 'match') AS matched_candidates, count(*) FILTER (WHERE outcome = 'alias') AS hardlink_aliases, CAST(coalesce(sum(size_bytes) FILTER (WHERE outcome = 'match'), 0) AS BIGINT) AS potential_logical_savings_bytes FROM c")
def compare_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.totals(_classified(spark, sf_dir))


# Two snapshots: all documents; then all but those labelled toxic, larger where labelled of low quality, with all pages added.
_SNAPSHOTS = f"""{FILES_SQL}, {PAGES_SQL}, old AS (SELECT path, size_bytes, modified_ns, attributes FROM files),
new AS (SELECT path, size_bytes + CASE WHEN quality = 0 THEN 7 ELSE 0 END AS size_bytes, modified_ns, attributes FROM files LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0
  UNION ALL SELECT path, size_bytes, modified_ns, attributes FROM page_files),
ch AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
  WHEN o.size_bytes = n.size_bytes AND o.modified_ns = n.modified_ns AND o.attributes = n.attributes THEN 'unchanged' ELSE 'changed' END AS change FROM old o FULL JOIN new n ON o.path = n.path)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = ["path", "size_bytes", "modified_ns", "attributes"]
    old = _files(spark, sf_dir)
    labelled = old.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    new = labelled.withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("quality") == 0, 7).otherwise(0)).select(facts).unionAll(adapter.pages(spark, sf_dir).select(facts))
    return snapshot.changes(old.select(facts), new)


@query(f"WITH {_SNAPSHOTS} SELECT count(*) FILTER (WHERE change <> 'removed') AS files, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) FILTER (WHERE change = 'removed') AS removed FROM ch")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.change_counts(_changes(spark, sf_dir))


@query(f"WITH {_SNAPSHOTS} SELECT path, change FROM ch WHERE change <> 'unchanged'")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).where("change != 'unchanged'")


@query(f"WITH {_SNAPSHOTS} SELECT path FROM ch WHERE change = 'removed'")
def snapshot_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).where("change = 'removed'").select("path")


_NODES = f"""{FILES_SQL}, {_ROLLUP}, nodes AS (SELECT 0 AS kind_rank, 'directory' AS kind, path, {_NAME} AS name, size_bytes, files, 'local' AS content_status FROM dirs
  UNION ALL SELECT 1, 'file', path, {_NAME}, size_bytes, 1, {_STATUS} FROM files)"""


def _nodes(spark: SparkSession, sf_dir: str, parent: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return snapshot.children(files.withColumn("parent_path", paths.parent(F.col("path"))), report.rollup(files, ROOT), parent)


@query(f"WITH {_NODES} SELECT * FROM nodes WHERE regexp_replace(path, '/[^/]*$', '') = '/corpus' ORDER BY kind_rank, size_bytes DESC, path LIMIT 101")
def tree_page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.page(_nodes(spark, sf_dir, ROOT))


@query(f"WITH {_NODES} SELECT * FROM nodes WHERE regexp_replace(path, '/[^/]*$', '') = '/corpus/src0/en' AND (kind_rank > 1 OR kind_rank = 1 AND (size_bytes < 2000 OR size_bytes = 2000 AND path > '/corpus/src0/en/d1')) ORDER BY kind_rank, size_bytes DESC, path LIMIT 101")
def tree_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.page(_nodes(spark, sf_dir, f"{ROOT}/src0/en"), after=("file", 2000, f"{ROOT}/src0/en/d1"))


# The journal: every event changes the file of its user; the table says how many files there are.
_RECORDS = """r AS (SELECT event_id AS usn, user_id % (SELECT count(*) FROM documents) AS file_id, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 4 WHEN 'error' THEN 32768 ELSE 2147483648 END AS reason,
  CAST(floor(value) AS BIGINT) AS size_bytes FROM events)"""
_LAST = "l AS (SELECT file_id, max(usn) AS usn, arg_max(reason, usn) AS reason, arg_max(size_bytes, usn) AS size_bytes FROM r WHERE reason & 2147483647 <> 0 GROUP BY 1)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count("*").alias("__n"))
    t = F.col("event_type")
    reason = F.when(t == "click", 1).when(t == "purchase", 2).when(t == "signup", 4).when(t == "error", 32768).otherwise(F.lit(2147483648))
    return spark.read.parquet(f"{sf_dir}/events.parquet").join(F.broadcast(n)).select(F.col("event_id").alias("usn"), (F.col("user_id") % F.col("__n")).alias("file_id"), reason.cast("long").alias("reason"), F.floor("value").cast("long").alias("size_bytes"))


@query(f"WITH {_RECORDS} SELECT reason, count(*) AS records, count(DISTINCT file_id) AS files FROM r WHERE reason & 2147483647 <> 0 GROUP BY 1")
def journal_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.relevant(_records(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("records"), F.count_distinct("file_id").alias("files"))


@query(f"WITH {_RECORDS}, {_LAST} SELECT * FROM l")
def journal_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.latest(_records(spark, sf_dir))


@query(f"WITH {FILES_SQL}, {_RECORDS}, {_LAST}, c AS (SELECT path, l.size_bytes - f.size_bytes AS delta FROM files f JOIN l ON l.file_id = f.doc_id), u AS (SELECT {_UP} AS path, delta FROM c) SELECT path, CAST(sum(delta) AS BIGINT) AS delta FROM u GROUP BY 1")
def journal_delta_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "path", "size_bytes")
    return journal.directory_deltas(journal.deltas(journal.latest(_records(spark, sf_dir)), files), ROOT)


@query(f"WITH {_RECORDS}, {_LAST} SELECT * FROM l")
def journal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as journal_latest, from a stream of micro-batches."""
    from .streaming import journal as stream

    return stream.latest_by_stream(_records(spark, sf_dir))


_VIRTUAL = f"""dirs AS (SELECT DISTINCT '/corpus/' || source || '/' || lang AS path FROM files), v AS (SELECT path FROM dirs WHERE path LIKE '/corpus/src1_/de' OR path = '/corpus/src3/en')"""


@query(f"WITH {FILES_SQL}, {_VIRTUAL} SELECT path, size_bytes FROM files WHERE regexp_replace(path, '/[^/]*$', '') NOT IN (SELECT path FROM v)")
def virtual_ancestor_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("path", "size_bytes")
    dirs = report.directories_of(files, ROOT)
    offline = F.col("path").rlike("^/corpus/src1./de$") | (F.col("path") == f"{ROOT}/src3/en")
    kept, _ = hierarchy.without_virtual(files, dirs.withColumn("attributes", F.when(offline, 4096).otherwise(16)), ROOT)
    return kept


_EDGES = """edges AS (SELECT DISTINCT 's:' || source AS id, 'root' AS parent, source AS name FROM documents UNION ALL SELECT DISTINCT 'l:' || source || ':' || lang, 's:' || source, lang FROM documents
  UNION ALL SELECT 'd:' || doc_id, 'l:' || source || ':' || lang, 'd' || doc_id FROM documents)"""


@query(f"WITH RECURSIVE {_EDGES}, t(id, path, depth) AS (SELECT 'root', '/corpus', 0 UNION ALL SELECT e.id, t.path || '/' || e.name, t.depth + 1 FROM t JOIN edges e ON e.parent = t.id) SELECT * FROM t")
def tree_paths_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("d"), F.col("source").alias("s"), F.col("lang").alias("l"))
    folder = F.concat(F.lit("l:"), "s", F.lit(":"), "l")
    edges = d.select(F.concat(F.lit("s:"), "s").alias("id"), F.lit("root").alias("parent"), F.col("s").alias("name")).distinct()
    edges = edges.unionAll(d.select(folder, F.concat(F.lit("s:"), "s"), "l").distinct()).unionAll(d.select(F.concat(F.lit("d:"), "d"), folder, F.concat(F.lit("d"), "d")))
    return hierarchy.resolved_paths(edges, "root", ROOT)


@query(f"""WITH {FILES_SQL}, {_ROLLUP}, k AS (SELECT a.path, list({{'s': -b.size_bytes, 'p': b.path}} ORDER BY strlen(b.path)) AS key FROM dirs a JOIN dirs b ON a.path = b.path OR starts_with(a.path, b.path || '/') GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS INTEGER) AS position, CAST(len(key) - 1 AS INTEGER) AS depth, path, {_NAME} AS name, size_bytes, files FROM dirs JOIN k USING (path)""")
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.flattened(report.rollup(_files(spark, sf_dir), ROOT), ROOT)


# The manifest: all labelled documents; toxic ones are no longer there. The listing: all documents, a byte longer where labelled of low quality.
_MANIFEST = """m AS (SELECT CASE WHEN toxic = 1 THEN 'gone-' ELSE '' END || doc_id AS id, '/corpus/d' || doc_id AS original_path, strlen(text) AS expected,
  CASE (doc_id // 4) % 4 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'prepared' WHEN 2 THEN 'restored' ELSE 'failed' END AS state, doc_id FROM labels JOIN documents USING (doc_id)),
li AS (SELECT CAST(doc_id AS VARCHAR) AS id, strlen(text) + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS found FROM documents LEFT JOIN labels USING (doc_id)),
i AS (SELECT coalesce(m.id, li.id) AS id, original_path, CASE WHEN m.id IS NULL THEN 'orphan' WHEN state = 'prepared' THEN 'pending' WHEN state = 'quarantined' AND li.id IS NULL THEN 'missing'
  WHEN state = 'quarantined' AND found <> expected THEN 'changed' WHEN state IN ('restored', 'failed') AND li.id IS NOT NULL THEN 'unexpected' END AS kind FROM m FULL JOIN li ON m.id = li.id)"""


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    i, text = F.col("doc_id"), F.col("doc_id").cast("string")
    k = F.floor(i / 4) % 4
    state = F.when(k == 0, "quarantined").when(k == 1, "prepared").when(k == 2, "restored").otherwise("failed")
    m = labels.join(docs, "doc_id").select(F.when(F.col("toxic") == 1, F.concat(F.lit("gone-"), text)).otherwise(text).alias("id"), F.concat(F.lit("/corpus/d"), text).alias("original_path"), F.col("n").alias("size_bytes"), state.alias("state"), i.alias("created_at_unix"))
    listing = docs.join(labels, "doc_id", "left").select(text.alias("name"), (F.col("n") + F.when(F.col("quality") == 0, 1).otherwise(0)).alias("size_bytes"), F.lit(True).alias("is_regular"))
    return m, listing


@query(f"WITH {_MANIFEST} SELECT id, original_path, kind FROM i WHERE kind IS NOT NULL")
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.issues(*_manifest(spark, sf_dir), check_ids=False)


@query(f"WITH {_MANIFEST} SELECT count(*) FILTER (WHERE kind = 'missing') AS missing_files, count(*) FILTER (WHERE kind = 'orphan') AS orphan_files, count(*) FILTER (WHERE kind = 'pending') AS pending_entries, count(*) FILTER (WHERE kind = 'unexpected') AS unexpected_files, count(*) FILTER (WHERE kind = 'changed') AS changed_files FROM i")
def audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.counters(audit.issues(*_manifest(spark, sf_dir), check_ids=False))


@query(f"WITH {_MANIFEST}, q AS (SELECT * FROM m WHERE state IN ('prepared', 'quarantined') ORDER BY doc_id DESC, id LIMIT 500) SELECT id, original_path, state FROM q WHERE id IN (SELECT id FROM li)")
def quarantine_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, listing = _manifest(spark, sf_dir)
    return audit.quarantined(m, listing, check_ids=False).select("id", "original_path", "state")


_TARGETS = f"""{FILES_SQL}, t AS (SELECT CASE WHEN toxic = 1 THEN '/elsewhere' ELSE '' END || path AS path, path AS real, size_bytes + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS expected FROM files LEFT JOIN labels USING (doc_id)),
n AS (SELECT path, size_bytes, attributes, (size_bytes + 4095) // 4096 * 4096 AS allocated, count(*) OVER (PARTITION BY identity) AS links FROM files),
a AS (SELECT t.path, expected AS logical_bytes, allocated, links, CASE WHEN n.path IS NULL THEN 'unavailable' WHEN attributes & 4461568 <> 0 THEN 'excluded' WHEN size_bytes <> expected THEN 'changed' ELSE 'measured' END AS status FROM t LEFT JOIN n ON n.path = t.path)"""


def _allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("path", "size_bytes", "attributes", "identity", "doc_id")
    links = files.groupBy("identity").agg(F.count("*").alias("hardlink_count"))
    known = files.join(links, "identity").select("path", "size_bytes", "attributes", (F.floor((F.col("size_bytes") + 4095) / 4096) * 4096).alias("allocated_bytes"), "hardlink_count", F.lit(True).alias("is_regular"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    targets = files.join(labels, "doc_id", "left").select(F.when(F.col("toxic") == 1, F.concat(F.lit("/elsewhere"), "path")).otherwise(F.col("path")).alias("path"), (F.col("size_bytes") + F.when(F.col("quality") == 0, 1).otherwise(0)).alias("expected_size_bytes"))
    return audit.allocation(targets, known, ROOT)


@query(f"WITH {_TARGETS} SELECT path, logical_bytes, CASE WHEN status = 'measured' THEN allocated END AS allocated_bytes, CASE WHEN status = 'measured' THEN links END AS hardlink_count, status FROM a")
def allocation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allocation(spark, sf_dir)


@query(f"WITH {_TARGETS} SELECT count(*) FILTER (WHERE status = 'measured') AS measured, count(*) FILTER (WHERE status IN ('excluded', 'changed')) AS skipped, count(*) FILTER (WHERE status = 'unavailable') AS failed FROM a")
def allocation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.allocation_counters(_allocation(spark, sf_dir))


@query(f"WITH {_TARGETS}, tf AS (SELECT path FROM files ORDER BY size_bytes DESC, path DESC LIMIT 300) SELECT tf.path, a.status, CASE WHEN status = 'measured' THEN allocated END AS allocated_bytes FROM tf LEFT JOIN a ON a.path = tf.path")
def top_files_allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_files(_files(spark, sf_dir)).select("path").join(_allocation(spark, sf_dir), "path", "left").select("path", "status", "allocated_bytes")


@query(f"""WITH {PAGES_SQL}, up AS (SELECT {_UP} AS path, size_bytes FROM page_files) SELECT path, CASE WHEN path = '/web' THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent_path,
CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) AS files FROM up GROUP BY 1""")
def url_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rollup(adapter.pages(spark, sf_dir), URLS)


@query(f"""WITH {FILES_SQL}, p AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent_path, doc_id, size_bytes FROM files)
SELECT path, parent_path, {_NAME} AS name, {_EXT} AS extension, lpad(lower(to_hex(doc_id)), 16, '0') AS hex_id, CASE WHEN length(path) > 16 THEN '…' || right(path, 15) ELSE path END AS short,
least(size_bytes, 32768) AS edge_bytes FROM p""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _files(spark, sf_dir).select("path", paths.parent(p).alias("parent_path"), paths.name(p).alias("name"), paths.extension(p).alias("extension"), paths.hex_id(F.col("doc_id")).alias("hex_id"), display.path_text(p, 16).alias("short"), paths.edge_bytes(F.col("size_bytes")).alias("edge_bytes"))


@query(f"WITH {FILES_SQL}, t AS (SELECT *, {_STATUS} AS content_status FROM files ORDER BY size_bytes DESC, path DESC LIMIT 300) SELECT path, size_bytes FROM t WHERE content_status = 'local'")
def top_files_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status filter works on the ranking's rows: it does not move below the limit."""
    return report.top_files(_files(spark, sf_dir)).where("content_status = 'local'").select("path", "size_bytes")


@query(f"WITH {_TARGETS} SELECT path, links AS hardlink_count FROM a WHERE status = 'measured' AND links > 1")
def shared_hard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allocation(spark, sf_dir).where("hardlink_count > 1").select("path", "hardlink_count")


@query(f"""WITH {FILES_SQL} SELECT count(*) FILTER (WHERE {_READABLE.replace('AND attributes & 4461568 = 0', '')} AND attributes & 4461568 <> 0 AND n > 1) AS skipped_content_files,
count(*) FILTER (WHERE size_bytes > 0 AND attributes & 4461568 <> 0 AND n > 1) = 0 AS complete FROM (SELECT *, count(*) OVER (PARTITION BY size_bytes) AS n FROM files)""")
def duplicate_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose size others share but whose content may not be read, and whether the analysis is complete."""
    files = _files(spark, sf_dir).select("size_bytes", "attributes")
    skipped = files.where(paths.avoids_content(F.col("attributes"))).join(duplicates.size_buckets(files).select("size_bytes"), "size_bytes", "left_semi")
    return skipped.agg(F.count("*").alias("skipped_content_files")).withColumn("complete", F.col("skipped_content_files") == 0)


from . import catalog_files, catalog_state  # noqa: E402, F401  register more queries

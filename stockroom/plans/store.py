"""Published snapshots: a commit log for each root, and the tables that its entries name.

Every writer puts its tables into a folder of a name that nobody else has, and then adds one entry to the root's log: a small file, complete before it gets its name,
whose number follows the one that the writer started from, and which only one writer can create. Nothing that readers see is ever overwritten. A writer that is refused, or
dies at any step, leaves a folder that no entry names and holds nobody up. Readers take the last entry and read what it names; `vacuum` keeps that
until it has been replaced for a while.

The log needs a file system that gives a name to one of several files only: local ones (by a link) and those of the Hadoop kind (by a rename that doesn't replace).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions import paths
from ..sources import scratch

FILES = "path string, parent_path string, size_bytes long, modified_ns long, attributes long"
DIRECTORIES = "path string, parent_path string, size_bytes long, files long"
MARKS = "file string, row long, parent_path string, size_bytes long, path string"
#: Deltas that lie over a generation before all is written anew; rows of a file; rows from one mark to the next, and of a page of a Parquet column.
MOST_OVERLAYS, FILE_ROWS, MARK_ROWS = 8, 1_000_000, 1000
#: The layout that is written. 1: no parent paths, attributes or marks need be there, and a pointer file may stand in place of a log. 2: tables by parent, size and path, with marks.
LAYOUT = 2
ENTRY = "root string, generation long, revision long, completed_at_unix long, file_count long, has_tree boolean, watermark string, data string, overlays array<string>, layout int"


def migrated(files: DataFrame) -> DataFrame:
    """Rows of any older layout in today's: parent paths follow from paths, attributes that were not kept are those of an ordinary file."""
    have = files.columns
    parent = F.col("parent_path") if "parent_path" in have else F.lit(None).cast("string")
    attributes = F.col("attributes") if "attributes" in have else F.lit(None).cast("long")
    modified = F.col("modified_ns") if "modified_ns" in have else F.lit(None).cast("long")
    return files.select("path", F.coalesce(F.when(parent != "", parent), paths.parent(F.col("path"))).alias("parent_path"), F.col("size_bytes").cast("long").alias("size_bytes"), F.coalesce(modified, F.lit(0)).cast("long").alias("modified_ns"), F.coalesce(attributes, F.lit(32)).cast("long").alias("attributes"))


@dataclass(frozen=True)
class Scope:
    """An entry of the log. revision: its number; data, overlays: folders of tables, the later over the earlier."""

    root: str
    generation: int
    revision: int
    completed_at_unix: int
    file_count: int
    has_tree: bool = True
    watermark: dict | None = None
    data: str = ""
    overlays: list[str] = field(default_factory=list)
    layout: int = LAYOUT


def _scope(entry: dict) -> Scope:
    """An entry, or the pointer of layout 1, whose tables were named by numbers."""
    entry = dict(entry)
    if entry.get("layout") is None:
        g = entry["generation"]
        entry |= {"layout": 1, "data": f"generation={g}", "revision": entry.get("revision") or 0, "overlays": [f"generation={g}-{r}" for r in entry.get("overlays") or []]}
    if isinstance(entry.get("watermark"), str):
        entry["watermark"] = json.loads(entry["watermark"])
    if entry.get("has_tree") is None:
        entry["has_tree"] = False
    return Scope(**entry)


class Store:
    """Snapshots under `base`, a path that all executors share."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())
        self._staged: dict[str, tuple[str, Scope | None]] = {}

    def _key(self, root: str) -> str:
        return hashlib.sha256(root.encode()).hexdigest()[:32]

    def _log(self, root: str) -> str:
        return f"{self.base}/{self._key(root)}/log"

    def _at(self, root: str, kind: str, name: str) -> str:
        """Where a table lies. kind: files, directories, or one of these with `-marks`."""
        return f"{self.base}/{self._key(root)}/{kind}/{name}" if name.startswith("generation=") else f"{self.base}/{self._key(root)}/data/{name}/{kind}"

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _read(self, path: str) -> str | None:
        if not self._exists(path):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _listed(self, path: str) -> list[tuple[str, float]]:
        """(name, time of change in seconds) of what lies in a folder."""
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(path))] if self._exists(path) else []

    def _create(self, path: str, text: str) -> bool:
        """Whether this caller gave `path` to a file with that text; if the name is taken nothing changes."""
        target = self._path(path)
        folder = target.getParent()
        part = self._path(folder, f".{uuid.uuid4().hex}.part")
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(part.toUri().getPath(), target.toUri().getPath())
            else:
                jvm = self.spark._jvm
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                modes = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(part, target, modes)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError:
            if self._fs.exists(target):
                return False
            raise
        finally:
            self._fs.delete(part, False)

    def _entries(self, root: str) -> list[tuple[int, float]]:
        """(number, time) of the log's entries, ascending."""
        return sorted((int(m[1]), t) for name, t in self._listed(self._log(root)) if (m := re.fullmatch(r"(\d{20})\.json", name)))

    def _entry(self, root: str, number: int) -> Scope | None:
        text = self._read(f"{self._log(root)}/{number:020}.json")
        return _scope(json.loads(text)) if text else None

    def scope(self, root: str) -> Scope | None:
        """What is published for a root: its last entry, or the pointer of layout 1."""
        if numbers := self._entries(root):
            return self._entry(root, numbers[-1][0])
        text = self._read(f"{self.base}/scopes/{self._key(root)}.json")
        return _scope(json.loads(text)) if text else None

    def scopes(self, n: int = LIMITS.scopes) -> list[Scope]:
        """The latest scopes; none if nothing was ever published, and nothing is created by asking. Logs are read by tasks; n entries reach the driver."""
        found = None
        for pattern in (f"{self.base}/*/log/*.json", f"{self.base}/scopes/*.json"):
            if self._fs.globStatus(self._path(pattern)):
                schema = ENTRY if "/log/" in pattern else ENTRY.replace("overlays array<string>", "overlays array<long>")
                some = self.spark.read.schema(schema).json(pattern).withColumn("overlays", F.col("overlays").cast("array<string>"))
                found = some if found is None else found.unionByName(some)
        if found is None:
            return []
        last = found.groupBy("root").agg(F.max_by(F.struct(*found.columns), F.coalesce("revision", F.lit(0))).alias("e")).select("e.*")
        return [_scope({k: v for k, v in r.asDict().items() if v is not None or k in ("layout", "has_tree", "watermark")}) for r in last.orderBy(F.desc("completed_at_unix"), "root").limit(n).collect()]

    def _folder(self, scope: Scope, kind: str, name: str, schema: str) -> DataFrame:
        """A table as it was written, in today's columns."""
        path = self._at(scope.root, kind, name)
        if scope.layout >= 2 and not name.startswith("generation="):
            return self.spark.read.schema(schema).parquet(path)
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        old = self.spark.read.parquet(path)
        return migrated(old) if kind == "files" else old.select([F.col(c.split()[0]) for c in schema.split(", ")])

    def _over(self, scope: Scope, kind: str, schema: str) -> DataFrame | None:
        """The last row of each path that overlays replace."""
        over = None
        for i, name in enumerate(scope.overlays):
            one = self._folder(scope, kind, name, schema).withColumn("__r", F.lit(i))
            over = one if over is None else over.unionByName(one)
        return None if over is None else over.groupBy("path").agg(F.max_by(F.struct(*(c.split()[0] for c in schema.split(", "))), "__r").alias("x")).select("x.*")

    def _table(self, scope: Scope, kind: str, schema: str) -> DataFrame:
        """A table of a scope: its generation, with the rows that overlays replace."""
        base, last = self._folder(scope, kind, scope.data, schema), self._over(scope, kind, schema)
        return base if last is None else base.join(last.select("path"), "path", "left_anti").unionByName(last)

    def files(self, scope: Scope) -> DataFrame:
        return self._table(scope, "files", FILES)

    def directories(self, scope: Scope) -> DataFrame:
        return self._table(scope, "directories", DIRECTORIES)

    def _commit(self, old: Scope | None, new: Scope) -> Scope:
        """Make `new` the last entry behind `old`; ValueError if that isn't the last one: nothing changes then."""
        now = self.scope(new.root)
        self._fs.mkdirs(self._path(self._log(new.root)))
        if (now.revision if now else 0) != (old.revision if old else 0) or not self._create(f"{self._log(new.root)}/{new.revision:020}.json", json.dumps(asdict(new))):
            raise ValueError("the snapshot has been replaced meanwhile")
        return new

    def _put(self, df: DataFrame, schema: str, root: str, kind: str, name: str) -> None:
        """Write rows in ranges of parent, size (largest first) and path, FILE_ROWS or so to a file and MARK_ROWS to a page, with every MARK_ROWS-th row's key beside
        them: what a page of a directory needs is found by these keys and read alone."""
        df = scratch.save(df.select([c.split()[0] for c in schema.split(", ")]), kind)
        n, by = max(1, -(-df.count() // FILE_ROWS)), ("parent_path", F.desc("size_bytes"), "path")
        path = self._at(root, kind, name)
        ranged = lambda rows, n: (rows.repartition(1) if n == 1 else rows.repartitionByRange(n, *by)).sortWithinPartitions(*by)
        rows = ranged(df, n)
        rows.write.option("parquet.page.row.count.limit", MARK_ROWS).option("parquet.enable.dictionary", "false").parquet(path)
        at = self.spark.read.schema(schema).parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "parent_path", "size_bytes", "path")
        ranged(at.where(F.col("row") % MARK_ROWS == 0), max(1, n // 64)).write.parquet(f"{path}-marks")

    def stage(self, root: str, files: DataFrame, directories: DataFrame) -> str:
        """Write an unpublished generation, in a folder of its own, and return its name."""
        name = uuid.uuid4().hex
        self._staged[name] = (root, self.scope(root))
        self._put(files, FILES, root, "files", name)
        self._put(directories, DIRECTORIES, root, "directories", name)
        return name

    def staged_files(self, root: str, name: str) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(self._at(root, "files", name))

    def parts(self, root: str, name: str) -> int:
        """Files that hold a generation's file rows, counted where they lie."""
        return sum(n.startswith("part-") for n, _ in self._listed(self._at(root, "files", name)))

    def publish(self, root: str, name: str, watermark: dict | None = None) -> Scope:
        """Make a staged generation the one that readers see. ValueError if another has been published since it was staged: nothing changes then."""
        old = self._staged.pop(name)[1] if name in self._staged else self.scope(root)
        count = self.staged_files(root, name).count()
        has_tree = not self.spark.read.schema(DIRECTORIES).parquet(self._at(root, "directories", name)).isEmpty()
        return self._commit(old, Scope(root, (old.generation if old else 0) + 1, (old.revision if old else 0) + 1, int(time.time()), count, has_tree, watermark, name))

    def overlay(self, scope: Scope, files: DataFrame, directories: DataFrame, watermark: dict | None = None) -> Scope:
        """Publish changed rows over a generation: a new revision of it. With MOST_OVERLAYS of them, or over an older layout, all rows are written as a generation of
        their own. ValueError if `scope` is no longer the last entry: nothing that can be read changes then."""
        now = self.scope(scope.root)
        if now is None or now.revision != scope.revision:
            raise ValueError("the snapshot has been replaced meanwhile")
        name, key = uuid.uuid4().hex, self._key(scope.root)
        for kind, df, like in (("files", files, FILES), ("directories", directories, DIRECTORIES)):
            self._put(df, like, scope.root, kind, name)
        new = replace(scope, revision=scope.revision + 1, completed_at_unix=int(time.time()), watermark=watermark or scope.watermark, overlays=[*scope.overlays, name])
        made = [name]
        if len(new.overlays) >= MOST_OVERLAYS or scope.layout < LAYOUT:
            made.append(self.stage(scope.root, self.files(new), self.directories(new)))
            self._staged.pop(made[-1])
            new = replace(new, generation=scope.generation + 1, data=made[-1], overlays=[], layout=LAYOUT)
        try:
            return self._commit(scope, new)
        except ValueError:
            for x in made:  # nobody else knows these names
                self._fs.delete(self._path(f"{self.base}/{key}/data/{x}"), True)
            raise

    def vacuum(self, root: str, seconds: float = LIMITS.retain_seconds) -> int:
        """Delete what readers no longer need, and say how many folders: entries that were replaced `seconds` ago or more, the tables that only these name, and folders
        of writers that came to nothing, unchanged for as long. A reader, or a writer between stage and publish, that takes longer loses its tables."""
        now, entries = time.time(), self._entries(root)
        gone = {number for (number, _), (_, since) in zip(entries, entries[1:], strict=False) if now - since >= seconds}
        kept = [s for number, _ in entries if number not in gone and (s := self._entry(root, number)) is not None]
        first = self._read(f"{self.base}/scopes/{self._key(root)}.json")
        if first and (not entries or now - entries[0][1] < seconds):
            kept.append(_scope(json.loads(first)))
        used = {name for s in kept for name in (s.data, *s.overlays)}
        for number in sorted(gone):  # entries go first: nothing is ever listed whose tables are gone
            self._fs.delete(self._path(f"{self._log(root)}/{number:020}.json"), False)
        n, home = 0, f"{self.base}/{self._key(root)}"
        for folder in (f"{home}/data", f"{home}/files", f"{home}/directories", self._log(root)):
            for name, since in self._listed(folder):
                loose = name.endswith(".part") if folder.endswith("/log") else name not in used
                if loose and now - max([since, *(t for _, t in self._listed(f"{folder}/{name}"))] if not name.endswith(".part") else [since]) >= seconds:
                    self._fs.delete(self._path(f"{folder}/{name}"), True)
                    n += 1
        return n

    def _upper(self, scope: Scope, kind: str, parent: str, after: tuple[int, str] | None, rows: int) -> tuple[int, str] | None:
        """A key (size, path) with at least `rows` children of a directory between the cursor and it, by the marks; None if the marks don't reach so far: few are left then."""
        marks = self.spark.read.schema(MARKS).parquet(self._at(scope.root, f"{kind}-marks", scope.data)).where(F.col("parent_path") == parent)
        if after is not None:
            marks = marks.where(behind(*after))
        seen, last, most = 0, None, rows // MARK_ROWS + 2
        while True:
            found = marks.orderBy(F.desc("size_bytes"), "path").limit(most).collect()
            for r in found:
                seen, last = seen + (MARK_ROWS if last is not None and last["file"] == r["file"] else 0), r
                if seen >= rows:
                    return r["size_bytes"], r["path"]
            if len(found) < most:
                return None
            most, seen, last = 2 * most, 0, None

    def children(self, scope: Scope, kind: str, parent: str, after: tuple[int, str] | None, n: int) -> DataFrame:
        """The first n files or directories directly in `parent` behind a cursor (size, path), largest first, then by path. What is read follows n, not the directory."""
        schema = FILES if kind == "files" else DIRECTORIES
        own = F.col("parent_path") == parent
        base, over = self._folder(scope, kind, scope.data, schema).where(own), self._over(scope, kind, schema)
        if scope.layout >= 2:
            changed = 0 if over is None else (over := scratch.save(over.where(own), "over")).count()
            upper = self._upper(scope, kind, parent, after, n + changed)
            if upper is not None:
                base = base.where((F.col("size_bytes") >= upper[0]) & ~behind(*upper))
        if over is not None:
            base = base.join(over.select("path"), "path", "left_anti").unionByName(over.where(own))
        if after is not None:
            base = base.where((F.col("size_bytes") <= after[0]) & behind(*after))
        return base.where(F.col("path") != parent).orderBy(F.desc("size_bytes"), "path").limit(n)


def behind(size: int, path: str):
    """Whether a row comes after a cursor, largest first, then by path."""
    s = F.col("size_bytes")
    return (s < size) | ((s == size) & (F.col("path") > path))

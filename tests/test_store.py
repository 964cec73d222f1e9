"""The snapshot store: writers that meet or die at any step, readers across refreshes, older layouts, pages of big directories."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from stockroom.plans import commands, store


def rows(spark, sizes, parent="/r"):
    return spark.createDataFrame([(f"{parent}/{k}", parent, v, 1, 32) for k, v in sizes.items()], store.FILES)


def tree(spark, size=1, files=1):
    return spark.createDataFrame([("/r", "", size, files)], store.DIRECTORIES)


def sizes(s, scope=None):
    return {r["path"][3:]: r["size_bytes"] for r in s.files(scope or s.scope("/r")).collect()}


@pytest.fixture()
def base(tmp_path):
    return f"file://{tmp_path}/s"


def test_a_refused_delta_changes_nothing_that_is_published(spark, base):
    a, b = store.Store(spark, base), store.Store(spark, base)
    scope = a.publish("/r", a.stage("/r", rows(spark, {"x": 1, "y": 2}), tree(spark)))
    a.overlay(scope, rows(spark, {"x": 111}), tree(spark, 113))
    with pytest.raises(ValueError):
        b.overlay(scope, rows(spark, {"x": 999}), tree(spark, 1001))
    assert sizes(b) == {"x": 111, "y": 2} and [r["size_bytes"] for r in b.directories(b.scope("/r")).collect()] == [113]
    scope = b.overlay(b.scope("/r"), rows(spark, {"y": 3}), tree(spark, 114))
    assert sizes(a) == {"x": 111, "y": 3} and scope.revision == 3


def steps(s, calls):
    """A store whose every touch of the log or of a table is told to `calls` before it happens."""
    for name in ("_put", "_create", "scope", "_commit"):

        def told(*args, _f=getattr(s, name), _n=name, **kwargs):
            calls(_n)
            return _f(*args, **kwargs)

        setattr(s, name, told)
    return s


@pytest.mark.parametrize("kind", ["overlay", "publish"])
def test_two_writers_at_every_step(spark, base, kind):
    """B does all of its work before A's i-th step, for every i: one of the two wins, what is published is whole, and the log has no gap."""

    def write(s, scope, value):
        if kind == "overlay":
            return s.overlay(scope, rows(spark, {"x": value}), tree(spark, value))
        return s.publish("/r", s.stage("/r", rows(spark, {"x": value, "z": value}), tree(spark, value)))

    i, met = 0, True
    while met:
        other = store.Store(spark, f"{base}-{kind}-{i}")
        start = other.publish("/r", other.stage("/r", rows(spark, {"x": 0, "y": 5}), tree(spark)))
        count = 0

        def calls(name, i=i, other=other):
            nonlocal count
            if count == i:
                write(other, other.scope("/r"), 222)
            count += 1

        mine = steps(store.Store(spark, other.base), calls)
        try:
            write(mine, start, 111)
            won = True
        except ValueError:
            won = False
        met = count > i
        now = other.scope("/r")
        assert won == (not met or (kind == "publish" and i == 0))  # only who starts behind the other, or alone, wins
        assert sizes(other)["x"] == (111 if won else 222)
        assert [e for e, _ in other._entries("/r")] == list(range(1, now.revision + 1)) and now.revision == (3 if won and met else 2)
        assert [r["size_bytes"] for r in other.directories(now).collect()] == [111 if won else 222]
        i += 1
    assert i >= 4


def test_a_writer_that_dies_at_any_step_blocks_nobody(spark, base):
    i, died = 0, True
    while died:
        s = store.Store(spark, f"{base}{i}")
        start = s.publish("/r", s.stage("/r", rows(spark, {"x": 1}), tree(spark)))
        count, died = 0, False

        def calls(name, i=i):
            nonlocal count
            if count == i:
                raise KeyboardInterrupt
            count += 1

        try:
            steps(store.Store(spark, s.base), calls).overlay(start, rows(spark, {"x": 7}), tree(spark, 7))
        except KeyboardInterrupt:
            died = True
            assert sizes(s) == {"x": 1}
            scope = s.overlay(s.scope("/r"), rows(spark, {"x": 9}), tree(spark, 9))
            assert sizes(s) == {"x": 9} and s.vacuum("/r", 0) == min(1, max(0, i - 1)) + 0 * scope.revision and sizes(s) == {"x": 9}
        i += 1
    assert i >= 5


def test_threads_lose_no_change(spark, base):
    s = store.Store(spark, base)
    s.publish("/r", s.stage("/r", rows(spark, {"x": 0, "y": 0, "z": 0}), tree(spark)))

    def add(name):
        mine = store.Store(spark, base)
        while True:
            try:
                mine.overlay(mine.scope("/r"), rows(spark, {name: 7}), tree(spark, 7))
                return
            except ValueError:
                continue

    threads = [threading.Thread(target=add, args=(n,)) for n in "xyz"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sizes(s) == {"x": 7, "y": 7, "z": 7} and s.scope("/r").revision == 4


def test_readers_finish_what_they_began(spark, base, tmp_path):
    s = store.Store(spark, base)
    old = s.publish("/r", s.stage("/r", rows(spark, {"x": 1}), tree(spark)))
    reader = s.files(old)
    for v in (2, 3):
        s.publish("/r", s.stage("/r", rows(spark, {"x": v}), tree(spark)))
        assert s.vacuum("/r") == 0
    assert [r["size_bytes"] for r in reader.collect()] == [1]
    s.stage("/r", rows(spark, {"x": 99}), tree(spark))  # and never published
    assert s.vacuum("/r", 0) == 3 and sizes(s) == {"x": 3} and len(s._entries("/r")) == 1
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        s.files(old).collect()
    scope = s.publish("/r", s.stage("/r", rows(spark, {"x": 4}), tree(spark)))
    assert (scope.revision, scope.generation) == (4, 4)


def test_scopes_are_read_from_logs_and_pointers(spark, base, tmp_path):
    s = store.Store(spark, base)
    assert s.scopes() == [] and not os.path.exists(tmp_path / "s")
    for i in range(3):
        root = f"/r{i}"
        s.publish(root, s.stage(root, rows(spark, {"x": 1}, root), spark.createDataFrame([(root, "", 1, 1)], store.DIRECTORIES)), {"next": i})
    s.overlay(s.scope("/r1"), rows(spark, {"x": 2}, "/r1"), spark.createDataFrame([("/r1", "", 2, 1)], store.DIRECTORIES))
    found = s.scopes()
    assert {(x.root, x.revision, x.file_count) for x in found} == {("/r0", 1, 1), ("/r1", 2, 1), ("/r2", 1, 1)} and all(x == s.scope(x.root) for x in found)
    assert len(s.scopes(2)) == 2


def old_store(tmp_path, spark, root, pointer, files, directories=None, number=1):
    """What earlier versions left: a pointer file, and tables in folders by number."""
    key = store.Store(spark, f"file://{tmp_path}/s")._key(root)
    files.write.parquet(f"file://{tmp_path}/s/{key}/files/generation={number}")
    if directories is not None:
        directories.write.parquet(f"file://{tmp_path}/s/{key}/directories/generation={number}")
    os.makedirs(tmp_path / "s/scopes", exist_ok=True)
    (tmp_path / f"s/scopes/{key}.json").write_text(json.dumps(pointer))


def test_a_layout_without_parents_is_searched_and_then_refreshed(spark, tmp_path, base):
    root = tmp_path / "scope"
    root.mkdir()
    (root / "keep.txt").write_bytes(b"hello")
    files = spark.createDataFrame([(f"{root}/keep.txt", 5)], "path string, size_bytes long")
    old_store(tmp_path, spark, str(root), {"root": str(root), "generation": 1, "completed_at_unix": 123, "file_count": 1}, files)
    s = store.Store(spark, base)
    assert s.files(s.scope(str(root))).collect() == [(f"{root}/keep.txt", str(root), 5, 0, 32)]
    assert commands.search_index(spark, base, str(root), "keep")["report"]["totalMatches"] == 1
    assert [(x["files"], x["completedAtUnix"], x["hasTree"]) for x in commands.list_indexed_scopes(spark, base)] == [(1, 123, False)]
    with pytest.raises(ValueError):  # no directories until it is refreshed
        commands.browse_index_tree(spark, base, str(root), str(root))
    r = commands.refresh_index(spark, base, str(root))
    assert (r["files"], r["removed"]) == (1, 0)
    page = commands.browse_index_tree(spark, base, str(root), str(root))
    assert [n["name"] for n in page["nodes"]] == ["keep.txt"] and s.scope(str(root)).layout == store.LAYOUT


def test_a_delta_over_an_older_layout_writes_it_anew(spark, tmp_path, base):
    files = spark.createDataFrame([("/r/a/x", 5, 7), ("/r/y", 2, 7)], "path string, size_bytes long, modified_ns long")
    dirs = spark.createDataFrame([("/r", "", 7, 2), ("/r/a", "/r", 5, 1)], store.DIRECTORIES)
    old_store(tmp_path, spark, "/r", {"root": "/r", "generation": 3, "revision": 4, "completed_at_unix": 1, "file_count": 2, "has_tree": True, "watermark": {"next": 9}, "overlays": []}, files, dirs, 3)
    page = commands.browse_index_tree(spark, base, "/r", "/r")
    assert [(n["name"], n["kind"], n["sizeBytes"]) for n in page["nodes"]] == [("a", "directory", 5), ("y", "file", 2)] and page["generation"] == 4
    scope = commands.apply_changes(spark, base, "/r", [("/r/a/x", 50)])
    assert (scope.layout, scope.revision, scope.overlays, scope.watermark) == (store.LAYOUT, 5, [], {"next": 9})
    assert [(n["name"], n["sizeBytes"]) for n in commands.browse_index_tree(spark, base, "/r", "/r")["nodes"]] == [("a", 50), ("y", 2)]
    s = store.Store(spark, base)
    assert s.vacuum("/r") == 0 and s.vacuum("/r", 0) == 3 and sizes(s) == {"a/x": 50, "y": 2}


def scanned(df):
    """Rows that the scans of a collected DataFrame gave."""
    plan = df._jdf.queryExecution().executedPlan()
    if "Adaptive" in plan.getClass().getSimpleName():
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    n = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.plan() if hasattr(leaf, "plan") and "QueryStage" in leaf.getClass().getSimpleName() else leaf
        if leaf.metrics().contains("numOutputRows"):
            n += leaf.metrics().apply("numOutputRows").value()
    return n


def test_pages_of_a_big_directory(spark, base):
    """Page by page the same children in the same order, and the last page reads no more than the first."""
    s, n = store.Store(spark, base), 60_000
    i = F.col("id")
    files = spark.range(n).select(F.concat(F.lit("/r/f"), F.lpad(i.cast("string"), 6, "0")).alias("path"), F.lit("/r").alias("parent_path"), F.when(i % 3 == 0, 0).otherwise(i * 7919 % 5000).cast("long").alias("size_bytes"), i.alias("modified_ns"), F.lit(32).cast("long").alias("attributes"))
    scope = s.publish("/r", s.stage("/r", files.unionByName(rows(spark, {f"g{k}": k for k in range(500)}, "/r/sub")), tree(spark)))
    changed = {"f000007": 10**9, "f000003": 4321, "f000004": 0}
    scope = s.overlay(scope, rows(spark, changed), tree(spark))
    want = sorted(((f"/r/f{k:06}", changed.get(f"f{k:06}", 0 if k % 3 == 0 else k * 7919 % 5000)) for k in range(n)), key=lambda x: (-x[1], x[0]))
    read = []
    for at in (0, 1, 150, 20_000, 39_990, 45_000, 59_900, 59_999, 60_000):
        page = s.children(scope, "files", "/r", (want[at - 1][1], want[at - 1][0]) if at else None, 101)
        assert [(r["path"], r["size_bytes"]) for r in page.collect()] == want[at : at + 101]
        read.append(scanned(page))
    assert max(read) <= 8 * store.MARK_ROWS, read
    page = commands.browse_index_tree(spark, base, "/r", "/r", limit=2)
    assert [(x["name"], x["sizeBytes"]) for x in page["nodes"]] == [("f000007", 10**9), (want[1][0][3:], want[1][1])]
    assert [x["name"] for x in commands.browse_index_tree(spark, base, "/r", "/r", page["nextCursor"], 2)["nodes"]] == [w[0][3:] for w in want[2:4]]

"""Intervals, running totals, jumps along parents, and patterns that are refused, against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from stockroom.config import LIMITS, OFFLINE, REPARSE
from stockroom.functions.linear import explosive
from stockroom.operators import hierarchy, intervals, report, search
from stockroom.plans import commands

EDGES = "id string, parent string, name string"


def test_verdicts(spark):
    n = LIMITS.tree_depth
    chain = [(f"k{i}", f"k{i - 1}" if i else "o'x", f"d{i}") for i in range(n + 3)]
    rows = [*chain, ("leaf", f"k{n - 2}", "leaf"), ("a", "b", "a"), ("b", "c", "b"), ("c", "a", "c"), ("behind", "a", "z"), ("self", "self", "s"), ("orphan", "gone", "o"), ("child", "orphan", "c"), ("none", None, "n"), ("o'x", "o'x", "root"), ("e", "o'x", "e")]
    got = {r["id"]: (r["verdict"], r["path"], r["depth"]) for r in hierarchy.placed(spark.createDataFrame(rows, EDGES), "o'x", "/it's").collect()}
    path = lambda i: "/it's/" + "/".join(f"d{j}" for j in range(i + 1))
    want = {f"k{i}": ("reached", path(i), i + 1) if i < n else ("deep", None, None) for i in range(n + 3)}
    want |= {"leaf": ("reached", path(n - 2) + "/leaf", n), "e": ("reached", "/it's/e", 1)}
    want |= {k: ("cycle", None, None) for k in ("a", "b", "c", "behind", "self")} | {k: ("missing", None, None) for k in ("orphan", "child", "none")}
    assert got == want


def test_depth_128_takes_seven_rounds(spark, monkeypatch):
    rounds, save = [], intervals.scratch.save
    monkeypatch.setattr(intervals.scratch, "save", lambda df, name: (rounds.append(name), save(df, name))[1])
    edges = spark.createDataFrame([(str(i + 1), str(i), f"d{i}") for i in range(LIMITS.tree_depth)], EDGES)
    assert hierarchy.resolved_paths(edges, "0", "/r").count() == LIMITS.tree_depth + 1
    assert rounds.count("jumps") <= 1 + 7


def names(rnd):
    return "".join(rnd.choice("ab-0!/é"[:5] + "é") for _ in range(rnd.randrange(1, 3)))


def invented(rnd, n):
    dirs = ["/r"]
    for _ in range(n):
        dirs.append(rnd.choice(dirs) + "/" + names(rnd))
    dirs = sorted(set(dirs))
    return dirs, sorted({(rnd.choice(dirs) + "/f" + names(rnd), rnd.randrange(100)) for _ in range(4 * n)})


def test_sums_below_directories(spark):
    rnd = random.Random(1)
    for root in ("/r", "/"):
        dirs, files = invented(rnd, 60)
        dirs = dirs if root == "/r" else ["/", *dirs]
        got = {r["path"]: (r["size_bytes"], r["files"]) for r in report.rollup(spark.createDataFrame(files, "path string, size_bytes long"), root, spark.createDataFrame([(d,) for d in dirs], "path string")).collect()}
        below = {d: [s for p, s in files if p.startswith(d.rstrip("/") + "/")] for d in dirs}
        assert got == {d: (sum(b), len(b)) for d, b in below.items()}


def test_files_below_closed_directories(spark):
    rnd = random.Random(2)
    dirs, files = invented(rnd, 80)
    closed = [d for d in dirs if rnd.random() < 0.1]
    df = spark.createDataFrame(files, "path string, size_bytes long").repartition(5)
    marked = spark.createDataFrame([(d, OFFLINE if d in closed else 16) for d in dirs], "path string, attributes long")
    kept, virtual = hierarchy.without_virtual(df, marked, "/r")
    assert sorted(map(tuple, kept.collect())) == [f for f in files if not any(f[0].startswith(d + "/") for d in closed)]
    assert kept.columns == df.columns and {r[0] for r in virtual.collect()} == set(closed)
    assert "explode" not in kept._jdf.queryExecution().optimizedPlan().toString().lower()
    assert intervals.not_below(df, marked.where("false").select("path")).count() == len(files)


def plain_tree(dirs, root, expanded=None):
    out = []

    def visit(d, depth):
        out.append((len(out), depth, d))
        if expanded is None or d in expanded:
            for child in sorted((x for x in dirs if x.rsplit("/", 1)[0] == d), key=lambda x: (-dirs[x][0], x)):
                visit(child, depth + 1)

    visit(root, 0)
    return out


def test_pre_order_and_viewports(spark):
    rnd = random.Random(4)
    names_, files = invented(rnd, 70)
    dirs = {d: (sum(s for p, s in files if p.startswith(d + "/")) // 40, 1) for d in names_}
    df = spark.createDataFrame([(d, "" if d == "/r" else d.rsplit("/", 1)[0], *v) for d, v in dirs.items()], "path string, parent_path string, size_bytes long, files long")
    got = sorted((r["position"], r["depth"], r["path"]) for r in hierarchy.flattened(df, "/r").collect())
    assert got == plain_tree(dirs, "/r")
    for chance in (0.0, 0.5, 0.9):
        expanded = {d for d in dirs if rnd.random() < chance} | ({"/r"} if chance else set())
        want = plain_tree(dirs, "/r", expanded)
        some = spark.createDataFrame([(d,) for d in expanded], "path string")
        assert sorted((r["position"], r["depth"], r["path"]) for r in hierarchy.flattened(df, "/r", 2, 7, some).collect()) == want[2:9]


def bulk(spark, *rows):
    return spark.createDataFrame(rows, "id string, parent string, name string, is_directory boolean, size_bytes long, attributes int, modified_ns long, hardlink_count long")


def test_an_enumeration_with_offline_files_links_or_a_moved_journal_is_walked(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "f").write_bytes(b"12345")
    sound = [("1", "0", "d", True, 0, 16, 1, 1), ("2", "1", "f", False, 7, 32, 2, 1), ("3", "0", "link", True, 0, 16 | REPARSE, 2, 1), ("4", "3", "hidden", False, 9, OFFLINE, 2, 5)]
    go = lambda rows, *marks: commands.refresh_index(spark, f"file://{tmp_path}/s", str(root), bulk=(bulk(spark, *rows), "0", *marks))
    got = go(sound, {"next": 4}, {"next": 4})
    assert (got["indexMethod"], got["files"]) == ("bulk", 1)
    assert go(sound, {"next": 4}, {"next": 5})["indexMethod"] == "walk"
    for bad in (("5", "1", "x", False, 1, OFFLINE, 2, 1), ("5", "1", "x", False, 1, 32, 2, 2), ("5", "9", "x", False, 1, 32, 2, 1), ("5", "1", "x/y", False, 1, 32, 2, 1)):
        assert go([*sound, bad])["indexMethod"] == "walk"


def test_patterns_whose_time_cannot_be_told_are_refused(spark):
    for bad in (r"(.*\p{L}){10}b$", r"(\p{L}+)+$", r"(?:\h*x*)*y$", r"(\x{61}*)*b", r"[a-z&&[^b]]+(c", r"(\p{IsAlphabetic}|a)*$", r"\Q(a*)*\E(a*)*b"):
        with pytest.raises(ValueError):
            search.checked_pattern(bad)
    files = spark.createDataFrame([("/é1/x.txt", 1), ("/b\t/yy", 2)], "path string, size_bytes long")
    for good, want in ((r"\p{L}\d/", [1]), (r"\h", [2]), (r"\x{79}{2}$", [2]), (r"\\\\p", [])):
        began = time.monotonic()
        assert [r["size_bytes"] for r in files.where(search.matches(F.col("path"), good)).collect()] == want and time.monotonic() - began < 20
    assert not explosive(r"\p{Lu}+\.txt$") and explosive(r"(\p{Lu}+)+")


def test_slices_for_cards_and_lists(spark):
    d = spark.createDataFrame([(f"/d{i:02}", i, 0 if i == 99 else 1000) for i in range(20)], "path string, size_bytes long, logical_bytes long")
    assert [(r["path"], r["bar"]) for r in report.cards(d).collect()] == [(f"/d{i:02}", max(1.0, i / 10)) for i in range(19, 13, -1)]
    assert report.listed(spark.range(80), F.desc("id")).count() == LIMITS.listed_matches

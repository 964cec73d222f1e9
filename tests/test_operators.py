"""Operators on small fixtures, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from stockroom.config import LIMITS
from stockroom.operators import audit, budget, compare, duplicates, hierarchy, journal, report, search, snapshot


@pytest.mark.parametrize("seed", range(6))
def test_greedy_budget_is_the_greedy_loop(spark, seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([0, 1, 2, 3, 5, 8, 13, 40, 41, 100]) for _ in range(rnd.randrange(1, 60))]
    limit = rnd.randrange(0, sum(sizes) + 5)
    left, want = limit, []
    for i, s in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        if s <= left:
            left -= s
            want.append(f"/{i:03}")
    files = spark.createDataFrame([(f"/{i:03}", s) for i, s in enumerate(sizes)], "path string, size_bytes long")
    got = duplicates.within_budget(files, limit, F.col("size_bytes")).where("admitted").collect()
    assert sorted(r["path"] for r in got) == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_prefix_budget_is_the_loop(spark, seed):
    rnd = random.Random(100 + seed)
    sizes = [rnd.randrange(1, 12) for _ in range(40)]
    limit = rnd.randrange(0, 200)
    left, want = limit, []
    for i, s in sorted(enumerate(sizes), key=lambda x: (x[1], x[0])):
        if s <= left:
            left -= s
            want.append(f"/{i:03}")
    files = spark.createDataFrame([(f"/{i:03}", s) for i, s in enumerate(sizes)], "path string, size_bytes long")
    assert sorted(r["path"] for r in compare.within_prefix(files, limit).where("admitted").collect()) == sorted(want)
    assert budget.prefix_counts(files.groupBy("size_bytes").agg(F.count("*").alias("n")), 0).agg(F.sum("admitted")).first()[0] == 0


def test_patterns():
    assert search.checked_pattern("  ") is None
    assert search.checked_pattern("a" * 4096)
    for bad in ("[", "a" * 4097, "(?=x)", "(?<!x)y", r"(a)\1", "a++"):
        with pytest.raises(ValueError):
            search.checked_pattern(bad)


def test_search_is_case_insensitive_beyond_ascii(spark):
    df = spark.createDataFrame([("/É.txt",), ("/e.txt",)], "path string")
    assert [r[0] for r in df.where(search.matches(F.col("path"), "é")).collect()] == ["/É.txt"]


def test_sample_cap(spark):
    files = spark.createDataFrame([(f"/{i}",) for i in range(8)], "path string")
    some, cut = search.sample(files, 3)
    assert (some.count(), cut) == (3, True)
    assert search.sample(files, 8)[1] is False
    with pytest.raises(ValueError):
        search.sample(files, 0)


def test_empty_directories_count_nothing(spark):
    files = spark.createDataFrame([("/r/sub/a", 4), ("/r/file", 3)], "path string, size_bytes long")
    dirs = spark.createDataFrame([("/r",), ("/r/sub",), ("/r/empty",)], "path string")
    got = {r["path"]: (r["size_bytes"], r["files"]) for r in report.rollup(files, "/r", dirs).collect()}
    assert got == {"/r": (7, 2), "/r/sub": (4, 1), "/r/empty": (0, 0)}


def test_oversize_groups_are_not_shown_as_verified(spark):
    rows = [(f"/{i}", 5, "h", str(i)) for i in range(4)] + [("/x", 6, "g", "x"), ("/y", 6, "g", "y")]
    d = spark.createDataFrame(rows, "path string, size_bytes long, hash string, identity string")
    assert [r["hash"] for r in duplicates.groups(d, most=3).collect()] == ["g"]
    s = duplicates.summary(d, most=3).first()
    assert (s["groups"], s["potential_savings_bytes"], s["oversize_groups"]) == (1, 6, 1)


def test_compare_aliases(spark):
    schema = "path string, size_bytes long, identity string, hash string"
    ref = spark.createDataFrame([("/r/a", 9, "1", "h"), ("/r/b", 9, "2", "h")], schema)
    cand = spark.createDataFrame([("/c/link", 9, "2", "h"), ("/c/x", 9, "3", "h"), ("/c/x2", 9, "3", "h"), ("/c/y", 9, "4", "other")], schema)
    got = {r["candidate_path"]: (r["outcome"], r["reference_path"]) for r in compare.classified(ref, cand).collect()}
    assert got == {"/c/link": ("alias", "/r/a"), "/c/x": ("match", "/r/a"), "/c/x2": ("alias", "/r/a")}


def test_hierarchy_leaves_out_cycles_and_orphans(spark):
    edges = spark.createDataFrame([("a", "0", "x"), ("b", "a", "y"), ("c", "d", "l"), ("d", "c", "m"), ("e", "gone", "n"), ("0", "0", "root")], "id string, parent string, name string")
    got = {r["id"]: r["path"] for r in hierarchy.resolved_paths(edges, "0", "/r").collect()}
    assert got == {"0": "/r", "a": "/r/x", "b": "/r/x/y"}


def test_deep_chains_resolve(spark):
    edges = spark.createDataFrame([(str(i + 1), str(i), f"d{i}") for i in range(LIMITS.tree_depth)], "id string, parent string, name string")
    assert hierarchy.resolved_paths(edges, "0", "/r").count() == LIMITS.tree_depth + 1


def test_audit(spark):
    ids = [f"0f8fad5b-d9cb-469f-a165-70867728950{c}" for c in "abcdef"]
    manifest = spark.createDataFrame([(ids[0], "/p", 1, "prepared", 1), (ids[1], "/q", 1, "quarantined", 2), (ids[2], "/c", 1, "quarantined", 3), ("../x", "/i", 1, "quarantined", 4), (ids[4], "/f", 1, "restored", 5)], "id string, original_path string, size_bytes long, state string, seq long")
    listing = spark.createDataFrame([(ids[0], 1, True), (ids[2], 2, True), (ids[3], 1, True), (ids[4], 1, True)], "name string, size_bytes long, is_regular boolean")
    found, cut = audit.audit(manifest, listing)
    assert {r["id"]: r["kind"] for r in found.collect()} == {ids[0]: "pending", ids[1]: "missing", ids[2]: "changed", ids[3]: "orphan", "../x": "invalid_id", ids[4]: "unexpected"} and not cut
    found, cut = audit.audit(manifest, listing, limit=1)
    assert cut and [r["kind"] for r in found.collect()] == ["pending"]


def test_allocation_chain(spark):
    files = spark.createDataFrame([("/r/a", 5, 32, 4096, 1, True), ("/r/b", 6, 32, 4096, 1, True), ("/r/c", 5, 4096, 0, 1, True), ("/o/d", 5, 32, 4096, 1, True)], "path string, size_bytes long, attributes long, allocated_bytes long, hardlink_count long, is_regular boolean")
    targets = spark.createDataFrame([("/r/a", 5), ("/r/b", 5), ("/r/c", 5), ("/o/d", 5), ("x", 5), ("/r/gone", 5)], "path string, expected_size_bytes long")
    got = audit.allocation(targets, files, "/r")
    assert {r["path"]: r["status"] for r in got.collect()} == {"/r/a": "measured", "/r/b": "changed", "/r/c": "excluded", "/o/d": "outside", "x": "outside", "/r/gone": "unavailable"}
    assert tuple(audit.allocation_counters(got).first()) == (1, 4, 1)


def test_watermarks():
    old = journal.Watermark(7, 1, 120, 55, "500")
    assert journal.continues(old, journal.Watermark(7, 1, 150, 55, "500"))
    for bad in (journal.Watermark(8, 1, 150, 55, "500"), journal.Watermark(7, 121, 150, 55, "500"), journal.Watermark(7, 1, 119, 55, "500"), journal.Watermark(7, 1, 150, 56, "500"), journal.Watermark(7, 1, 150, 55, "501")):
        assert not journal.continues(old, bad)


def test_pages_cover_all_nodes_once(spark):
    nodes = spark.createDataFrame([(0, "directory", "/r/sub", "sub", 7, 2, "local"), (0, "directory", "/r/empty", "empty", 0, 0, "local"), (1, "file", "/r/one", "one", 1, 1, "local"), (1, "file", "/r/two", "two", 2, 1, "local")], "kind_rank int, kind string, path string, name string, size_bytes long, files long, content_status string")
    seen, after = [], None
    while True:
        rows = snapshot.page(nodes, after, 1).collect()
        seen.append(rows[0]["path"])
        if len(rows) < 2:
            break
        after = (rows[0]["kind"], rows[0]["size_bytes"], rows[0]["path"])
    assert seen == ["/r/sub", "/r/empty", "/r/two", "/r/one"]


def test_greedy_budget_against_a_plain_fold(spark):
    """Random sizes, budgets from nothing to all, files of one size admitted in part; and many distinct sizes in little time."""
    import random
    import time

    rnd = random.Random(3)
    for _ in range(2):
        rows = [(f"/a/{i}", rnd.choice([rnd.randrange(0, 40), rnd.randrange(0, 3000)])) for i in range(120)]
        files = spark.createDataFrame(rows, "path string, size_bytes long").withColumn("attributes", F.lit(32))
        for limit in (0, 7, rnd.randrange(1, 60_000), 10**7):
            left, want = limit, set()
            for path, size in sorted(rows, key=lambda r: (-r[1], r[0])):
                if size <= left:
                    left -= size
                    want.add(path)
            got = duplicates.within_budget(files, limit, F.col("size_bytes"))
            assert {r["path"] for r in got.where("admitted").collect()} == want and got.count() == len(rows)
            left, want = limit, set()
            for path, size in sorted(rows, key=lambda r: (r[1], r[0])):
                if size > left:
                    break
                left -= size
                want.add(path)
            assert {r["path"] for r in compare.within_prefix(files, limit).where("admitted").collect()} == want
    many = spark.range(1, 1_000_001).select(F.col("id").alias("size_bytes"), F.lit(2).cast("long").alias("n"))
    began = time.monotonic()
    budget.greedy(many, 10**11 + 12345, F.col("size_bytes"))
    assert time.monotonic() - began < 60

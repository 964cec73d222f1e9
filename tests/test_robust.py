"""Names that are no text, patterns that would explode, the store's own files, concurrent publication, progress, requests."""

import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stockroom.functions.linear import Matcher, explosive
from stockroom.operators import audit, hierarchy, search
from stockroom.plans import commands, requests, store
from stockroom.plans.jobs import Cancelled, Jobs


def test_matcher_agrees_with_re():
    rnd = random.Random(0)
    for p in (r"(a|b)*c$", r"(ab?)+c", r"^(\w+/)+x\d{2,3}\b", r"([^/]+/){2}[a-c]*\.txt$", r"(a{1,3}b){2,}", r"(?:x|yz)+?\s", r"(é|ß)+$", r"(.*a){2}b", r"\B(a|b)+\B", r"(a*)*b", r"[^a]+(b|C)*$"):
        m, r = Matcher(p), re.compile(p, re.IGNORECASE)
        texts = ["".join(rnd.choice("abcABCxyz/.t 12_éÉß\n") for _ in range(rnd.randrange(0, 12))) for _ in range(500)]
        assert [m.search(t) for t in texts] == [bool(r.search(t)) for t in texts], p


def test_explosive_patterns_take_linear_time(spark):
    assert explosive("(.*a){10}b$") and not explosive(r"/src1\d?/.*\.(txt|md)$") and not explosive("(abc)+")
    files = spark.createDataFrame([("/" + "a" * 4000 + "c", 1), ("/" + "xA" * 10 + "B", 2), (None, 3)], "path string, size_bytes long")
    began = time.monotonic()
    assert [r["size_bytes"] for r in files.where(search.matches(F.col("path"), "(.*a){10}b$")).collect()] == [2]
    assert time.monotonic() - began < 30
    with pytest.raises(ValueError):
        search.checked_pattern("((a{1,500}){1,500}){1,500}")


def test_names_that_are_no_utf8(spark, tmp_path):
    root = os.fsencode(tmp_path)
    os.makedirs(root + b"/d\xff/deep")
    for name in (b"/d\xff/deep/a\xfe.txt", b"/d\xff/b.txt", b"/plain.txt"):
        with open(root + name, "wb") as f:
            f.write(b"same bytes")
    r = commands.scan_path(spark, str(tmp_path))
    assert (r["filesScanned"], r["errors"], r["duplicateAnalysisComplete"]) == (3, 0, True)
    assert r["duplicates"][0]["copies"] == sorted([f"{tmp_path}/d�/deep/a�.txt", f"{tmp_path}/d�/b.txt", f"{tmp_path}/plain.txt"])


def test_the_store_below_the_root_is_not_indexed(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"1")
    base = f"file://{tmp_path}/store"
    assert [commands.refresh_index(spark, base, str(tmp_path))["files"] for _ in range(2)] == [1, 1]


def test_two_refreshes_do_not_clobber_each_other(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    rows = lambda n: spark.createDataFrame([(f"/r/{i}", "/r", i, 0, 32) for i in range(n)], store.FILES)
    dirs = spark.createDataFrame([("/r", "", 1, 1)], store.DIRECTORIES)
    a, b = s.stage("/r", rows(2), dirs), s.stage("/r", rows(3), dirs)
    assert a != b and s.publish("/r", b).file_count == 3
    with pytest.raises(ValueError):
        s.publish("/r", a)
    assert s.files(s.scope("/r")).count() == 3


def test_many_deltas_are_written_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_OVERLAYS", 3)
    s = store.Store(spark, f"file://{tmp_path}/s")
    dirs = spark.createDataFrame([("/r", "", 1, 1)], store.DIRECTORIES)
    scope = s.publish("/r", s.stage("/r", spark.createDataFrame([(f"/r/{i}", "/r", 0, 0, 32) for i in range(4)], store.FILES), dirs))
    for i in range(4):
        scope = s.overlay(scope, spark.createDataFrame([(f"/r/{i}", "/r", 10 + i, 0, 32)], store.FILES), dirs)
    assert sorted(r["size_bytes"] for r in s.files(s.scope("/r")).collect()) == [10, 11, 12, 13] and len(scope.overlays) == 1 and scope.revision == 5


def test_progress_and_cancel(spark, tmp_path):
    (tmp_path / "secret").write_bytes(b"1")
    events = []
    jobs = Jobs(spark, events.append)
    with jobs.run("job-00001") as job:
        commands.scan_path(spark, str(tmp_path), job=job)
    phases = list(dict.fromkeys(e["phase"] for e in events))
    assert phases == ["scanning", "scanned", "fingerprinting", "fingerprinted", "hashing", "hashed"] and "secret" not in json.dumps(events)
    with pytest.raises(Cancelled), jobs.run("job-00002") as job:
        jobs.cancel("job-00002")
        commands.scan_path(spark, str(tmp_path), job=job)


def test_requests(spark, tmp_path):
    (tmp_path / "f.iso").write_bytes(b"12")
    out = json.loads(requests.run(spark, "search_path", json.dumps({"root": str(tmp_path), "regex": r"\.iso$", "minSizeBytes": 1, "maxFiles": None})))
    assert out["totalMatches"] == 1
    for command, request in (("format_disk", "{}"), ("search_path", "[]"), ("search_path", "{"), ("search_path", '{"root": "/", "colour": 1}')):
        with pytest.raises(ValueError):
            requests.decode(command, request)


def test_enumeration_refuses_what_it_cannot_trust(spark):
    make = lambda *rows: spark.createDataFrame([(*r, False, 1, 32) for r in rows], "id string, parent string, name string, is_directory boolean, size_bytes long, attributes int")
    assert hierarchy.enumerated(make(("a", "r", "x")), "r", "/c").select("path").collect() == [("/c/x",)]
    for bad in ((("a", "r", "x"), ("a", "r", "y")), (("a", "r", ".."),), (("a", "r", "x"), ("b", "gone", "y")), (("a", "b", "x"), ("b", "a", "y"), ("c", "r", "z")), (("a", "r", "x/y"),)):
        with pytest.raises(ValueError):
            hierarchy.enumerated(make(*bad), "r", "/c")
    with pytest.raises(ValueError):
        hierarchy.enumerated(make(("a", "r", "x"), ("b", "r", "y")), "r", "/c", most=1)


def test_a_grant_is_spent_once_and_grows_old(spark):
    rows = [("d", 0, 1, "grant"), ("d", 10, 2, "use"), ("d", 20, 3, "use"), ("d", 30, 4, "grant"), ("d", 331, 5, "use"), ("e", 0, 1, "use")]
    df = spark.createDataFrame(rows, "subject string, s long, seq long, kind string").withColumn("at", F.timestamp_seconds("s"))
    assert sorted(map(tuple, audit.granted(df).collect())) == [("d", 2, True), ("d", 3, False), ("d", 5, False), ("e", 1, False)]


def test_refresh_out_of_an_enumeration(spark, tmp_path):
    root = tmp_path / "r"
    (root / "walked").mkdir(parents=True)
    (root / "walked" / "f").write_bytes(b"12345")
    schema = "id string, parent string, name string, is_directory boolean, size_bytes long, attributes int, modified_ns long"
    sound = spark.createDataFrame([("1", "0", "d", True, 0, 16, 1), ("2", "1", "f", False, 7, 32, 2), ("3", "0", "g", False, 1, 32, 2)], schema)
    base = f"file://{tmp_path}/s"
    got = commands.refresh_index(spark, base, str(root), bulk=(sound, "0"))
    assert (got["indexMethod"], got["files"]) == ("bulk", 2)
    page = commands.browse_index_tree(spark, base, str(root), str(root))
    assert [(n["path"], n["sizeBytes"]) for n in page["nodes"]] == [(f"{root}/d", 7), (f"{root}/g", 1)]
    got = commands.refresh_index(spark, base, str(root), bulk=(sound.unionAll(sound), "0"))
    assert (got["indexMethod"], got["added"], got["removed"]) == ("walk", 1, 2)

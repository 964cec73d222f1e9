"""Walks in rounds, content in ranges, progress and cancelling while a stage runs."""

import hashlib
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from stockroom.config import LIMITS, OFFLINE, REPARSE
from stockroom.plans import commands, jobs
from stockroom.sources import content, tree


def plain_walk(root):
    return sorted(os.path.join(here, n) for here, dirs, files in os.walk(root) for n in (*dirs, *files))


def test_a_lopsided_tree_is_dealt_out_evenly(spark, tmp_path, monkeypatch):
    """99 % of the entries lie below one of 100 directories, along a chain with side branches."""
    monkeypatch.setattr(tree, "FIRST", 50)
    monkeypatch.setattr(tree, "MOST", 150)
    for i in range(100):
        (tmp_path / f"d{i}").mkdir()
    heavy = tmp_path / "d42"
    for i in range(40):
        for j in range(10):
            (heavy / f"s{i}" / f"t{j}").mkdir(parents=True)
            for k in range(9):
                (heavy / f"s{i}" / f"t{j}" / f"f{k}").touch()
    df = tree.read(spark, str(tmp_path))
    assert sorted(r["path"] for r in df.select("path").collect()) == plain_walk(tmp_path)
    tasks = [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]
    assert len(tasks) >= 16 and max(tasks) <= 150 + 100 + 40  # a task overshoots by one directory at most


def test_a_chain_is_walked_in_few_rounds(spark, tmp_path, monkeypatch):
    here, rounds = tmp_path, []
    for i in range(200):
        here = here / "d"
    here.mkdir(parents=True)
    save = tree.scratch.save
    monkeypatch.setattr(tree.scratch, "save", lambda df, name: (rounds.append(name), save(df, name))[1])
    assert tree.read(spark, str(tmp_path)).count() == 200 and len(rounds) == 1
    assert tree.read(spark, str(tmp_path), depth="1").count() == 1


def deep(base):
    """Directories that go on below the longest path that can be opened."""
    before = os.getcwd()
    try:
        os.chdir(base)
        for _ in range(20):
            os.mkdir("n" * 240)
            os.chdir("n" * 240)
    finally:
        os.chdir(before)


def marks(bit):
    def attributes(path, s):
        return bit if os.path.basename(path) == "closed" else 0x20

    return attributes


def test_nothing_below_a_closed_directory_is_opened_or_counted(spark, tmp_path):
    (tmp_path / "closed/sub").mkdir(parents=True)
    (tmp_path / "closed/sub/f").touch()
    (tmp_path / "g").touch()
    deep(tmp_path / "closed")
    every = tree.read(spark, str(tmp_path))
    assert every.where("error is not null").count() >= 1
    for bit in (OFFLINE, REPARSE):
        some = tree.read(spark, str(tmp_path), attributes=marks(bit))
        assert sorted(r["path"] for r in some.collect()) == [f"{tmp_path}/closed", f"{tmp_path}/g"]
    assert tree.read(spark, str(tmp_path), closed=REPARSE, attributes=marks(OFFLINE)).where("error is not null").count() >= 1


def test_an_index_is_refused_for_errors_in_open_directories_only(spark, tmp_path, monkeypatch):
    (tmp_path / "r/closed").mkdir(parents=True)
    (tmp_path / "r/f").write_bytes(b"1")
    deep(tmp_path / "r/closed")
    base, root = f"file://{tmp_path}/s", str(tmp_path / "r")
    with pytest.raises(OSError):
        commands.refresh_index(spark, base, root)
    read = tree.read
    monkeypatch.setattr(tree, "read", lambda *a, **k: read(*a, **{**k, "attributes": marks(REPARSE)}))
    got = commands.refresh_index(spark, base, root)
    assert (got["files"], got["skippedDirectories"]) == (1, 1)
    got = commands.scan_path(spark, root)
    assert (got["errors"], got["skippedContentFiles"], got["duplicateAnalysisComplete"]) == (0, 1, False)


def inventory(spark, *paths):
    rows = [(str(p), s.st_size, s.st_mtime_ns) for p in paths for s in [os.stat(p)]]
    return spark.createDataFrame(rows, "path string, size_bytes long, modified_ns long")


def test_ranges_keep_equality_classes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(content.LIMITS.__class__, "hash_chunk", 1000)
    object.__setattr__(LIMITS, "hash_chunk", 1000)
    try:
        data = os.urandom(5300)
        texts = {"a": data, "b": data, "last": data[:-1] + b"x", "first": b"x" + data[1:], "swapped": data[1000:2000] + data[:1000] + data[2000:], "small": data[:1000], "small2": data[:1000], "none": b"", "edge": data[:1001]}
        for n, d in texts.items():
            (tmp_path / n).write_bytes(d)
        got = {r["path"].rsplit("/")[-1]: r for r in content.digests(inventory(spark, *(tmp_path / n for n in texts)), False, "hash").collect()}
        assert {n: (r["status"], r["bytes_read"]) for n, r in got.items()} == {n: ("ok", len(d)) for n, d in texts.items()}
        assert {(m, n) for m in texts for n in texts if got[m]["hash"] == got[n]["hash"]} == {(m, n) for m in texts for n in texts if texts[m] == texts[n]}
        assert got["small"]["hash"] == hashlib.sha256(data[:1000]).hexdigest()
        gone = inventory(spark, tmp_path / "a", tmp_path / "b", tmp_path / "last").withColumn("note", F.lit("x"))
        os.remove(tmp_path / "a")
        (tmp_path / "b").write_bytes(data + b"more")
        got = {r["path"].rsplit("/")[-1]: r for r in content.digests(gone, False, "hash").collect()}
        assert {n: (r["status"], r["bytes_read"], r["hash"] is None, r["note"]) for n, r in got.items()} == {"a": ("error", 0, True, "x"), "b": ("changed", 0, True, "x"), "last": ("ok", 5300, False, "x")}
    finally:
        object.__setattr__(LIMITS, "hash_chunk", 4 << 20)


def test_no_byte_beyond_the_measured_size_is_read(tmp_path, monkeypatch):
    (tmp_path / "f").write_bytes(b"x" * 5000)
    facts = (0, 3000, 7)
    monkeypatch.setattr(content, "_facts", lambda p: facts)
    assert content.digest(str(tmp_path / "f"), 3000, 7, False) == (hashlib.sha256(b"x" * 3000).hexdigest(), "ok", 3000)
    assert content.digest(str(tmp_path / "f"), 3000, 7, False, 2000, 4000)[2] == 1000
    facts = (0, 6000, 7)
    assert content.digest(str(tmp_path / "f"), 6000, 7, False) == (None, "changed", 5000)


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "big", "wb") as f:
        f.truncate(1 << 30)
    files = inventory(spark, tmp_path / "big")
    assert content._dealt(files.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(255)))), F.lit(4 << 20), ["path", F.floor(F.col("r") / 16)]).groupBy(F.spark_partition_id()).count().count() >= 8
    assert [(r["status"], r["bytes_read"]) for r in content.digests(files, False, "hash").collect()] == [("ok", 1 << 30)]


def test_cancelling_within_hashing_stops_it(spark, tmp_path):
    """Two equal files so large that hashing them takes a while; the job is cancelled when the first bytes are told of."""
    for n in "ab":
        with open(tmp_path / n, "wb") as f:
            f.truncate(24 << 30)
    times, events = [], []
    seen = threading.Event()

    def listen(event):
        events.append(event)
        times.append(time.monotonic())
        if event["phase"] == "hashing" and event["bytesRead"]:
            seen.set()

    registry, failed = jobs.Jobs(spark, listen), []

    def work():
        try:
            with registry.run("job-00000009") as job:
                commands.scan_path(spark, str(tmp_path), hash_budget="unlimited", job=job)
        except jobs.Cancelled as e:
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    assert seen.wait(120)
    began = time.monotonic()
    assert registry.cancel("job-00000009")
    thread.join(30)
    assert failed and time.monotonic() - began < 15
    hashing = [t for t, e in zip(times, events, strict=True) if e["phase"] == "hashing"]
    assert all(b - a >= 0.24 for a, b in zip(hashing[1:], hashing[2:], strict=False))
    assert events[-1]["bytesRead"] < 48 << 30


def test_pausing_within_a_walk_stops_it_between_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "FIRST", 1)
    monkeypatch.setattr(tree, "MOST", 1)
    (tmp_path / "a/b/c/d/e/f").mkdir(parents=True)
    registry, rounds, save = jobs.Jobs(spark), [], tree.scratch.save

    def told(df, name):
        rounds.append(name)
        if len(rounds) == 2:
            registry.pause("job-00000010")
        return save(df, name)

    monkeypatch.setattr(tree.scratch, "save", told)
    done = []

    def work():
        with registry.run("job-00000010") as job:
            done.append(commands.scan_path(spark, str(tmp_path), analyze_duplicates=False, job=job)["directoriesScanned"])

    thread = threading.Thread(target=work)
    thread.start()
    while len(rounds) < 2:
        time.sleep(0.05)
    time.sleep(3)
    assert len(rounds) == 2 and not done
    assert registry.resume("job-00000010")
    thread.join(60)
    assert done == [6] and len(rounds) >= 6


def test_a_directory_is_listed_as_it_is_read(tmp_path, monkeypatch):
    """Entries come before the last one is read, and directories behind the bound are left at once."""
    for i in range(20):
        (tmp_path / f"d{i}").mkdir()
    read, real = [], os.scandir

    class Counted:
        def __init__(self, path):
            self.entries = real(path)

        def __enter__(self):
            return self

        def __exit__(self, *args):
            self.entries.close()

        def __iter__(self):
            for e in self.entries:
                read.append(e.name)
                yield e

    monkeypatch.setattr(tree.os, "scandir", Counted)
    rows = tree.walk(iter([str(tmp_path)]), 5)
    next(rows)
    assert len(read) == 1
    rest = list(rows)
    assert sum(r[1] == "directory" for r in rest) == 19 and sum(r[1] == tree.LEFT for r in rest) == 20

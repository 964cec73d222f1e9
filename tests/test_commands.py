"""Commands over real directories."""

import os
import struct
import threading

import pytest

from stockroom.operators import journal
from stockroom.plans import commands, jobs, store
from stockroom.sources import records
from stockroom.streaming import journal as stream


def write(base, **files):
    for name, data in files.items():
        p = base / name.replace("__", "/")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def test_duplicates_and_pattern(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n, d in (("a.txt", b"0123456789abcdef"), ("sub/b.txt", b"0123456789abcdef"), ("other.log", b"something else")):
        (tmp_path / n).write_bytes(d)
    r = commands.scan_path(spark, str(tmp_path), r".*\.txt$", 1)
    assert (r["filesScanned"], r["totalMatches"], len(r["duplicates"]), len(r["duplicates"][0]["copies"])) == (3, 2, 1, 2)
    assert r["duplicateAnalysisComplete"] and r["directoriesScanned"] == 1


def test_hard_links_save_nothing(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 14)
    os.link(tmp_path / "a", tmp_path / "b")
    r = commands.scan_path(spark, str(tmp_path))
    assert (r["hardlinkAliases"], r["duplicates"], r["potentialSavingsBytes"], r["duplicateAnalysisComplete"]) == (1, [], 0, True)
    (tmp_path / "c").write_bytes(b"x" * 14)
    r = commands.scan_path(spark, str(tmp_path))
    assert (r["hardlinkAliases"], len(r["duplicates"]), r["potentialSavingsBytes"]) == (1, 1, 14)


@pytest.mark.parametrize("at, edge, full", [(0, 65536, 0), (32768, 65536, 131072), (49152, 65536, 0)])
def test_stages_read_no_more_than_they_need(spark, tmp_path, at, edge, full):
    data = bytearray(65536)
    (tmp_path / "a").write_bytes(data)
    data[at] = 1
    (tmp_path / "b").write_bytes(data)
    r = commands.scan_path(spark, str(tmp_path))
    assert (r["fingerprintBytesRead"], r["fullHashBytesRead"], r["duplicates"]) == (edge, full, [])


def test_stage_bytes_of_equal_files_and_empty_files(spark, tmp_path):
    for n in ("a", ".hidden"):
        (tmp_path / n).write_bytes(b"z" * 150_000)
    for n in ("_e1", "e2"):
        (tmp_path / n).write_bytes(b"")
    r = commands.scan_path(spark, str(tmp_path))
    assert (r["filesScanned"], r["fingerprintBytesRead"], r["fullHashBytesRead"], len(r["duplicates"])) == (4, 65536, 300_000, 1)


def test_metadata_only_and_bounds(spark, tmp_path):
    for i in range(1, 331):
        (tmp_path / f"f{i}").write_bytes(b"x" * i)
    r = commands.scan_path(spark, str(tmp_path), analyze_duplicates=False)
    assert [f["sizeBytes"] for f in (r["topFiles"][0], r["topFiles"][-1])] == [330, 31]
    assert (len(r["topFiles"]), len(r["matches"]), r["totalMatches"], r["hashingSkipped"], r["hashReadBudgetBytes"]) == (300, 330, 330, True, None)
    r = commands.scan_path(spark, str(tmp_path), max_files=3, analyze_duplicates=False)
    assert (r["filesScanned"], r["truncated"]) == (3, True)
    with pytest.raises(ValueError):
        commands.scan_path(spark, str(tmp_path), max_files=0)
    with pytest.raises(ValueError):
        commands.scan_path(spark, str(tmp_path), hash_budget="endless")


def test_search(spark, tmp_path):
    for n, s in (("big.iso", 80), ("small.iso", 10), ("other.txt", 100)):
        (tmp_path / n).write_bytes(b"x" * s)
    os.symlink(tmp_path / "big.iso", tmp_path / "link.iso")
    r = commands.search_path(spark, str(tmp_path), "iso$", 20)
    assert (r["filesScanned"], r["totalMatches"], r["matches"][0]["name"]) == (3, 1, "big.iso")


def test_compare(spark, tmp_path):
    write(tmp_path, ref__a=b"123456789", cand__b=b"123456789", cand__c=b"123456789", cand__d=b"987654321")
    r = commands.compare_folders(spark, str(tmp_path / "ref"), str(tmp_path / "cand"))
    assert (r["matchedCandidates"], r["potentialLogicalSavingsBytes"], r["complete"], r["hashBytesRead"]) == (2, 18, True, 36)
    os.link(tmp_path / "ref/a", tmp_path / "cand/link")
    r = commands.compare_folders(spark, str(tmp_path / "ref"), str(tmp_path / "cand"))
    assert (r["matchedCandidates"], r["hardlinkAliases"]) == (2, 1)
    with pytest.raises(ValueError):
        commands.compare_folders(spark, str(tmp_path), str(tmp_path / "ref"))


def test_index(spark, tmp_path):
    base, root = f"file://{tmp_path}/store", str(tmp_path / "data")
    assert commands.list_indexed_scopes(spark, base) == [] and not (tmp_path / "store").exists()
    write(tmp_path, data__sub__a=b"1234", data__file=b"123")
    os.mkdir(tmp_path / "data/empty")
    r = commands.refresh_index(spark, base, root, watermark={"next": 1})
    assert (r["added"], r["changed"], r["unchanged"], r["removed"], r["batchesWritten"], r["indexMethod"]) == (2, 0, 0, 0, 1, "walk")
    assert commands.refresh_index(spark, base, root, watermark={"next": 1})["indexMethod"] == "unchanged"
    page = commands.browse_index_tree(spark, base, root, root)
    assert [(n["name"], n["kind"], n["sizeBytes"], n["files"]) for n in page["nodes"]] == [("sub", "directory", 4, 1), ("empty", "directory", 0, 0), ("file", "file", 3, 1)]
    small = commands.browse_index_tree(spark, base, root, root, limit=1)
    rest = commands.browse_index_tree(spark, base, root, root, small["nextCursor"], 5, small["generation"])
    assert [n["name"] for n in rest["nodes"]] == ["empty", "file"] and rest["nextCursor"] is None
    with pytest.raises(ValueError):
        commands.browse_index_tree(spark, base, root, "/etc")
    with pytest.raises(ValueError):
        commands.browse_index_tree(spark, base, root, f"{root}/sub", small["nextCursor"])

    commands.apply_changes(spark, base, root, [(f"{root}/sub/a", 9)])
    after = commands.browse_index_tree(spark, base, root, root)
    assert [n["sizeBytes"] for n in after["nodes"]] == [9, 0, 3]
    with pytest.raises(ValueError):
        commands.browse_index_tree(spark, base, root, root, generation=page["generation"])
    with pytest.raises(ValueError):
        commands.apply_changes(spark, base, root, [(f"{root}/file", 5), (f"{root}/unknown", 1)])
    assert commands.browse_index_tree(spark, base, root, root)["nodes"] == after["nodes"]

    (tmp_path / "data/file").write_bytes(b"12345")
    (tmp_path / "data/sub/a").unlink()
    r = commands.refresh_index(spark, base, root)
    assert (r["changed"], r["removed"], r["files"]) == (1, 1, 1)
    assert commands.search_index(spark, base, root, "file$", 1)["report"]["totalMatches"] == 1
    with pytest.raises(ValueError):
        commands.refresh_index(spark, base, root, max_files=0)
    assert [s["files"] for s in commands.list_indexed_scopes(spark, base)] == [1]


def test_cancel_publishes_nothing(spark, tmp_path):
    base, root = f"file://{tmp_path}/store", str(tmp_path / "data")
    write(tmp_path, data__a=b"1")
    commands.refresh_index(spark, base, root)
    write(tmp_path, data__b=b"2")
    registry = jobs.Jobs()
    with registry.run("job-00000001") as job, pytest.raises(jobs.Cancelled):
        assert registry.cancel("job-00000001") and not registry.cancel("job-00000002")
        commands.refresh_index(spark, base, root, job=job)
    assert store.Store(spark, base).scope(root).file_count == 1


def test_jobs():
    registry = jobs.Jobs()
    with pytest.raises(ValueError), registry.run("x"):
        pass
    with registry.run("job-00000001") as job:
        with pytest.raises(RuntimeError), registry.run("job-00000002"):
            pass
        assert registry.pause(job.id)
        done = threading.Thread(target=job.check)
        done.start()
        assert done.is_alive() and registry.resume(job.id)
        done.join(2)
        assert not done.is_alive()


def test_allocation(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 8192)
    r = commands.measure_allocated_sizes(spark, str(tmp_path), [(str(tmp_path / "a"), 8192), (str(tmp_path / "a2"), 1), ("/etc/hostname", 1)])
    assert {i["path"].rsplit("/")[-1]: i["status"] for i in r["items"]}["a"] == "measured" and r["measured"] == 1
    with pytest.raises(ValueError):
        commands.measure_allocated_sizes(spark, str(tmp_path), [("/x", 1)] * 301)


def test_records(spark):
    name = "é.txt".encode("utf-16-le")
    raw = struct.pack("<IHHQQqqIIIIHH", 60 + len(name), 2, 0, 2**63 + 5, 9, 77, 0, 0x80000002, 0, 0, 0x20, len(name), 60) + name
    got = records.records(spark.createDataFrame([(bytearray(raw),)], "record binary")).first()
    assert (got["usn"], got["file_id"], got["parent_id"], got["reason"], got["attributes"], got["name"]) == (77, "8000000000000005", "0000000000000009", 0x80000002, 0x20, "é.txt")
    for bad in (b"", b"1234567", raw[:4] + b"\x03" + raw[5:], raw[:-2]):
        assert records.decode(bad) is None


def test_health(spark):
    line = '{"drive":"C","healthStatus":"Healthy","sizeBytes":1000}'
    df = spark.createDataFrame([(line,)], "value string")
    got = records.health(df, "c").first()
    assert (got["drive"], got["sizeBytes"], got["temperatureCelsius"]) == ("C", 1000, None)
    with pytest.raises(Exception, match="another drive"):
        records.health(df, "D").collect()


def test_stream_equals_batch_and_maintains_totals(spark, tmp_path):
    rows = [(i, i % 3, 0x2 if i % 2 else 0x80000000, 10 * i) for i in range(1, 20)]
    df = spark.createDataFrame(rows, stream.RECORDS)
    assert sorted(map(tuple, stream.latest_by_stream(df).collect())) == sorted(map(tuple, journal.latest(df).collect()))

    sizes, totals = {f"/r/f{i}": 1 for i in range(3)}, []
    files = lambda: spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(sizes.items())], "file_id long, path string, size_bytes long")

    def publish(changes, batch):
        for r in changes.collect():
            sizes[r["path"]] = r["size_bytes"]
        totals.append(sum(sizes.values()))

    df.repartitionByRange(3, "usn").write.parquet(str(tmp_path / "in"))
    stream.maintain(stream.source(spark, str(tmp_path / "in")), files, publish, str(tmp_path / "state")).awaitTermination()
    # each batch is applied to what the one before published; files come in any order, and a late record never undoes a later one
    last = {f"/r/f{r['file_id']}": r["size_bytes"] for r in journal.latest(df).collect()}
    assert 1 <= len(totals) <= 3 and set(last) <= set(sizes) and totals[-1] == sum(sizes.values())
    assert {p: sizes[p] for p in last} == last


def test_refresh_takes_the_cheapest_way(spark, tmp_path):
    base, root = f"file://{tmp_path}/store", str(tmp_path / "data")
    write(tmp_path, data__sub__a=b"1234", data__file=b"123")
    mark = lambda n: journal.Watermark(7, 1, n, 55, "500")
    records_ = spark.createDataFrame([(10, 1, 0x80000000, 4), (20, 1, 0x2, 9), (30, 2, 0x100, 3), (40, 9, 0x2, 1)], stream.RECORDS)
    ids = spark.createDataFrame([(1, f"{root}/sub/a"), (2, f"{root}/file")], "file_id long, path string")
    go = lambda n: commands.refresh_from_journal(spark, base, root, mark(n), records_, ids)
    assert go(5)["indexMethod"] == "walk"
    assert go(15)["indexMethod"] == "unchanged"
    r = go(25)
    assert (r["indexMethod"], r["changed"]) == ("delta", 1)
    assert commands.browse_index_tree(spark, base, root, root)["nodes"][0]["sizeBytes"] == 9
    assert go(35)["indexMethod"] == "walk"
    assert go(45)["indexMethod"] == "walk"
    assert go(44)["indexMethod"] == "walk"


def test_progress(spark):
    df, seen = commands.quick_progress(spark.createDataFrame([("/a", 3), ("/b", 4)], "path string, size_bytes long"))
    df.collect()
    assert seen.get == {"files_scanned": 2, "logical_bytes": 7}


def test_compared_trees_are_whole(spark, tmp_path, monkeypatch):
    """Of no tree a part is taken unless asked for."""
    taken, sample = [], commands.search.sample
    monkeypatch.setattr(commands.search, "sample", lambda files, most: (taken.append(most), sample(files, most))[1])
    write(tmp_path, ref__a=b"123", cand__b=b"123")
    assert commands.compare_folders(spark, str(tmp_path / "ref"), str(tmp_path / "cand"))["complete"] and taken == [None, None]


def test_a_delta_of_many_files(spark, tmp_path):
    """A delta may have any number of files."""
    root, base, n = str(tmp_path / "data"), f"file://{tmp_path}/store", 2100
    os.mkdir(root)
    for i in range(n):
        (tmp_path / f"data/f{i:04}").write_bytes(b"same")
    mark = lambda n: journal.Watermark(7, 1, n, 55, "500")
    records_ = spark.createDataFrame([(i + 10, i, 0x2, 9) for i in range(n)], stream.RECORDS)
    ids = spark.createDataFrame([(i, f"{root}/f{i:04}") for i in range(n)], "file_id long, path string")
    commands.refresh_from_journal(spark, base, root, mark(5), records_, ids)
    r = commands.refresh_from_journal(spark, base, root, mark(n + 20), records_, ids)
    assert (r["indexMethod"], r["changed"], r["unchanged"]) == ("delta", n, 0)
    assert commands.search_index(spark, base, root, None, 9)["report"]["totalMatches"] == n


def test_savings_of_a_large_group_count(spark, tmp_path):
    """A group of more copies than are listed counts, and is complete."""
    root, n = str(tmp_path / "data"), 2100
    os.mkdir(root)
    for i in range(n):
        (tmp_path / f"data/f{i:04}").write_bytes(b"same")
    r = commands.scan_path(spark, root)
    assert (r["potentialSavingsBytes"], r["duplicateAnalysisComplete"], len(r["duplicates"])) == (4 * (n - 1), True, 1)
    d = r["duplicates"][0]
    assert (d["independentCopies"], d["potentialSavingsBytes"], d["copies"]) == (n, 4 * (n - 1), [f"{root}/f{i:04}" for i in range(1024)])

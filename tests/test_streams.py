"""Journals as streams: segments by usn, keyed state, grants with a time to live, restarts."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.operators import audit, journal
from stockroom.sources import records, segments
from stockroom.streaming import journal as stream

ROWS = "usn long, file_id long, parent_id long, reason long, attributes long, name string"


def rows(spark, first, last):
    return spark.createDataFrame([(i, 2**62 + i, i % 5, 2 if i % 3 else 0x80000000, 32, ["a.txt", "é漢", "😀x", ""][i % 4]) for i in range(first, last)], ROWS)


def test_decoding_by_columns_is_decoding_by_record(spark):
    rng = np.random.default_rng(3)
    names = ["", "a", "é", "漢字", "😀", "x😀y", "b" * 255]
    made = []
    for i in range(300):
        name = names[rng.integers(len(names))].encode("utf-16-le") if i % 9 else b"\x00\xd8a\x00\x01\xdc"  # halves of pairs that stand alone
        at = 60 + 4 * int(rng.integers(0, 3))
        made.append(struct.pack("<IHHQQqqIIIIHH", at + len(name), 2, 0, int(rng.integers(0, 2**63)) * 2, i, i - 5, 0, int(rng.integers(0, 2**32)), 0, 0, 0x20, len(name), at) + bytes(at - 60) + name)

    def plain(r):
        f = struct.unpack_from("<IHHQQqqIIIIHH", r)
        return (f[5], f"{f[3]:016x}", f"{f[4]:016x}", f[7], f[10], r[f[12] : f[12] + f[11]].decode("utf-16-le", "replace"))

    got = records.records(spark.createDataFrame([(bytearray(r),) for r in made], "record binary").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(plain, made))
    with pytest.raises(Exception, match="malformed"):
        records.records(spark.createDataFrame([(bytearray(made[1]),), (None,)], "record binary")).collect()


def out(spark, base):
    return sorted(r["usn"] for r in spark.read.parquet(f"{base}/out").collect())


def test_batches_are_bounded_and_restarts_lose_and_repeat_nothing(spark, tmp_path):
    base, folder = f"file://{tmp_path}", str(tmp_path / "seg")
    go = lambda most=30: stream.follow(spark, folder, f"{base}/out", f"{base}/state", most)
    segments.capture(rows(spark, 0, 100), folder, 10)
    go()
    assert out(spark, base) == list(range(100))
    assert sorted(len(spark.read.parquet(f"{base}/out/{b}").collect()) for b in os.listdir(tmp_path / "out")) == [10, 30, 30, 30]
    segments.capture(rows(spark, 100, 175), folder, 10)
    go()
    assert out(spark, base) == list(range(175))
    # a batch whose commit was lost runs again, and replaces what it wrote
    last = max(map(int, os.listdir(tmp_path / "state/stream/commits") and [n for n in os.listdir(tmp_path / "state/stream/commits") if n.isdigit()]))
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "state/stream/commits" / name).unlink()
    segments.capture(rows(spark, 180, 200), folder, 10)
    with pytest.raises(Exception, match="no records from 180"):  # the segment of 170 reaches to 180; the next one is missing when its file goes
        os.remove(next(p for *_, p in segments.listed(folder) if "-00000000000000000190-" in p and "/00000000000000000180" in p))
        go()


def test_a_journal_that_breaks_is_an_error(tmp_path):
    s = lambda *spans: [(a, b, n, "") for a, b, n in spans]
    assert [x[:2] for x in segments.followed(s((0, 5, 3), (5, 9, 3), (9, 12, 3)), 2, 6)] == [(2, 5), (5, 9)]
    for bad in (s((0, 5, 1), (6, 9, 1)), s((0, 5, 1), (5, 5, 0)), s((0, 5, 7))):
        with pytest.raises(segments.Broken):
            segments.followed(bad, 0, 6)
    assert segments.followed(s((0, 5, 3)), 5, 6) == []


def test_segments_that_lie_are_refused(spark, tmp_path):
    folder = str(tmp_path)
    segments.capture(rows(spark, 0, 8), folder, 10)
    (start, after, count, path), = segments.listed(folder)
    assert segments.read_segment(path, 3, after, count).column("usn").to_pylist() == [3, 4, 5, 6, 7]
    raw = open(path, "rb").read()
    for bad in (raw[:-40], raw[:4], raw[:12] + b"\x03" + raw[13:], b"\x09" + raw[1:], raw[:8] + raw[8 + int.from_bytes(raw[8:12], "little") :]):
        open(path, "wb").write(bad)
        with pytest.raises((segments.Broken, records.Malformed)):
            segments.read_segment(path, 0, after, count)


def test_state_tells_of_changes_only(spark, tmp_path):
    base = f"file://{tmp_path}"
    parts = [[(1, 7, 2, 10), (2, 8, 2, 5), (3, 7, 2, 12)], [(9, 7, 2, 4), (4, 8, 0x80000000, 99), (None, 8, 2, 1), (5, None, 2, 1)], [(6, 7, 2, 77), (10, 8, 2, None)], [(11, 8, 4, 6)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, stream.RECORDS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if i != 1:  # started again each time, once with two parts waiting
            stream.append(stream.changes_of(stream.source(spark, f"{base}/in")), f"{base}/out", f"{base}/state", "update").awaitTermination()
    told = sorted(map(tuple, spark.read.schema(stream.CHANGES).parquet(f"{base}/out/batch=*").collect()))
    assert told == sorted([(7, 3, 2, 12, 12), (8, 2, 2, 5, 5), (7, 9, 2, 4, -8), (8, 10, 2, None, None), (8, 11, 4, 6, 6)], key=repr) or sorted(told, key=repr) == sorted([(7, 3, 2, 12, 12), (8, 2, 2, 5, 5), (7, 9, 2, 4, -8), (8, 10, 2, None, None), (8, 11, 4, 6, 6)], key=repr)


def test_grants_are_spent_once_and_expire_behind_a_restart(spark, tmp_path):
    base, schema = f"file://{tmp_path}", "subject string, s long, seq long, kind string"
    parts = [[("a", 0, 1, "grant"), ("b", 0, 2, "grant"), ("c", 5, 3, "use")], [("a", 100, 4, "use"), ("a", 101, 5, "use"), ("c", 102, 6, "grant")], [("b", 400, 7, "use"), ("c", 402, 8, "use"), ("d", 402, 9, "grant"), ("d", 402, 10, "grant")], [("d", 700, 11, "use"), ("d", 703, 12, "use"), ("c", 9000, 13, "use")]]
    every = None
    for p in parts:
        df = spark.createDataFrame(p, schema).select("subject", F.timestamp_seconds(F.col("s") + 1000).alias("at"), "seq", "kind")
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
        every = df if every is None else every.unionByName(df)
        stream.append(stream.grants_of(stream.source(spark, f"{base}/in", schema=df.schema)), f"{base}/out", f"{base}/state").awaitTermination()
    told = sorted(map(tuple, spark.read.schema(stream.GRANTED).parquet(f"{base}/out/batch=*").collect()))
    assert told == sorted(map(tuple, audit.granted(every).collect()))
    assert [(s, g) for s, _, g in told] == [("a", True), ("a", False), ("b", False), ("c", False), ("c", True), ("c", False), ("d", True), ("d", False)]


def test_latest_by_stream_is_latest(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 7, 2 if i % 2 else 0x80000000, i) for i in range(101)], stream.RECORDS)
    assert sorted(map(tuple, stream.latest_by_stream(df).collect())) == sorted(map(tuple, journal.latest(df).collect()))


def test_the_position_is_written_before_a_batch_runs(tmp_path):
    reader = segments._Reader({"path": str(tmp_path), "position": str(tmp_path / "p/at.json"), "maxRecords": "5"})
    (tmp_path / f"{0:020}-{4:020}-4.usn").write_bytes(b"")
    (tmp_path / f"{4:020}-{8:020}-4.usn").write_bytes(b"")
    assert reader.latestOffset() == {"usn": 4} and not (tmp_path / "p").exists()
    assert [(p.at, p.after) for p in reader.partitions({"usn": 0}, {"usn": 4})] == [(0, 4)]
    assert json.loads((tmp_path / "p/at.json").read_text()) == {"usn": 4}
    assert segments._Reader({"path": str(tmp_path), "position": str(tmp_path / "p/at.json")}).latestOffset() == {"usn": 8}

"""Scalar functions, on single values."""

import pytest
from pyspark.sql import functions as F

from stockroom.config import NO_EXTENSION
from stockroom.functions import display, paths


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("path, want", [("/a/b.TXT", "txt"), ("/a/.bashrc", NO_EXTENSION), ("/a/x.", NO_EXTENSION), ("/a/b.tar.gz", "gz"), ("/a.b/c", NO_EXTENSION), ("/a/É.É", "É")])
def test_extension(spark, path, want):
    assert value(spark, paths.extension(F.lit(path))) == want


def test_names_and_parents(spark):
    assert value(spark, paths.name(F.lit("/a/b/c.txt"))) == "c.txt"
    assert value(spark, paths.name(F.lit("/"))) == "/"
    assert value(spark, paths.parent(F.lit("/a/b/c.txt"))) == "/a/b"


def test_ancestors(spark):
    assert value(spark, paths.ancestors(F.lit("/r/a/b/f"), "/r")) == ["/r", "/r/a", "/r/a/b"]
    assert value(spark, paths.ancestors(F.lit("/r/f"), "/r")) == ["/r"]
    assert value(spark, paths.ancestors(F.lit("/r"), "/r")) == []
    assert value(spark, paths.ancestors(F.lit("/r/s/a/f"), "/r/s")) == ["/r/s", "/r/s/a"]


def test_containment_is_by_components(spark):
    assert value(spark, paths.is_under(F.lit("/a/b/c"), "/a/b"))
    assert not value(spark, paths.is_under(F.lit("/a/bc"), "/a/b"))


@pytest.mark.parametrize("bits, want", [(0x20, "local"), (0x400, "reparse"), (0x1000, "offline"), (0x1400, "offline"), (0x40000, "offline"), (0x400000, "offline")])
def test_content_status(spark, bits, want):
    assert value(spark, paths.content_status(F.lit(bits).cast("long"))) == want


def test_arithmetic_never_wraps(spark):
    big = F.lit(paths.LONGEST)
    assert value(spark, paths.add_capped(big, F.lit(1))) == paths.LONGEST
    assert value(spark, paths.multiply_capped(big, F.lit(2))) == paths.LONGEST
    assert value(spark, paths.subtract_floored(F.lit(1).cast("long"), F.lit(2).cast("long"))) == 0
    with pytest.raises(Exception, match="out of range"):
        value(spark, paths.add_checked(F.lit(1).cast("long"), F.lit(-2).cast("long")))


@pytest.mark.parametrize("n", [0, 1, 255, 2**40 + 7, -1, -(2**63)])
def test_hex_ids_go_and_come(spark, n):
    h = value(spark, paths.hex_id(F.lit(n).cast("long")))
    assert len(h) == 16 and value(spark, paths.from_hex_id(F.lit(h))) == n


def test_small_validators(spark):
    assert value(spark, paths.drive_letter(F.lit(" c: "))) == "C"
    assert value(spark, paths.drive_letter(F.lit("cd:"))) is None
    assert value(spark, paths.valid_job_id(F.lit("abcd-1234"))) and not value(spark, paths.valid_job_id(F.lit("short")))
    assert value(spark, paths.valid_uuid(F.lit("0f8fad5b-d9cb-469f-a165-70867728950e"))) and not value(spark, paths.valid_uuid(F.lit("../../etc")))
    assert value(spark, paths.relevant_reason(F.lit(0x80000001).cast("long"))) and not value(spark, paths.relevant_reason(F.lit(0x80000000).cast("long")))


@pytest.mark.parametrize("n, want", [(0, "0 B"), (-5, "0 B"), (512, "512 B"), (1024, "1 KB"), (1536, "1,5 KB"), (5 << 30, "5 GB"), (3 << 60, "3.072 PB")])
def test_bytes_text(spark, n, want):
    assert value(spark, display.bytes_text(F.lit(n).cast("long"))) == want


def test_other_display(spark):
    assert value(spark, display.number_text(F.lit(1234567))) == "1.234.567"
    assert value(spark, display.duration_text(F.lit(1500))) == "1,5 s"
    assert value(spark, display.duration_text(F.lit(900))) == "900 ms"
    assert value(spark, display.path_text(F.lit("x" * 81))) == "…" + "x" * 79
    assert value(spark, display.throughput(F.lit(2 << 20), F.lit(1000))) == 2.0
    assert value(spark, display.throughput(F.lit(0), F.lit(1000))) is None
    assert value(spark, display.share(F.lit(1), F.lit(0))) == 0.0
    assert display.megabytes(1.5) == 1572864
    with pytest.raises(ValueError):
        display.megabytes(float("nan"))

"""Column expressions that format values for people: base-1024 sizes, decimal comma, thousands dot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _local(x: Column) -> Column:
    return F.translate(x, ",.", ".,")


def _one_digit(x: Column) -> Column:
    """At most one digit behind the comma, none if it is 0."""
    r = F.round(x, 1)
    return F.when(r == F.floor(r), _local(F.format_number(r, 0))).otherwise(_local(F.format_number(r, 1)))


def bytes_text(n: Column) -> Column:
    n = n.cast("double")
    power = F.least(F.floor(F.log2(n) / 10), F.lit(len(UNITS) - 1)).cast("int")
    value = n / F.pow(F.lit(1024.0), power)
    unit = F.element_at(F.array(*map(F.lit, UNITS)), power + 1)
    return F.when(n.isNull() | F.isnan(n) | (n <= 0) | (n == float("inf")), "0 B").otherwise(F.concat(_one_digit(value), F.lit(" "), unit))


def number_text(n: Column) -> Column:
    return _local(F.format_number(n.cast("long"), 0))


def duration_text(ms: Column) -> Column:
    """Seconds with one digit, without groups, or milliseconds below one second. A half of a tenth goes up where the seconds are one exactly, else as their double lies."""
    text = F.when(ms % 1000 == 250, F.concat(F.floor(ms / 1000).cast("string"), F.lit(",3"))).otherwise(F.translate(F.format_number(ms / 1000, 1), ".,", ","))
    return F.when(ms >= 1000, F.concat(text, F.lit(" s"))).otherwise(F.concat(ms.cast("string"), F.lit(" ms")))


def path_text(path: Column, most: int = 80) -> Column:
    return F.when(F.length(path) > most, F.concat(F.lit("…"), F.right(path, F.lit(most - 1)))).otherwise(path)


def share(part: Column, whole: Column) -> Column:
    """Percent; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(part * 100.0 / whole)


def bar_height(size: Column, largest: Column) -> Column:
    return F.greatest(F.lit(3.0), size * 100.0 / F.greatest(largest, F.lit(1)))


def throughput(n: Column, ms: Column) -> Column:
    """MiB a second with one digit; null unless both are over 0."""
    return F.when((n > 0) & (ms > 0), F.round(n / 1048576.0 / (ms / 1000.0), 1))


def megabytes(mb: float) -> int:
    if not mb >= 0 or mb == float("inf"):
        raise ValueError("a size in MB must be a number from 0")
    return int(mb * 1048576)


def megabytes_column(mb: Column) -> Column:
    """megabytes() of a column; null where that is an error."""
    mb = mb.cast("double")
    return F.when((mb >= 0) & (mb < float("inf")), F.floor(mb * 1048576)).cast("long")


def digest_text(digest: Column) -> Column:
    """The first 16 digits of a digest."""
    return F.left(digest, F.lit(16))

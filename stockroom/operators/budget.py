"""Which files a read budget admits.

Files of one size are interchangeable, so both budgets are settled on the table of distinct sizes, by running totals that no single task adds up; only of a
size that is admitted in part are the files ranked, by path. What is admitted is a few intervals of sizes, so files are marked without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

_PART, _TOTAL = "__part", "decimal(38,0)"


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over all rows before each in `order`, which must leave no ties. Rows are dealt out by ranges of the order; each range adds
    up its own rows, and the driver holds one total a range."""
    parts = scratch.save(df.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()), "ranges")
    total, totals = 0, []
    for r in parts.groupBy(_PART).agg(F.sum(value.cast(_TOTAL)).alias("n")).orderBy(_PART).collect():
        totals.append((r[_PART], total))
        total += int(r["n"] or 0)
    start = F.create_map(*(F.lit(x) for p, n in totals for x in (p, str(n)))).cast(f"map<int,{_TOTAL}>") if totals else F.create_map().cast(f"map<int,{_TOTAL}>")
    own = F.coalesce(F.sum(value.cast(_TOTAL)).over(Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(_TOTAL))
    return parts.withColumn(name, own + start[F.col(_PART)]).drop(_PART)


@dataclass(frozen=True)
class Admission:
    """whole: (least, most) sizes of which every file is admitted; part: how many files of other sizes are."""

    whole: list[tuple[int, int]]
    part: dict[int, int]

    def all_of(self, size: Column) -> Column:
        inside = F.lit(False)
        for least, most in self.whole:
            inside = inside | size.between(least, most)
        return inside

    def count(self, size: Column, n: Column) -> Column:
        some = F.lit(0).cast("long")
        for s, k in self.part.items():
            some = F.when(size == s, F.lit(k).cast("long")).otherwise(some)
        return F.when(self.all_of(size), n).otherwise(some)


def greedy(sizes: DataFrame, budget: int, cost: Column) -> Admission:
    """Largest size first; a file that does not fit is skipped, and a smaller one behind it may fit still. sizes: size_bytes, n; cost must not fall as sizes grow.

    From the largest size that fits at all, sizes are admitted whole up to one that does not fit whole; what is left behind that one is less than half of
    what was left before it, or unchanged and no size as large is looked at again. So a few steps settle any number of sizes.
    """
    rows = sizes.select("size_bytes", "n", cost.cast("long").alias("cost"))
    rows = scratch.save(running(rows, [F.desc("size_bytes")], F.col("cost").cast(_TOTAL) * F.col("n"), "before"), "costs")
    left, below, whole, part = budget, None, [], {}
    while True:
        open_ = rows.where(F.col("cost") <= left) if below is None else rows.where((F.col("cost") <= left) & (F.col("size_bytes") < below))
        first = open_.agg(F.max(F.struct("size_bytes", "before")).alias("x")).first()["x"]
        if first is None:
            return Admission(whole, part)
        top, spent = first["size_bytes"], int(first["before"])
        over = rows.where((F.col("size_bytes") <= top) & (F.col("before") + F.col("cost").cast(_TOTAL) * F.col("n") > F.lit(str(spent + left)).cast(_TOTAL)))
        last = over.agg(F.max(F.struct("size_bytes", "before", "cost")).alias("x")).first()["x"]
        if last is None:
            return Admission([*whole, (0, top)], part)
        if last["size_bytes"] < top:
            whole.append((last["size_bytes"] + 1, top))
        rest = left - (int(last["before"]) - spent)
        part[last["size_bytes"]] = rest // last["cost"]
        left, below = rest % last["cost"], last["size_bytes"]


def prefix(sizes: DataFrame, budget: int) -> Admission:
    """Smallest size first. Costs ascend, so once a file does not fit none behind it does."""
    rows = running(sizes.select("size_bytes", "n"), [F.asc("size_bytes")], F.col("size_bytes").cast(_TOTAL) * F.col("n"), "before")
    last = rows.where(F.col("before") + F.col("size_bytes").cast(_TOTAL) * F.col("n") > budget).agg(F.min(F.struct("size_bytes", "before")).alias("x")).first()["x"]
    if last is None:
        return Admission([(0, (1 << 63) - 1)], {})
    size = last["size_bytes"]
    return Admission([(0, size - 1)], {size: max(budget - int(last["before"]), 0) // size})


def greedy_counts(sizes: DataFrame, budget: int, cost: Column) -> DataFrame:
    """size_bytes, n, admitted under greedy()."""
    return sizes.select("size_bytes", "n", greedy(sizes, budget, cost).count(F.col("size_bytes"), F.col("n")).alias("admitted"))


def prefix_counts(sizes: DataFrame, budget: int) -> DataFrame:
    """size_bytes, n, admitted under prefix()."""
    return sizes.select("size_bytes", "n", prefix(sizes, budget).count(F.col("size_bytes"), F.col("n")).alias("admitted"))


def admit(files: DataFrame, admission: Admission) -> DataFrame:
    """`files` with `admitted`: of each size the first ones by path, as many as the admission has."""
    size, some = F.col("size_bytes"), {s: k for s, k in admission.part.items() if k > 0}
    if not some:
        return files.withColumn("admitted", F.coalesce(admission.all_of(size), F.lit(False)))
    partly = F.coalesce(size.isin(list(some)), F.lit(False))
    ranked = running(files.where(partly), [F.asc("size_bytes"), F.asc("path")], F.lit(1), "__rank")
    first = {r["size_bytes"]: int(r["n"]) for r in ranked.groupBy("size_bytes").agg(F.min("__rank").alias("n")).collect()}  # a row a partly admitted size
    limit = F.lit(0)
    for s, k in some.items():
        limit = F.when(size == s, F.lit(first.get(s, 0) + k)).otherwise(limit)
    return files.where(~partly).withColumn("admitted", F.coalesce(admission.all_of(size), F.lit(False))).unionByName(ranked.withColumn("admitted", F.col("__rank") < limit).drop("__rank"))

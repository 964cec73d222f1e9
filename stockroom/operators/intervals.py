"""Trees as intervals of paths, running totals over ranges, and values gathered along parent pointers.

Everything below a directory lies, in the order of paths, between its path with `/` and its path with `0`, the character behind `/`. So "below any of these" and "sums of all
below" are running totals over one sort: what is shuffled follows rows, not rows times depth. What depends on all nodes above one is found by jumps whose
length doubles, in as many rounds as the depth has binary digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

_PART, _TOTAL = "__part", "decimal(38,0)"
_KEY, _KIND = "__key", "__kind"
#: Kinds of rows at one place: where an interval begins, what lies at its beginning, where it ends.
BEGIN, OWN, END = 0, 1, 2


def begin(path: Column) -> Column:
    return F.when(path == "/", path).otherwise(F.concat(path, F.lit("/")))


def end(path: Column) -> Column:
    return F.when(path == "/", F.lit("0")).otherwise(F.concat(path, F.lit("0")))


def prefix(df: DataFrame, order: list[Column], sums: dict[str, Column], maxima: dict[str, Column] | None = None) -> DataFrame:
    """`df` with, for each row, sums and maxima (of strings) over all rows before it in `order`. Rows are dealt out by ranges of the order; each range adds up its own rows, and the
    driver holds one value a range. Rows that tie in `order` must not matter to each other."""
    maxima = maxima or {}
    parts = scratch.save(df.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()), "ranges")
    own = [*(F.sum(v.cast(_TOTAL)).alias(k) for k, v in sums.items()), *(F.max(v).alias(k) for k, v in maxima.items())]
    start: dict[str, list[tuple[int, object]]] = {k: [] for k in (*sums, *maxima)}
    total: dict[str, object] = {k: 0 for k in sums} | {k: None for k in maxima}
    for r in parts.groupBy(_PART).agg(*own).orderBy(_PART).collect():
        for k in sums:
            start[k].append((r[_PART], str(total[k])))
            total[k] += int(r[k] or 0)
        for k in maxima:
            start[k].append((r[_PART], total[k]))
            total[k] = max((x for x in (total[k], r[k]) if x is not None), default=None, key=lambda x: x.encode())

    def carried(k: str, kind: str) -> Column:
        pairs = [F.lit(x) for p, v in start[k] if v is not None for x in (p, v)]
        return (F.create_map(*pairs) if pairs else F.create_map()).cast(f"map<int,{kind}>")[F.col(_PART)]

    rows = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = {k: F.coalesce(F.sum(v.cast(_TOTAL)).over(rows), F.lit(0).cast(_TOTAL)) + carried(k, _TOTAL) for k, v in sums.items()}
    out |= {k: F.greatest(F.max(v).over(rows), carried(k, "string")) for k, v in maxima.items()}
    return parts.withColumns(out).drop(_PART)


def totals(nodes: DataFrame, own: DataFrame, values: list[str]) -> DataFrame:
    """path and, for each of `values`, the sum over the rows of `own` (path, values) at or below it. nodes: path, each once; rows of `own` need not be among them."""
    zero = [F.lit(0).cast("long").alias(v) for v in values]
    at = lambda kind, key: nodes.select("path", key(F.col("path")).alias(_KEY), F.lit(kind).alias(_KIND), *zero)
    rows = own.select("path", begin(F.col("path")).alias(_KEY), F.lit(OWN).alias(_KIND), *(F.col(v).cast("long").alias(v) for v in values)).unionByName(at(BEGIN, begin)).unionByName(at(END, end))
    before = prefix(rows, [F.asc(_KEY), F.asc(_KIND)], {f"__{v}": F.col(v) for v in values}).where(F.col(_KIND) != OWN)
    sign = F.when(F.col(_KIND) == END, 1).otherwise(-1)
    return before.groupBy("path").agg(*(F.sum(sign * F.col(f"__{v}")).cast("long").alias(v) for v in values))


def not_below(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """The rows (path, ...) that lie below none of `tops` (path)."""
    columns = rows.columns
    marked = rows.withColumns({_KEY: F.col("path"), _KIND: F.lit(OWN), "__end": F.lit(None).cast("string")})
    starts = tops.select(begin(F.col("path")).alias(_KEY), F.lit(BEGIN).alias(_KIND), end(F.col("path")).alias("__end"))
    both = prefix(marked.unionByName(starts, allowMissingColumns=True), [F.asc(_KEY), F.asc(_KIND)], {}, {"__reach": F.col("__end")})
    return both.where((F.col(_KIND) == OWN) & ~F.coalesce(F.col("__reach") > F.col(_KEY), F.lit(False))).select(*columns)


def along(nodes: DataFrame, merge: dict[str, Callable[[Column, Column], Column]], rounds: int) -> DataFrame:
    """Values gathered along pointers. nodes: id (each once), anc (the id above; null at the top), and for each name of `merge` a value, where merge[name](own, above) is the value of both.

    Gives id, anc, lost and the values, gathered over up to 2 to the power of `rounds` nodes: anc is null where the top was reached or, with `lost`, where an id above is not there; else the
    pointers go further, or round and round.
    """
    state = scratch.save(nodes.select("id", "anc", *merge, F.lit(False).alias("lost")), "jumps")
    for _ in range(rounds):
        going = state.where("anc is not null")
        n = going.count()
        if not n:
            break
        above = state.select(F.col("id").alias("anc"), F.col("anc").alias("__anc"), F.col("lost").alias("__lost"), *(F.col(m).alias(f"__{m}") for m in merge), F.lit(True).alias("__there"))
        met = going.join(above, "anc", "left")
        there = F.coalesce(F.col("__there"), F.lit(False))
        new = [F.col("id"), F.when(there, F.col("__anc")).alias("anc"), *(F.when(there, f(F.col(m), F.col(f"__{m}"))).otherwise(F.col(m)).alias(m) for m, f in merge.items()), F.coalesce("__lost", F.lit(True)).alias("lost")]
        state = scratch.save(met.select(*new).unionByName(state.where("anc is null")), "jumps")
    return state

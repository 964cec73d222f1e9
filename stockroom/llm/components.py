"""Connected components of an edge table, by union-find in each task and alternating stars between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one task: (node, smallest node it reaches here). Memory follows the task's distinct nodes."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if up[y] != y else y
        return x

    for pdf in batches:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        roots = [root(x) for x in part]
        keep = [(x, r) for x, r in zip(part, roots, strict=True) if x != r]
        yield pd.DataFrame(keep, columns=["u", "v"], dtype="int64")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node long, root long) for every node of `edges` (u long, v long): root is the smallest node reachable.

    Each round is a large-star and a small-star step (Kiveris et al., "Connected Components in MapReduce and Beyond"), written to shared storage.
    Rounds grow with the logarithm of the number of nodes. An edge table without rows gives no rows.
    """
    scratch.ship(edges.sparkSession)
    stars = scratch.save(edges.where("u != v").mapInPandas(_forest, "u long, v long"), "forest")  # v < u always
    seen = _print(stars)
    for _ in range(most_rounds):
        both = stars.select("u", "v").unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = scratch.split_join(both, least, ["u"], "n", 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = scratch.split_join(large, low, ["u"], "n", 2 * seen[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.where("u != v").distinct(), "stars")
        now = _print(after)
        if now == seen:
            break
        stars, seen = after, now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(stars.select("v", "v").distinct().toDF("node", "root"))


def _print(edges: DataFrame) -> tuple:
    """What tells two edge tables apart: a count and two order-free sums of hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum((h % 1_000_000_007).cast("decimal(38,0)")), F.sum((F.shiftright(h, 20) % 998_244_353).cast("decimal(38,0)"))).first())

"""The few pieces that every operator needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import save, ship

__all__ = ["held_out", "save", "ship", "small_side", "split_join", "table"]
#: Rows of one join key from which it is joined apart from the others.
HOT = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32 of the id as text, mod 5, is 0. A null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def small_side(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """`df` marked for broadcast if its counted rows (a few numbers each) are no more than `most`; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def split_join(big: DataFrame, side: DataFrame, on: list[str], n: str, rows: int, how: str = "inner", hot: int | None = None) -> DataFrame:
    """`big` joined (inner or left) with `side`, which has one row a key and in column `n` how many rows of `big` have that key; `rows`: of `big`, counted.

    Keys with more than `hot` rows, of which there are fewer than rows / hot, are broadcast, so no task gets all rows of one key; the others are
    shuffled, and rows with a null key stay where they are. Where `big` has no more rows than `hot`, no key can have.
    """
    hot = HOT if hot is None else hot
    if rows <= hot:
        return big.join(side, on, how)
    often = side.where(F.col(n) > hot)
    keyed = big.where(" and ".join(f"{c} is not null" for c in on))
    rest = keyed.join(F.broadcast(often.select(on)), on, "left_anti").join(side.where(F.col(n) <= hot), on, how)
    out = keyed.join(F.broadcast(often), on).unionByName(rest)
    if how == "left":
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema if f.name not in on]
        out = out.unionByName(big.where(" or ".join(f"{c} is null" for c in on)).select("*", *blank))
    return out

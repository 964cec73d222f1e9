"""Hard negatives for contrastive training, by a full sort of each anchor's integer scores.

Rows lie in chunks by a hash of their id, anchors in blocks. Blocks go to the tasks as a broadcast of at most `BROADCAST` bytes at a time, so chunks are read where they
lie and never shuffled. In a task each anchor's scores with a chunk are sorted by score and id. First pass: the sort's first rows of the anchor's label are its positives;
the best of all chunks are kept. Second pass: among the sort's rows of other labels, each positive's upper limit is found by binary search, and the rows
behind it are read while they are above the lower limit. Each chunk gives `negatives` rows at most, as no more of it can be among the first; Spark limits these
before and after one shuffle by anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Rows of a chunk and bytes of its components at most; anchors of a block; scores in memory at once; bytes of blocks that are broadcast together.
CHUNK, CHUNK_BYTES, BLOCK, SCORES, BROADCAST = 32_768, 16 << 20, 256, 1 << 21, 64 << 20
LARGEST = 2**63 - 1


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, exactly. One that doesn't fit in 64 bits is the nearest number that does."""
    largest = int(np.abs(a.astype(np.float64)).max(initial=0)) * int(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -LARGEST, LARGEST).astype(np.int64)


def sort(score: np.ndarray) -> np.ndarray:
    """Places of a row of scores, highest first; equal ones in the order they have."""
    n = len(score)
    if n and max(abs(int(score.max())), abs(int(score.min()))) < LARGEST // n - 1:  # score and place in one number, which sorts faster
        return np.sort(-score * n + np.arange(n)) % n
    return np.lexsort((np.arange(n), -score))


def limits(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score of a negative: low and high hundredths of the positive's."""
    return -(-low * positive // 100), high * positive // 100


def _pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One row for a chunk or a block, its rows by id."""
    rows = rows.sort_by("vec_id").combine_chunks()
    n = rows.num_rows
    flat = rows["ints"].combine_chunks().flatten().to_numpy()
    kind = next(t for t in (np.int16, np.int32, np.int64) if not n or not len(flat) or (np.iinfo(t).min <= flat.min() and flat.max() <= np.iinfo(t).max))
    out = {"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.dtype(kind).itemsize * 8], pa.int32())}
    for name in ("vec_id", "label"):
        out[name] = pa.array([rows[name].to_numpy().astype(np.int64).tobytes()])
    for name in ("count", "positives"):
        if name in rows.column_names:
            out[name] = pa.array([(rows[name].combine_chunks().flatten() if name == "positives" else rows[name]).to_numpy().astype(np.int64).tobytes()])
    return pa.table(out | {"ints": pa.array([flat.astype(kind).tobytes()])})


PACKED = "part int, bits int, vec_id binary, label binary, ints binary"
WITH_POSITIVES = "part int, bits int, vec_id binary, label binary, count binary, positives binary, ints binary"


def _rows(batch: pa.RecordBatch, i: int, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = {c: batch.column(prefix + c)[i].as_buffer() for c in ("vec_id", "label", "ints")}
    ids, label = (np.frombuffer(part[c], np.int64) for c in ("vec_id", "label"))
    ints = np.frombuffer(part["ints"], f"<i{batch.column(prefix + 'bits')[i].as_py() // 8}")
    return ids, label, ints.reshape(len(ids), -1) if len(ints) else np.zeros((len(ids), 0), np.int64)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, its row, place of an anchor, the anchor's id, ids of a chunk and their scores in order, whether these have the anchor's label)."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, label, ints = _rows(batch, i, "")
            anchors, own, theirs = _rows(batch, i, "a_")
            step = max(1, SCORES // max(1, len(ids)))
            for lo in range(0, len(anchors), step):
                for at, score in enumerate(scores(theirs[lo : lo + step], ints), lo):
                    order = sort(score)
                    order = order[ids[order] != anchors[at]]
                    yield batch, i, at, int(anchors[at]), ids[order], score[order], label[order] == own[at]


def _gathered(found: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Small arrays of columns, put together to batches."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for cols in found:
        held.append(cols)
        rows += len(cols[0])
        if rows >= 65_536:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
            held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)


def _positives(k: int):
    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[np.ndarray]]:
            for _, _, _, anchor, ids, score, same in _met(batches):
                best = np.flatnonzero(same)[:k]
                yield [np.full(len(best), anchor), ids[best], score[best]]

        yield from _gathered(found(), ["anchor_id", "positive_id", "positive_score"])

    return positives


def _negatives(k: int, most: int, low: int, high: int):
    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[np.ndarray]]:
            for batch, i, at, anchor, ids, score, same in _met(batches):
                count = int(np.frombuffer(batch.column("a_count")[i].as_buffer(), np.int64)[at])
                mine = np.frombuffer(batch.column("a_positives")[i].as_buffer(), np.int64).reshape(-1, k, 2)[at, :count].tolist()
                ids, score = ids[~same], score[~same]
                down = -score
                for positive, theirs in mine:
                    least, largest = limits(theirs, low, high)
                    first = int(np.searchsorted(down, -largest))
                    last = first + int((score[first : first + most] >= least).sum())
                    n = last - first
                    yield [np.full(n, anchor), np.full(n, positive), np.full(n, theirs), ids[first:last], score[first:last]]

        yield from _gathered(found(), ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return negatives


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each row of `vectors` (vec_id, embedding, label) where `anchors` holds and each
    of its first `positives` other rows of the same label, the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    A component x counts as floor(scale * x), in 64 bits; a score is the inner product, exactly (one beyond 64 bits is the nearest number in them). Higher scores come
    first, ties by smaller vec_id. Rows take no part whose vec_id, label or vector is null or whose vector holds a null or non-finite component, nor those whose
    vectors have another length than the most frequent one (the longest of equally frequent). Rows that repeat a vec_id count once: the
    smallest vector, then the smallest label. Anchors without positives, and positives without negatives, give no rows; nor does an empty table. Other
    columns are not looked at, but by `anchors`.
    """
    spark = vectors.sparkSession
    scratch.ship(spark)
    infinite = float("inf")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where("vec_id is not null and label is not null").where(F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)), F.lit(False)))
    rows = rows.withColumn("ints", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))
    rows = scratch.save(rows.groupBy("vec_id").agg(F.min(F.struct("embedding", "label", "ints", "anchor")).alias("r")).select("vec_id", "r.label", "r.ints", "r.anchor"), "rows")
    size = rows.groupBy(F.size("ints").alias("d")).agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None or not size["anchors"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows, width = rows.where(F.size("ints") == size["d"]), 8 * max(1, size["d"])
    chunks = math.ceil(size["n"] / max(1, min(CHUNK, CHUNK_BYTES // width)))
    blocks = math.ceil(size["anchors"] / BLOCK)
    together = max(1, BROADCAST // (BLOCK * (width + 16 * positives + 24)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    index = scratch.save(rows.withColumn("part", dealt(chunks)).groupBy("part").applyInArrow(_pack, PACKED), "chunks")
    asked = rows.where("anchor").withColumn("block", dealt(blocks))

    def meet(packed: DataFrame, task, schema: str, name: str) -> DataFrame:
        """All chunks with all blocks, some blocks at a time."""
        packed = packed.select(*(F.col(c).alias(f"a_{c}") for c in packed.columns))
        done = []
        for lo in range(0, blocks, together):
            hi = min(blocks, lo + together) - 1
            some = F.broadcast(packed.where(F.col("a_part").between(lo, hi)))
            met = index.withColumn("a_part", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).join(some, "a_part")
            done.append(scratch.save(met.mapInArrow(task, schema), name))
        return reduce(DataFrame.unionByName, done)

    packed = scratch.save(asked.groupBy("block").applyInArrow(_pack, PACKED), "blocks")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = meet(packed, _positives(positives), "anchor_id long, positive_id long, positive_score long", "near")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    near = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    blank = F.array_repeat(F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), F.lit(positives))
    listed = F.flatten(F.slice(F.concat(F.transform("p", lambda x: F.array(x["positive_id"], x["positive_score"])), blank), 1, positives))
    asked = asked.join(near.select(F.col("anchor_id").alias("vec_id"), F.size("p").cast("long").alias("count"), listed.alias("positives")), "vec_id")
    packed = scratch.save(asked.groupBy("block").applyInArrow(_pack, WITH_POSITIVES), "blocks")
    found = meet(packed, _negatives(positives, negatives, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", "hard")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

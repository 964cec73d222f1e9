"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

After Xie et al., "Data Selection for Language Models via Importance Resampling": words and word pairs fall into `BUCKETS` hash buckets; a bag-of-buckets
model is fitted to target text (documents labelled as good) and one to all raw text; a document's log weight is the sum of its buckets' log
ratios; the k documents with the largest log weight plus Gumbel noise are a sample without replacement in proportion to the weights. The noise comes
from a hash of the id, so a run can be repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, textvec

BUCKETS, SMOOTHING, SEED = 1 << 14, 1.0, 20
#: Most labelled documents that the target model is fitted to. The share of good documents is taken from all labelled ones.
TARGETS = 20_000
#: By how much the share of rows to select exceeds the share of good documents, so that errors of the ranking cost bad rows kept rather than good ones lost.
MARGIN = 0.01


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all words and word pairs of a slice."""
    words = textvec.Words(texts)
    h = words.hashes(lower=True)
    pairs, doc, _ = textvec.windows(h, words.ptr, 2)
    return (np.concatenate([h, pairs]) >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate([words.doc, doc])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False)
        for at, part in textvec.slices(batch.column("text")):
            bucket, doc = _buckets(part)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[at : at + len(part)][doc]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def _weigh(ratio: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            noise = batch.column("noise").to_numpy()
            for at, part in textvec.slices(batch.column("row").field("text")):
                bucket, doc = _buckets(part)
                weight = np.bincount(doc, ratio[bucket], minlength=len(part))
                key = weight + noise[at : at + len(part)]
                bits = (key + 0.0).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(part)), pa.array(weight), pa.array(key), pa.array(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))], ["row", "log_weight", "key", "rank_bits"])

    return weigh


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, exactly, by four counts over 16 bits each; None if there are fewer rows or k < 1."""
    if k < 1:
        return None
    inside, prefix, left = df.select(F.col(column).alias("x")), 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("x", 48) if shift == 48 else F.shiftright("x", shift).bitwiseAND(0xFFFF)
        found = sorted(((r[0], r[1]) for r in inside.groupBy(digit.alias("d")).count().collect()), reverse=True)  # at most 65,536 rows
        for d, n in found:
            if n >= left:
                break
            left -= n
        else:
            return None
        prefix = (prefix << 16) + d
        inside = inside.where(F.shiftright("x", shift) == prefix)
    return prefix


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, prefix: str = "", margin: float = MARGIN) -> DataFrame:
    """All rows and columns of `docs` (doc_id, text), with log_weight double, key double (log weight and noise) and selected boolean, each behind `prefix`;
    columns of these names are replaced. `labels`: doc_id, quality (1 is good).

    keep: share of rows to select. By default the share of good documents among all labelled ones of `docs` outside the held-out fold, plus `margin`; without
    labelled good ones, all. The target model is fitted to at most TARGETS labelled rows outside the held-out fold; the raw model counts all of `docs`.

    A null or empty text has weight 0. A null doc_id gets one noise for all such rows; rows that repeat a doc_id get the same noise. Rows that tie
    with the last one selected are selected too. A document labelled both good and bad counts as bad. Empty tables give no rows, or no target:
    then all weights come from smoothing alone.
    """
    spark = docs.sparkSession
    scratch.ship(spark)
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long"), "quality").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(~scratch.held_out(F.col("doc_id"))).join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    known = scratch.save(known, "labelled")
    n, good = known.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))).first()
    target = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(TARGETS).where("quality = 1").select("doc_id", F.lit(True).alias("good"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(target), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    sums = rows.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()  # at most BUCKETS rows
    counts = np.zeros((2, BUCKETS))
    for b, r, t in sums:
        counts[:, b] = r, t
    raw, wanted = (np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS)) for c in counts)

    log_weight, key, chosen = (prefix + c for c in ("log_weight", "key", "selected"))
    names = [c for c in docs.columns if c not in (log_weight, key, chosen)]
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED)), 11) + 0.5) / float(1 << 53)
    packed = docs.select(F.struct(*(F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in names)).alias("row"), (-F.log(-F.log(uniform))).alias("noise"))
    schema = T.StructType([packed.schema["row"], *(T.StructField(c, t) for c, t in (("log_weight", T.DoubleType()), ("key", T.DoubleType()), ("rank_bits", T.LongType())))])
    weighed = scratch.save(packed.mapInArrow(_weigh(wanted - raw), schema), "weighed")
    rows_in = weighed.count()
    if keep is None:
        keep = min(1.0, good / n + margin) if good else 1.0
    k = math.ceil(rows_in * keep)
    least = kth_largest(weighed, "rank_bits", k) if k < rows_in else None
    selected = F.lit(k > 0) if least is None else F.col("rank_bits") >= least
    return weighed.select("row.*", F.col("log_weight").alias(log_weight), F.col("key").alias(key), selected.alias(chosen))

"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find.

1. `features`: each document's set of five-word shingles (64-bit hashes), its SuperMinHash signature and an order-free 128-bit print of the set.
2. Equal sets collapse to one row, so exact copies cost one row from here on, however many there are. Rows have numbers of their own: a doc_id may repeat.
3. Banding: keys of some signature slots each, as many as the limit allows (`banding`): 30 keys of 6 slots at 0.85, 36 of 5 at 0.8. A pair at the
   limit misses all of them once in over a million.
4. Stars: every member of a bucket is held against the bucket's first row, and union-find groups what was confirmed. Most buckets end here.
5. Blocks: in a bucket that still has members of several groups, those outside its largest group are held against all others of the bucket that
   are in another group. Buckets of more than `BLOCK` shingles are dealt out as pairs of blocks, so no task holds a whole bucket. A block looks at
   full sets only if the signatures can stand for the limit (4.5 standard deviations below it, unless switched off), no earlier band has the pair, and
   the two aren't connected in this block yet; so it gives a forest of links, not pairs.
6. Confirmed links of both rounds, and of rows with one doc_id, go through union-find; copies take their representative's group.

No bucket, pair or partner is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textvec
from .components import components

#: BLOCK is in shingles; a row counts ROW more for its signature and bands.
WORDS, SLOTS, BLOCK, SALT, ROW = 5, 180, 1 << 20, 256, 64
#: Elements that are dealt to slots at once.
CHUNK = 1 << 16
PRINTS = ["n_shingles", "print1", "print2"]
#: How often a pair right at the limit may miss all bands.
MISSED = 1e-6
_U = np.uint64


def banding(num: int, den: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band that let a pair with Jaccard num / den miss all bands at most `MISSED` times."""
    fit = [r for r in range(1, SLOTS + 1) if SLOTS % r == 0 and (1 - (num / den) ** r) ** (SLOTS // r) <= MISSED]
    rows = max(fit, default=1)
    return SLOTS // rows, rows


def superminhash(h: np.ndarray, ptr: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots, uint64) of sets of distinct hashes h[ptr[i]:ptr[i + 1]], after Ertl (2017).

    Each element deals the ranks 0..slots-1 to the slots by its own random permutation and adds a fraction; a slot keeps its least value. Ranks of
    one element never fall on one slot twice, which is what lowers the variance. A text stops as soon as none of its slots can fall any more,
    after about 1 + slots * ln(slots) / n ranks. An empty set keeps the largest value everywhere.
    """
    docs = len(ptr) - 1
    sig = np.full(docs * slots, np.iinfo(_U).max, _U)
    doc = np.repeat(np.arange(docs), np.diff(ptr))
    step = np.arange(1, slots + 1, dtype=_U) * textvec._GOLD
    # chunks of 64k elements, so that permutations stay in cache and memory does not follow the longest text; slots keep minima, so a text that is cut goes on where it was
    for first in range(0, len(h), CHUNK):
        live, own = h[first : first + CHUNK], doc[first : first + CHUNK]
        perm = np.tile(np.arange(slots, dtype=np.uint16), (len(live), 1))
        at = np.arange(len(live))
        for j in range(slots):
            x = textvec.mix(live + step[j])
            k = j + (((x & _U(0xFFFFFF)) * _U(slots - j)) >> _U(24)).astype(np.int64)
            slot = perm[at, k]
            perm[at, k] = perm[at, j]
            np.minimum.at(sig, own * slots + slot, (_U(j) << _U(40)) | (x >> _U(24)))
            seen = np.unique(own)
            open_ = np.zeros(docs, bool)
            open_[seen] = sig.reshape(docs, slots)[seen].max(1) >= _U((j + 1) << 40)
            keep = open_[own]
            if not keep.any():
                break
            if not keep.all():
                live, own, at = live[keep], own[keep], at[keep]
    return sig.reshape(docs, slots)


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for at, part in textvec.slices(texts):
        w = textvec.Words(part)
        h, doc, _ = textvec.windows(w.hashes(lower=True), w.ptr, WORDS, short=True)
        yield at, *textvec.distinct(h, doc, len(part))


def _sums(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    c = np.concatenate([np.zeros(1, _U), np.cumsum(x, dtype=_U)])
    return c[ptr[1:]] - c[ptr[:-1]]


def _prints(h: np.ndarray, ptr: np.ndarray) -> list[pa.Array]:
    """Size, and two order-free sums, of each set."""
    return [pa.array(np.diff(ptr).astype(np.int64)), pa.array(_sums(textvec.mix(h ^ _U(0xA5A5)), ptr).view(np.int64)), pa.array(_sums(textvec.mix(h + _U(0x5A5A)), ptr).view(np.int64))]


def _features(n_bands: int, rows: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, h, ptr in _sets(batch.column("text")):
                n = len(ptr) - 1
                sig = textvec.mix(superminhash(h, ptr))
                some = np.diff(ptr) > 0
                bands = np.zeros((n, n_bands), _U)
                for r in range(rows):
                    bands = textvec.mix(bands * textvec._WIDE + sig[:, r::rows] + np.arange(n_bands, dtype=_U))
                bytes_ = (sig & _U(0xFF)).astype(np.uint8)
                flat = pa.array(bands.view(np.int64).ravel())
                offsets = pa.array(np.arange(0, n * n_bands + 1, n_bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, n), *_prints(h, ptr), pa.array([x.tobytes() for x in bytes_], pa.binary()), pa.ListArray.from_arrays(offsets, flat, mask=pa.array(~some)),
                ], ["doc_id", *PRINTS, "signature", "bands"])

    return features


def _hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, h, ptr in _sets(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(ptr) - 1), *_prints(h, ptr), pa.array([h[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())], ["doc_id", *PRINTS, "set"])


def features(docs: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, print1, print2 (of the set), signature (one byte a slot), bands for the limit num / den (null for an empty set)."""
    scratch.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_features(*banding(num, den)), "doc_id long, n_shingles long, print1 long, print2 long, signature binary, bands array<long>")


def _alike(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two ascending sets have den * intersection >= num * union."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    same = int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))
    return den * same >= num * (len(a) + len(b) - same)


def _confirm(num: int, den: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, a, b = (batch.column(c) for c in ("u", "v", "su", "sv"))
            keep, last, left = [], None, None
            for x, y in zip(a, b, strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                if left is None or last is None or not last.equals(x):
                    last, left = x, np.frombuffer(x, _U)
                keep.append(_alike(left, np.frombuffer(y, _U), num, den))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([us.filter(mask), vs.filter(mask)], ["u", "v"])

    return confirm


def _sets_of(ids: DataFrame, who: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, set) of the rows named in `ids`; only texts of their documents are read through. who: id, doc_id and prints of all that may be named."""
    named = scratch.save(who.join(ids.distinct(), "id", "left_semi"), "ids")
    n = named.count()
    need = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(scratch.small_side(named.select("doc_id").distinct(), n), "doc_id", "left_semi")
    made = need.mapInArrow(_hash_sets, "doc_id long, n_shingles long, print1 long, print2 long, set binary")
    return scratch.save(made.join(scratch.small_side(named, n), ["doc_id", *PRINTS]).select("id", "set").dropDuplicates(["id"]), "sets")


def verified(pairs: DataFrame, who: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of `pairs` (u, v) whose full sets have den * intersection >= num * union, written to shared storage.

    Only documents in a pair are read again. One row may stand in very many pairs (as u): its pairs go to buckets of SALT by the other side, and its
    set is copied once to each bucket.
    """
    pairs = scratch.save(pairs, "pairs")
    sets = _sets_of(pairs.select(F.col("u").alias("id")).unionAll(pairs.select("v")), who, docs)
    width = pairs.groupBy("u").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"), F.count("*").alias("n"))
    left = sets.join(width.withColumnRenamed("u", "id"), "id").select(F.col("id").alias("u"), F.col("set").alias("su"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = scratch.split_join(pairs, width, ["u"], "n", pairs.count()).select("u", "v", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt")).join(sets.select(F.col("id").alias("v"), F.col("set").alias("sv")), "v")
    return scratch.save(right.join(left, ["u", "salt"]).select("u", "v", "su", "sv").mapInArrow(_confirm(num, den), "u long, v long"), "links")


def _block(num: int, den: int, estimate: bool):
    limit, n_bands = num / den, banding(num, den)[0]
    least = limit - 4.5 * (limit * (1 - limit) / SLOTS) ** 0.5
    least = least + (1 - least) / 256 if estimate else -1.0  # bytes of unequal slots agree by chance

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between stragglers (side 0) and members of other groups (side 1) of one block, as many as connect them."""
        band = int(key[0])
        sig = np.frombuffer(b"".join(pdf["signature"]), np.uint8).reshape(-1, SLOTS)
        ids, group, n, straggler, side = (pdf[c].to_numpy(copy=True) for c in ("id", "group", "n_shingles", "straggler", "side"))
        bands = np.array(pdf["bands"].tolist(), np.int64).reshape(-1, n_bands)[:, :band]
        sets = [np.frombuffer(x, _U) for x in pdf["set"]]
        rights, us, vs = np.flatnonzero(side == 1), [], []
        for i in np.flatnonzero(side == 0):
            js = rights[(group[rights] != group[i]) & (~straggler[rights] | (ids[rights] > ids[i])) & (den * np.minimum(n[rights], n[i]) >= num * np.maximum(n[rights], n[i]))]
            if len(js):
                js = js[(sig[js] == sig[i]).mean(1) >= least]
            if len(js):
                js = js[~(bands[js] == bands[i]).any(1)]
            for j in js:
                if group[j] != group[i] and _alike(sets[i], sets[j], num, den):
                    group[group == group[j]] = group[i]
                    us.append(min(ids[i], ids[j]))
                    vs.append(max(ids[i], ids[j]))
        return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return block


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, estimate: bool = True) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if den * |A n B| >= num * |A u B| for their sets of five-word shingles (words: bytes other than ASCII white space, A-Z as
    a-z; a text of fewer words is one shingle). component_id is the smallest doc_id reachable over links.

    A null or blank text has an empty set: n_shingles 0, its own component, kept. A null doc_id can't be linked to: component_id null, kept. Rows
    that repeat a doc_id give as many rows; if their texts differ, a link of any of them counts for the id, in whatever order they come. Ties don't
    occur: ids decide. An empty table gives no rows. Other columns of `docs` are not looked at.

    estimate: leave a pair that shares a band unread if its signatures lie far below the limit (3 in 10^6 of pairs at the limit are lost so); False reads all
    full sets of such pairs.
    """
    feats = scratch.save(features(docs, num, den).withColumn("row", F.monotonically_increasing_id()), "features")
    sets = feats.where("doc_id is not null and n_shingles > 0")
    rows = sets.count()
    copies = scratch.save(sets.groupBy(PRINTS).agg(F.min("row").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies")
    of = scratch.split_join(sets.select("row", "doc_id", *PRINTS), copies, PRINTS, "n", rows, "left").select("row", "doc_id", F.coalesce("rep", "row").alias("rep"))
    of = scratch.save(of, "copies-of")
    reps = sets.join(of.where("row = rep").select("row"), "row", "left_semi").withColumnRenamed("row", "id")
    who = reps.select("id", "doc_id", *PRINTS)

    n_bands = banding(num, den)[0]
    keyed = reps.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("band", "key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last")
    members = scratch.save(scratch.split_join(keyed, buckets, ["band", "key"], "n", rows * n_bands).drop("n"), "members")
    n_members = members.count()
    stars = members.where("id != first").select(F.col("first").alias("u"), F.col("id").alias("v")).distinct()
    links = verified(stars, who, docs, num, den)
    groups = components(links)

    grouped = members.select("band", "key", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").select("band", "key", "id", F.coalesce("root", "id").alias("group"))
    grouped = grouped.join(reps.select("id", (F.col("n_shingles") + ROW).alias("cost")), "id")
    sizes = grouped.groupBy("band", "key", "group").agg(F.count("*").alias("n"), F.sum("cost").alias("all"))
    # of a bucket: its largest group, and its cost in all and outside that group. The star's members are in its group or were held against its centre.
    state = sizes.groupBy("band", "key").agg(F.sum("n").alias("members"), F.count("*").alias("groups"), F.sum("all").alias("all"), F.max(F.struct("all", (-F.col("group")).alias("g"))).alias("top"))
    state = state.where("groups > 1 and members > 2").select("band", "key", "members", "all", (-F.col("top.g")).alias("core"), (F.col("all") - F.col("top.all")).alias("outside"))
    open_ = scratch.save(scratch.split_join(grouped.drop("cost"), state, ["band", "key"], "members", n_members).withColumn("straggler", F.col("group") != F.col("core")), "open")
    chunks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), chunks(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    cols = ["band", "key", "id", "group", "straggler"]
    left = open_.where("straggler").select(*cols, F.lit(0).alias("side"), own("outside").alias("i"), upto("all").alias("j"))
    right = open_.select(*cols, F.lit(1).alias("side"), upto("outside").alias("i"), own("all").alias("j"))
    whole = reps.select("id", "n_shingles", "signature", "bands").join(_sets_of(open_.select("id"), who, docs), "id")
    more = left.unionByName(right).join(whole, "id").groupBy("band", "key", "i", "j").applyInPandas(_block(num, den, estimate), "u long, v long")
    links = links.unionAll(scratch.save(more, "more-links"))

    several = of.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("last"), F.count("*").alias("n")).where("u < last").drop("last")
    same_id = scratch.split_join(of.select("doc_id", F.col("rep").alias("v")), several, ["doc_id"], "n", rows).where("u != v").select("u", "v").distinct()
    roots = components(links.unionAll(scratch.save(same_id, "same-id")))
    named = of.groupBy("rep").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "least", "n", F.coalesce("root", "rep").alias("root"))
    named = scratch.save(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_reps"))
    named = scratch.split_join(named.select("rep", "n", "root"), least, ["root"], "n_reps", rows).select("rep", "n", "component_id")
    named = scratch.split_join(of.select("row", "rep"), named, ["rep"], "n", rows).select("row", "component_id")
    out = feats.select("row", "doc_id", "n_shingles").join(named, "row", "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))

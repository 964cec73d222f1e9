"""Ranked lexical search over a clustered index whose documents are in the order of recursive graph bisection.

Building. A survey counts documents and terms and takes a bounded sample. The upper levels of the bisection are fitted to the sample; every document goes down them by
the same cost that the bisection lowers, to a leaf, and there to one of as many shards as the leaf's share calls for. A shard's documents, some `SHARD`,
are bisected further in one task until a part has `CLUSTER` of them. The index has one row for each shard and term: the places and parts of its postings, and
the largest part in each cluster; and one row for each shard with the doc_ids by place.

Searching. An item's bound in a shard is the sum of its terms' largest parts there. The shard of the highest bound is searched first; the score of the last rank found is a
floor. Shards whose bound reaches the floor are searched then, each from its cluster of the highest bound on, until a cluster's bound is below what the
last rank has. Bounds never understate, and equal ones are searched too, so results are exact and ties go to the smaller doc_id.

Terms are told apart by 64-bit hashes: a thousand terms of items among 10^9 of documents meet a wrong one with a probability under 10^-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, textvec

#: Documents of the sample, and terms of one of them (those of the smallest hashes); levels that are fitted to it, at most; rounds of swaps a level.
SAMPLE, SAMPLE_TERMS, LEVELS, ROUNDS = 4096, 256, 8, 6
#: Documents of a shard, about, and of a cluster; items that are searched together. Postings of a shard, at most: what a task works on at once follows them, however long documents are.
SHARD, CLUSTER, ITEMS, POSTINGS = 4096, 64, 1024, 1 << 20
#: Fixed values of the score.
K1, B, UNIT = 8, 75, 1_000_000_000
_U = np.uint64


def counted(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: (first row, ptr, terms, occurrences, lengths). Distinct terms of text i, ascending, are ptr[i]:ptr[i + 1]; its length counts repeats."""
    for at, some in textvec.slices(texts):
        words = textvec.Words(some, letters=True, latin=False)
        h = words.hashes(lower=True)
        order = np.lexsort((h, words.doc))
        h, doc = h[order], words.doc[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)])
        yield at, np.searchsorted(doc[first], np.arange(len(some) + 1)), h[first], np.diff(np.append(first, len(h))), words.counts


def _listed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(row, terms, occurrences, length) of each text with a term."""
    for at, ptr, terms, tf, n in counted(texts):
        for i in np.flatnonzero(n):
            yield at + int(i), terms[ptr[i] : ptr[i + 1]], tf[ptr[i] : ptr[i + 1]], int(n[i])


def _cost(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits that a list of `degree` places among `size` documents takes, about."""
    return degree * np.log2(np.maximum(size, 1) / (degree + 1))


def bisect(ptr: np.ndarray, terms: np.ndarray, levels: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """An order of documents in which those that share terms are near, and for each level (node, term, gain in bits of a document with this term on the left).

    Every node's documents are halved; in each round those of both halves that gain most by changing sides are swapped in pairs, while a pair gains. All nodes of a level
    are worked on together.
    """
    n = len(ptr) - 1
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(ptr))
    names, term, degree = np.unique(terms, return_inverse=True, return_counts=True)
    some = degree[term] > 1  # a term of one document costs the same anywhere
    doc, term = doc[some], term[some].astype(np.int32)
    del some, degree
    least = np.full(n, len(names))
    np.minimum.at(least, doc, term)
    order, starts, learned = np.argsort(least, kind="stable"), np.array([0, n]), []
    for _ in range(levels):
        middle = (starts[:-1] + starts[1:] + 1) // 2
        sizes = np.diff(starts)
        node_at = np.repeat(np.arange(len(sizes)), sizes)
        node, side = np.empty(n, np.int64), np.empty(n, bool)  # keys of node and term need 64 bits
        node[order], side[order] = node_at, np.arange(n) >= middle[node_at]
        keys, key = np.unique(node[doc] * len(names) + term, return_inverse=True)
        key = key.astype(np.int32)
        at = keys // max(1, len(names))
        left, right = (middle - starts[:-1])[at], (starts[1:] - middle)[at]
        total = np.bincount(key, minlength=len(keys))
        half = (middle - starts[:-1])[node_at]
        for i in range(rounds + 1):
            on_right = np.bincount(key, weights=side[doc], minlength=len(keys)).astype(np.int64)
            on_left = total - on_right
            if i == rounds:
                break
            now = _cost(on_left, left) + _cost(on_right, right)
            to_left, to_right = now - _cost(on_left + 1, left) - _cost(np.maximum(on_right - 1, 0), right), now - _cost(np.maximum(on_left - 1, 0), left) - _cost(on_right + 1, right)
            gain = np.bincount(doc, weights=np.where(side[doc], to_left[key], to_right[key]), minlength=n)
            del now, to_left, to_right
            order = np.lexsort((-gain, side, node))
            place = np.flatnonzero(np.arange(n) < middle[node_at])
            partner = place + half[place]
            ok = partner < starts[1:][node_at[place]]
            place, partner = place[ok], partner[ok]
            swap = gain[order[place]] + gain[order[partner]] > 1e-9
            if not swap.any():
                break
            side[order[place[swap]]], side[order[partner[swap]]] = True, False
        order = np.lexsort((side, node))
        learned.append((at, names[keys % max(1, len(names))], np.log2((on_left + 1) / np.maximum(left, 1)) - np.log2((on_right + 1) / np.maximum(right, 1)), total))
        starts = np.unique(np.concatenate([starts, middle]))
    return order, learned


def _node_key(node: np.ndarray, term: np.ndarray) -> np.ndarray:
    return term + textvec.mix(node.astype(_U) + _U(1))


class Tree:
    """The upper levels: which leaf a document belongs to."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], shards: np.ndarray) -> None:
        self.levels, self.shards = levels, shards
        self.first = np.cumsum(shards) - shards

    def leaves(self, ptr: np.ndarray, terms: np.ndarray) -> np.ndarray:
        doc, node = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), np.zeros(len(ptr) - 1, np.int64)
        for keys, gains in self.levels:
            if len(keys) and len(terms):
                key = _node_key(node[doc], terms)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                gain = np.bincount(doc, weights=np.where(keys[at] == key, gains[at], 0), minlength=len(node))
            else:
                gain = np.zeros(len(node))
            node = 2 * node + (gain < 0)
        return node


def _survey(share: float):
    """One row a batch with its counts, and one row for each document of the sample."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, n_docs, n_terms = batch.column("text"), 0, 0
            for _, some in textvec.slices(texts):
                n = textvec.Words(some, letters=True, latin=False).counts
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
            key = textvec.mix(textvec.mix(np.arange(row, row + batch.num_rows, dtype=_U) + _U(1)) ^ _U(task * 0x9E3779B97F4A7C15 % 2**64))
            row += batch.num_rows
            mine = np.flatnonzero(key < _U(min(1.0, share) * (2**64 - 2**11)))
            sketches = [(int(key[mine[i]] >> _U(1)), terms[np.argsort(textvec.mix(terms))[:SAMPLE_TERMS]].tobytes()) for i, terms, _, _ in _listed(texts.take(pa.array(mine)))]
            rows = [(None, n_docs, n_terms, None), *((k, 0, 0, t) for k, t in sketches)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "n_docs", "n_terms", "terms"])

    return survey


def _fit(levels: int):
    def fit(sample: pa.Table) -> pa.Table:
        """One row for each level, with the sample's documents a leaf in the last."""
        lists = [np.frombuffer(t, _U) for t in sample["terms"].to_pylist()]
        ptr = np.cumsum([0, *map(len, lists)])
        terms = np.concatenate([np.zeros(0, _U), *lists])
        fitted = []
        for node, term, gain, degree in bisect(ptr, terms, levels)[1]:
            key = _node_key(node, term)
            some = np.flatnonzero(degree > 1)
            some = some[np.argsort(key[some])]
            fitted.append((key[some], gain[some].astype(np.float32)))
        leaves = np.bincount(Tree(fitted, np.ones(1, np.int64)).leaves(ptr, terms), minlength=1 << levels)
        return pa.table({"level": pa.array(range(levels + 1), pa.int32()), "keys": [k.tobytes() for k, _ in fitted] + [leaves.astype(np.int64).tobytes()], "gains": [g.tobytes() for _, g in fitted] + [b""]})

    return fit


def _route(tree: Tree):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document with a term: its shard and its terms."""
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, ptr, terms, tf, n in counted(batch.column("text")):
                leaf, i = tree.leaves(ptr, terms), np.flatnonzero(n)
                spread = textvec.mix(textvec.mix(np.arange(row + at, row + at + len(n), dtype=_U) + _U(7)) ^ _U(task)) >> _U(1)
                shard = tree.first[leaf] + spread.astype(np.int64) % tree.shards[leaf]
                lists = [[x[ptr[j] : ptr[j + 1]].tobytes() for j in i] for x in (terms, tf.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(shard[i]), batch.column("doc_id").take(pa.array(i + at)), pa.array(n[i].astype(np.int64)), *(pa.array(x, pa.binary()) for x in lists)], ["shard", "doc_id", "n", "terms", "tf"])
            row += batch.num_rows

    return route


INDEX = "shard long, term long, df int, top int, clusters binary, bounds binary, places binary, parts binary"


def _pieces(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """A ragged table as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(ptr) - 1, [None, pa.py_buffer((ptr * values.dtype.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def parts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence list adds to a score for each unit of its term's weight."""
    m = 100 - B + B * n * n_docs // max(1, n_terms)
    return UNIT * tf // (1000 * tf + K1 * m)


def _cuts(sizes: np.ndarray, rows: int, total: int) -> list[int]:
    """Where to cut a sequence so that a part has `rows` at most and sizes of `total` at most, or one row. Parts are about equal."""
    parts = max(1, -(-len(sizes) // rows), -(-int(sizes.sum()) // total))
    rows, total, cuts, held = -(-len(sizes) // parts), min(total, 1.05 * sizes.sum() / parts), [0], 0
    for i, size in enumerate(sizes.tolist()):
        if i > cuts[-1] and (i - cuts[-1] >= rows or held + size > total):
            cuts.append(i)
            held = 0
        held += size
    return [*cuts, len(sizes)]


def _build(n_docs: int, n_terms: int):
    def build(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        """The index rows of a shard; of more than one, if it has got several times its documents or postings."""
        sizes = pc.binary_length(docs["terms"]).to_numpy() // 8
        cuts = _cuts(sizes, 4 * SHARD, POSTINGS)
        return pa.concat_tables([_shard(key[0].as_py() << 20 | number, docs.slice(lo, hi - lo), n_docs, n_terms) for number, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])

    return build


def _shard(shard: int, docs: pa.Table, n_docs: int, n_terms: int) -> pa.Table:
    lists = [np.frombuffer(t.as_buffer(), _U) for t in docs["terms"].combine_chunks()]
    ptr = np.cumsum([0, *map(len, lists)])
    terms = np.concatenate(lists)
    tf = np.concatenate([np.frombuffer(t.as_buffer(), np.int32) for t in docs["tf"].combine_chunks()]).astype(np.int64)
    n = len(lists)
    order, _ = bisect(ptr, terms, max(0, int(np.ceil(np.log2(max(1, n / CLUSTER))))))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.astype(np.uint16)  # fewer than 2^16 documents
    ids = docs["doc_id"].combine_chunks().take(pa.array(order))
    place, part = np.repeat(place, np.diff(ptr)), parts(tf, np.repeat(docs["n"].to_numpy(), np.diff(ptr)), n_docs, n_terms)
    by = np.lexsort((place, terms))
    terms, place, part = terms[by], place[by], part[by].astype(np.uint32)
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
    ends = np.append(first, len(terms))
    cluster = place // CLUSTER
    new = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (cluster[1:] != cluster[:-1])))
    bounds, at = np.maximum.reduceat(part, new), np.searchsorted(new, ends)
    rows = {
        "shard": pa.array(np.full(len(first), shard)), "term": pa.array(terms[first].view(np.int64)), "df": pa.array(np.diff(ends).astype(np.int32)), "top": pa.array(np.maximum.reduceat(part, first).astype(np.int32)),
        "clusters": _pieces(cluster[new].astype(np.uint16), at), "bounds": _pieces(bounds, at), "places": _pieces(place.astype(np.uint16), ends), "parts": _pieces(part, ends),
    }
    directory = {"shard": [shard], "term": [None], "df": [n], "top": [0], "clusters": [None], "bounds": [None], "places": [ids.fill_null(0).to_numpy().tobytes()], "parts": [np.asarray(ids.is_null()).astype(np.uint8).tobytes()]}
    table = pa.table(rows)
    return pa.concat_tables([table, pa.table(directory, schema=table.schema)])


@dataclass
class Index:
    """The index as a table, with the number of documents that have a term and of all their terms with repeats."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame) -> Index:
    """The index of `docs` (doc_id, text). See `rank`."""
    spark = docs.sparkSession
    scratch.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.count()
    survey = scratch.save(docs.select("text").mapInArrow(_survey(2 * SAMPLE / max(1, total)), "key long, n_docs long, n_terms long, terms binary"), "survey")
    sums = survey.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms")).first()
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, sums["n_docs"] / SHARD))))))
    sample = survey.where("key is not null").orderBy("key").limit(SAMPLE).select("terms")
    got = sorted(sample.groupBy().applyInArrow(_fit(levels), "level int, keys binary, gains binary").collect()) if levels else []
    fitted = [(np.frombuffer(r["keys"], _U), np.frombuffer(r["gains"], np.float32)) for r in got[:levels]]
    share = np.frombuffer(got[levels]["keys"], np.int64) if got else np.ones(1 << levels if not levels else 1, np.int64)
    fitted = fitted if got else []
    shards = np.maximum(1, np.ceil(share / max(1, share.sum()) * sums["n_docs"] / SHARD)).astype(np.int64)
    routed = docs.mapInArrow(_route(Tree(fitted, shards)), "shard long, doc_id long, n long, terms binary, tf binary")
    rows = routed.groupBy("shard").applyInArrow(_build(sums["n_docs"], sums["n_terms"]), INDEX)
    return Index(scratch.save(rows, "index"), sums["n_docs"], sums["n_terms"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, ptr, terms, tf, _ in counted(batch.column("text")):
            item = batch.column("item_id").take(pa.array(np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)) + at))
            yield pa.RecordBatch.from_arrays([item, pa.array(terms.view(np.int64)), pa.array(tf.astype(np.int64))], ["item_id", "term", "repeats"])


def first(found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of (scores, ids, whether an id is null): by score, then id, null ids last."""
    by = np.lexsort((found[1], found[2], -found[0]))[:k]
    return tuple(x[by] for x in found)


class Postings:
    """A shard's postings of the asked terms."""

    def __init__(self, rows: pa.Table) -> None:
        self.lists = {}
        for r in rows.to_pylist():
            if r["term"] is None:
                self.ids, self.blank = np.frombuffer(r["places"], np.int64), np.frombuffer(r["parts"], np.uint8)
                self.clusters = -(-len(self.ids) // CLUSTER)
            else:
                self.lists[r["term"]] = tuple(np.frombuffer(r[c], t) for c, t in (("clusters", np.uint16), ("bounds", np.uint32), ("places", np.uint16), ("parts", np.uint32)))
        edges = np.arange(self.clusters + 1) * CLUSTER
        self.lists = {t: (c, b.astype(np.int64), p, s.astype(np.int64), np.searchsorted(p, edges)) for t, (c, b, p, s) in self.lists.items()}

    def search(self, terms: np.ndarray, weights: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first k documents, of those with a score of `floor` or more and above 0; clusters by falling bound until one is below the last of k."""
        mine = [(w, self.lists[t]) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if t in self.lists]
        bound = np.zeros(self.clusters, np.int64)
        for w, (clusters, bounds, *_) in mine:
            bound[clusters] += w * bounds
        best, floor = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)), max(1, floor)
        for c in np.argsort(-bound, kind="stable").tolist():
            if bound[c] < floor:
                break
            score, base = np.zeros(CLUSTER, np.int64), c * CLUSTER
            for w, (_, _, places, part, start) in mine:
                a, b = start[c], start[c + 1]
                if a < b:
                    score[places[a:b] - base] += w * part[a:b]
            good = np.flatnonzero(score >= floor)
            if len(good):
                best = first(tuple(np.concatenate(x) for x in zip(best, (score[good], self.ids[base + good], self.blank[base + good]), strict=True)), k)
                if len(best[0]) == k:
                    floor = max(floor, int(best[0][-1]))
        return best


FOUND = "item_id long, doc_id long, score long"


def _visit(k: int):
    def visit(key: tuple[pa.Scalar, ...], items: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if items.num_rows and rows.num_rows:
            shard = Postings(rows)
            for r in items.to_pylist():
                score, ids, blank = shard.search(np.frombuffer(r["terms"], np.int64), np.frombuffer(r["weights"], np.int64), r["floor"], k)
                for column, x in zip(out, (np.full(len(ids), r["item_id"]), ids, score, blank.astype(np.int64)), strict=True):
                    column.append(x)
        item, ids, score, blank = (np.concatenate(x) for x in out)
        return pa.table({"item_id": item, "doc_id": pa.array(ids, mask=blank > 0), "score": score})

    return visit


def _packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    return pa.table({"block": [key[0]], "item_id": [key[1]], "terms": [rows["term"].to_numpy().tobytes()], "weights": [rows["weight"].to_numpy().tobytes()]}, schema=pa.schema([("block", pa.int32()), ("item_id", pa.int64()), ("terms", pa.binary()), ("weights", pa.binary())]))


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring documents of `index` for each of `items` (item_id, text). See `rank`."""
    spark = items.sparkSession
    scratch.ship(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    asked = scratch.save(items.mapInArrow(_terms, "item_id long, term long, repeats long"), "asked")
    blocks = max(1, -(-asked.select("item_id").distinct().count() // ITEMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    wanted = scratch.save(asked.select("block", "term").distinct(), "wanted")
    lists = index.rows.where("term is not null").join(scratch.small_side(wanted, wanted.count()), "term")
    directory = index.rows.where("term is null").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hits = scratch.save(lists.unionByName(directory), "hits")
    df = hits.where("term is not null").groupBy("block", "term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long") * F.col("repeats")
    weighed = scratch.save(asked.join(df, ["block", "term"]).select("block", "item_id", "term", weight.alias("weight")), "weights")
    n = weighed.count()
    if not n:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    packed = scratch.save(weighed.groupBy("block", "item_id").applyInArrow(_packed, "block int, item_id long, terms binary, weights binary"), "packed")
    bounds = hits.where("term is not null").select("block", "term", "shard", "top").join(scratch.small_side(weighed, n), ["block", "term"])
    bounds = scratch.save(bounds.groupBy("block", "shard", "item_id").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")).where("bound > 0"), "bounds")
    best = bounds.groupBy("block", "item_id").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard"))

    def visited(visits: DataFrame, name: str) -> DataFrame:
        """What the items find in the shards that `visits` (block, shard, item_id, floor) names."""
        left = visits.join(packed, ["block", "item_id"]).select("block", "shard", "item_id", "floor", "terms", "weights")
        right = hits.join(visits.select("block", "shard").distinct(), ["block", "shard"], "left_semi").select("block", "shard", "term", "clusters", "bounds", "places", "parts")
        return scratch.save(left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(_visit(k), FOUND), name)

    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    near = visited(best.withColumn("floor", F.lit(0).cast("long")), "near")
    floor = near.groupBy("item_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("floor"))
    rest = bounds.join(floor, "item_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0))).where("bound >= floor")
    rest = scratch.save(rest.join(best, ["block", "item_id", "shard"], "left_anti").select("block", "shard", "item_id", "floor"), "visits")
    found = reduce(DataFrame.unionByName, [near, visited(rest, "far")])
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each of `items` (item_id, text) the k rows of `docs` (doc_id, text) of the highest score above 0; ties by doc_id, null ids last.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case. A term's weight is floor(1000 ln((2N + 2) / (2df + 1))); N counts
    documents with a term, L their terms, n one's terms, m = 25 + 75nN div L, and a score sums weight * (10^9 tf div (1000 tf + 8m)) over the item's terms, repeats
    included.

    A null or blank text has no terms: as a document it is in no count and never found, as an item it finds nothing. Rows that repeat a doc_id are documents of
    their own. Items without an id aren't asked; of items that repeat an id the smallest text is. Empty tables give no rows. Other columns are not looked at.
    """
    return search(build(docs), items, k)

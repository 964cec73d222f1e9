"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes, calibrated scores.

Every word of every example is a term. Document frequencies are counted over all documents. A term's weight is (1 + ln tf) * idf * association, where
association is the term's likelihood ratio (G squared) against the label among the examples: whole texts differ in hundreds of words that say nothing of
toxicity, and by plain TF-IDF (`associate=False`) the nearest examples are those of like topic. No term is left out.

Examples lie in blocks of `BLOCK`; for each term and block that it occurs in, the largest weight is stored. A query adds up these to an upper bound for each
block, scores blocks from the highest bound down, and stops when no block left can reach its k-th best cosine: the neighbours are exact. All examples
that tie with the k-th share the places that are left. Terms that more than one in `FREQUENT` examples has are not worth an index: their weights lie in
a dense table, whose exact sums go into the bounds. Votes are weighted by closeness and by how many labelled rows of its class an example stands for;
leave-one-out votes of the examples give the logistic map from votes to probabilities.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textvec

#: Labelled examples of each class that are indexed at most. Their choice goes by a hash of the id.
EXAMPLES = 2048
NEIGHBOURS, BLOCK, FREQUENT, SEED = 15, 64, 16, 6
#: How near two cosines are taken for equal, and by how much a block's bound may fall short: more than single precision, in which weights are kept, can be off.
CLOSE = 1e-6


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word of a slice: runs of letters and digits, case folded."""
    words = textvec.Words(texts, letters=True)
    return words.hashes(), words.doc


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places lo[i] .. lo[i] + n[i] - 1, one after another."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


@dataclass
class Index:
    """vocabulary: ascending hashes. Cells of term t, one a block it occurs in: cell_at[t]:cell_at[t + 1], with the block, the largest weight in it (ceiling), and
    postings cell_post[c]:cell_post[c + 1] of examples and weights. head: row of a frequent term in `dense` (terms x examples), which has no cells; else -1.
    prior: share of toxic ones among labelled rows."""

    vocabulary: np.ndarray
    idf: np.ndarray
    cell_at: np.ndarray
    block: np.ndarray
    ceiling: np.ndarray
    cell_post: np.ndarray
    post: np.ndarray
    weight: np.ndarray
    head: np.ndarray
    dense: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    stands_for: np.ndarray
    prior: float
    slope: float
    intercept: float

    def vector(self, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a weight above 0 and their weights, of length 1."""
        w = (1 + np.log(n)) * self.idf[term]
        some = w > 0
        return term[some], w[some] / np.sqrt((w * w).sum()) if some.any() else w[some]

    def neighbours(self, term: np.ndarray, w: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples with a term of the query whose cosine is that of the k-th nearest or more, nearest first, and their cosines; `leave` is left out."""
        size, row = len(self.ids), self.head[term]
        k = min(NEIGHBOURS, size)
        best = w[row >= 0] @ self.dense[row[row >= 0]].astype(np.float64)
        term, w = term[row < 0], w[row < 0]
        n = self.cell_at[term + 1] - self.cell_at[term]
        cells, of_cell = _spread(self.cell_at[term], n), np.repeat(w, n)
        blocks = self.block[cells]
        most = np.maximum.reduceat(best, np.arange(0, size, BLOCK)) + np.bincount(blocks, of_cell * self.ceiling[cells], -(-size // BLOCK))
        by_block = np.argsort(blocks, kind="stable")
        cells, of_cell = cells[by_block], of_cell[by_block]
        ends = np.concatenate([[0], np.cumsum(np.bincount(blocks, minlength=len(most)))])
        order, kth, done = np.argsort(-most, kind="stable"), 1e-9, 0
        while done < len(order) and most[order[done]] >= max(kth - CLOSE, 1e-9):
            mine = order[done : done + max(8, 2 * done)]
            mine = mine[most[mine] >= max(kth - CLOSE, 1e-9)]
            done += len(mine)
            some = _spread(ends[mine], ends[mine + 1] - ends[mine])
            c = cells[some]
            n = self.cell_post[c + 1] - self.cell_post[c]
            where = _spread(self.cell_post[c], n)
            best += np.bincount(self.post[where], np.repeat(of_cell[some], n) * self.weight[where], minlength=size)
            if leave >= 0:
                best[leave] = 0.0
            kth = max(float(np.partition(best, size - k)[size - k]), 1e-9)
        found = np.flatnonzero(best >= max(kth - CLOSE, 1e-9))
        found = found[np.lexsort((self.ids[found], -best[found]))]
        return found, np.minimum(best[found], 1.0)

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic among the neighbours, weighted by closeness; those that tie for the last places share these places. Without any, the prior."""
        w = self.stands_for[found] * cosine / (1.02 - cosine)
        if len(found) > NEIGHBOURS:
            tied = cosine <= cosine[-1] + CLOSE
            w[tied] *= (NEIGHBOURS - np.count_nonzero(~tied)) / np.count_nonzero(tied)
        return float((w * self.toxic[found]).sum() / w.sum()) if len(found) else self.prior

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * _logit(np.array(vote)) + self.intercept, -40, 40))))


def _postings(rows: list[tuple[np.ndarray, np.ndarray]], terms: int) -> tuple[np.ndarray, ...]:
    """cell_at, block, ceiling, cell_post, post, weight, head, dense of an Index."""
    doc = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
    term, weight = (np.concatenate(x) for x in zip(*rows, strict=True))
    often = np.flatnonzero(np.bincount(term, minlength=terms) > max(len(rows) / FREQUENT, BLOCK))
    head = np.full(terms, -1, np.int32)
    head[often] = np.arange(len(often))
    dense, h = np.zeros((len(often), len(rows)), np.float32), head[term] >= 0 if len(term) else np.zeros(0, bool)
    dense[head[term[h]], doc[h]] = weight[h]
    doc, term, weight = doc[~h], term[~h], weight[~h]
    order = np.lexsort((doc, term))
    doc, term, weight = doc[order], term[order], weight[order].astype(np.float32)
    first = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(doc // BLOCK) != 0))) if len(term) else np.zeros(0, np.int64)
    ceiling = np.maximum.reduceat(weight, first) if len(term) else weight
    ends = [np.searchsorted(term[first], np.arange(terms + 1)).astype(np.int32), np.append(first, len(term)).astype(np.int32)]
    return ends[0], (doc[first] // BLOCK).astype(np.uint16), ceiling, ends[1], doc.astype(np.uint16 if len(rows) < 1 << 16 else np.int32), weight, head, dense


def _logit(vote: np.ndarray) -> np.ndarray:
    v = np.clip(vote, 0.002, 0.998)
    return np.log(v / (1 - v))


@dataclass(frozen=True)
class Packed:
    """A fitted index as compressed bytes: what the driver holds and sends to tasks. load() gives the Index."""

    data: bytes

    @classmethod
    def of(cls, index: Index) -> Packed:
        import zstandard

        return cls(zstandard.ZstdCompressor(level=6).compress(pickle.dumps(index.__dict__)))

    def load(self) -> Index:
        import zstandard

        return Index(**pickle.loads(zstandard.ZstdDecompressor().decompress(self.data)))


def _calibrate(vote: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and intercept of a logistic regression of the labels on the votes' log odds, by Newton steps with a little ridge."""
    x, w = _logit(vote), w / w.mean()
    design, beta, ridge = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0]), np.diag([1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        step = np.linalg.solve(design.T @ (design * (w * p * (1 - p))[:, None]) + ridge, design.T @ (w * (y - p)) - ridge @ (beta - [1.0, 0.0]))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(max(beta[0], 0.0)), float(beta[1]))


def association(toxic: np.ndarray, code: np.ndarray, doc: np.ndarray, terms: int) -> np.ndarray:
    """G squared of each term's presence against the label; pairs (code, doc) are distinct."""
    n, n1 = len(toxic), int(toxic.sum())
    a, df = np.bincount(code, toxic[doc], terms), np.bincount(code, minlength=terms).astype(float)

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0)

    g2 = 2 * (part(a, df * n1 / n) + part(df - a, df * (n - n1) / n) + part(n1 - a, (n - df) * n1 / n) + part(n - n1 - df + a, (n - df) * (n - n1) / n))
    return np.maximum(g2, 0.0)


def build(ids: np.ndarray, toxic: np.ndarray, terms: list[tuple[np.ndarray, np.ndarray]], rows: dict[int, int], vocabulary: np.ndarray, df: np.ndarray, docs: int, associate: bool = True) -> Index:
    """Index of examples. terms: each example's distinct word hashes, ascending, and their counts. rows: labelled rows of each class that the examples stand for.
    vocabulary: all hashes of the examples, ascending; df: how many of `docs` documents have them."""
    code = [np.searchsorted(vocabulary, t) for t, _ in terms]
    doc = np.repeat(np.arange(len(terms)), [len(t) for t, _ in terms])
    idf = np.log((1 + docs) / (1 + df)) + 1
    if associate and 0 < toxic.sum() < len(toxic):
        idf = idf * association(toxic, np.concatenate(code), doc, len(vocabulary))
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    index = Index(vocabulary, idf, *[None] * 8, ids, toxic.astype(float), None, rows.get(1, 0) / max(sum(rows.values()), 1), 1.0, 0.0)
    vectors = [index.vector(c, n) for c, (_, n) in zip(code, terms, strict=True)]
    first = np.array([v[0][v[1].argmax()] if len(v[0]) else len(vocabulary) for v in vectors])
    order = np.lexsort((ids, toxic, first))  # like examples share blocks, which makes the bounds tight
    vectors = [vectors[i] for i in order]
    index.ids, index.toxic = ids[order], toxic[order].astype(float)
    index.stands_for = np.where(index.toxic == 1, rows.get(1, 0) / max(n1, 1), rows.get(0, 0) / max(n0, 1))
    index.cell_at, index.block, index.ceiling, index.cell_post, index.post, index.weight, index.head, index.dense = _postings(vectors, len(vocabulary))
    votes = np.array([index.vote(*index.neighbours(*v, leave=i)) for i, v in enumerate(vectors)])
    index.slope, index.intercept = _calibrate(votes, index.toxic, index.stands_for)
    return index


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in textvec.slices(batch.column("text")):
            h, doc = _terms(part)
            ptr = np.searchsorted(doc, np.arange(len(part) + 1))
            found = [np.unique(h[a:b], return_counts=True) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(part)) for c in ("doc_id", "toxic")), *(pa.array([f[i].astype(t).tobytes() for f in found], pa.binary()) for i, t in enumerate((np.uint64, np.int32)))], ["doc_id", "toxic", "terms", "counts"])


def _all_terms(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"vocabulary": [np.unique(np.concatenate([np.frombuffer(t, np.uint64) for t in pdf["terms"]])).tobytes()]})


def _frequencies(vocabulary: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(place in the vocabulary, documents with it) of one task."""
        sums = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, part in textvec.slices(batch.column("text")):
                h, doc = _terms(part)
                spot = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                ok = vocabulary[spot] == h
                pair = np.unique(spot[ok] * len(part) + doc[ok])
                sums += np.bincount(pair // len(part), minlength=len(vocabulary))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "n"])

    return count


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"term": [pdf["term"].to_numpy(np.int64).tobytes()], "n": [pdf["n"].to_numpy(np.int64).tobytes()]})


def _build(rows: dict[int, int], vocabulary: np.ndarray, df: np.ndarray, docs: int, associate: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "toxic"], kind="stable")
        terms = [(np.frombuffer(t, np.uint64), np.frombuffer(n, np.int32)) for t, n in zip(pdf["terms"], pdf["counts"], strict=True)]
        index = build(pdf["doc_id"].to_numpy(np.int64), pdf["toxic"].to_numpy(np.int64), terms, rows, vocabulary, df, docs, associate)
        return pd.DataFrame({"index": [Packed.of(index).data]})

    return run


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, associate: bool = True) -> Packed | None:
    """Index of at most `examples` labelled documents of each class outside the held-out fold, by a hash of the id; None without any. associate: weight terms by
    what they tell of the label, not by TF-IDF alone.

    docs: doc_id, text. labels: doc_id, toxic (0 or 1); rows with nulls are left out, and of a document with both labels 1 counts. A labelled document
    without text is an example without words; of texts that repeat a doc_id, the first in order is the example. What one task and the driver hold
    follows the distinct words of the examples, not the documents; their frequencies are counted over all documents, where they lie.
    """
    scratch.ship(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~scratch.held_out(F.col("doc_id")))
    rows = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not rows:
        return None
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(examples) for c in (0, 1)]
    chosen = scratch.save(chosen[0].unionAll(chosen[1]), "examples")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # at most 2 * examples ids
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    terms = scratch.save(texts.mapInArrow(_example_terms, "doc_id long, toxic int, terms binary, counts binary"), "example-terms")
    made = terms.groupBy().applyInPandas(_all_terms, "vocabulary binary").first()  # at most 2 * examples rows
    if made is None:
        return None
    vocabulary, df = np.frombuffer(made["vocabulary"], np.uint64), np.zeros(len(made["vocabulary"]) // 8, np.int64)
    if len(vocabulary):
        counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        found = counts.groupBy().applyInPandas(_packed, "term binary, n binary").first()  # at most a row a term of the vocabulary
        df[np.frombuffer(found["term"], np.int64)] = np.frombuffer(found["n"], np.int64)
    made = terms.groupBy().applyInPandas(_build(rows, vocabulary, df, docs.count(), associate), "index binary").first()
    return Packed(bytes(made["index"]))


def _score(packed: Packed | None):
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = packed.load() if packed is not None else None
        for batch in batches:
            for at, part in textvec.slices(batch.column("text")):
                got = [(0.0, 0.0, [])] * len(part)
                if index is not None:
                    h, doc = _terms(part)
                    size = max(len(index.vocabulary), 1)
                    spot = np.minimum(np.searchsorted(index.vocabulary, h), size - 1)
                    ok = index.vocabulary[spot] == h if len(index.vocabulary) else np.zeros(len(h), bool)
                    pair, n = np.unique(doc[ok] * size + spot[ok], return_counts=True)
                    ptr = np.searchsorted(pair, np.arange(len(part) + 1) * size)
                    for i, (a, b) in enumerate(zip(ptr[:-1], ptr[1:], strict=True)):
                        found, cosine = index.neighbours(*index.vector(pair[a:b] - i * size, n[a:b]))
                        vote = index.vote(found, cosine)
                        got[i] = (index.score(vote), vote, [{"doc_id": int(index.ids[x]), "toxic": int(index.toxic[x]), "cosine": float(c)} for x, c in zip(found[:5], cosine[:5], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], evidence)], ["doc_id", "score", "vote", "evidence"])

    return run


def score(docs: DataFrame, index: Packed | None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, score (calibrated probability), vote (of the neighbours), evidence (the five nearest examples:
    doc_id, toxic, cosine; of equal cosines the smaller ids; fewer if fewer share a term).

    A null or empty text, and one without a known term, has no neighbours: its vote is the share of toxic ones among the labels. Without an index (no labels) all scores are 0 and evidence is empty. Null
    and repeated doc_ids are kept as they are. An empty table gives no rows. Other columns are not looked at.
    """
    scratch.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(index), "doc_id long, score double, vote double, evidence array<struct<doc_id: long, toxic: int, cosine: double>>")

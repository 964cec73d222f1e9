"""Nearest neighbours by additive quantisation, exact by bounds.

A unit vector is coded as the sum of one full-dimensional codeword from each of `BOOKS` codebooks. Codebooks start as k-means of residuals and are then
refitted together by least squares; encoding is a beam search over the residual after each book. Beside the codes, the norm of the sum and its distance from the vector
are stored. A query makes a table of its inner products with all codewords; a candidate's estimate is the sum of `BOOKS` entries, and its cosine is above that by the distance at
most. The `SHORTLIST` candidates of a chunk that score best by their codes are scored exactly; every other one whose bound reaches the last of the k best of these is scored
exactly too. So nothing is missed, whatever the vectors are: codes that tell them apart less well leave more to score.

Queries are a stated set. Chunks of codes and vectors stay where they lie: blocks of queries go to all tasks as a broadcast of at most `BROADCAST` bytes at a time, and each meeting gives
the k nearest of each query, of which a task keeps k before any are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

BOOKS, WORDS, BEAM, REFITS = 32, 64, 4, 3
#: Vectors that the codebooks are fitted to, at most; all vectors are indexed.
SAMPLE = 8192
#: Candidates of a query and chunk that are scored exactly at first. Rows of a chunk, and bytes of its vectors, at most; rows of a block of queries.
SHORTLIST, CHUNK, CHUNK_BYTES, BLOCK = 128, 16_384, 8 << 20, 256
#: Bytes of queries that are broadcast together.
BROADCAST = 64 << 20
SEED = 9


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]]
    if len(centres) < k:
        centres = np.concatenate([centres, rng.normal(0, 1e-3, (k - len(centres), x.shape[1])).astype(x.dtype)])
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(n)
        centres[some] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n)[:-1]])[some], axis=0) / n[some, None]
        lost = np.flatnonzero(n == 0)
        centres[lost] = x[rng.integers(0, len(x), len(lost))]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (vectors x books, uint8) by beam search: after each book, the `beam` partial sums nearest to the vector go on."""
    n, d = x.shape
    out = np.empty((n, len(books)), np.uint8)
    for lo in range(0, n, 1024):
        part = x[lo : lo + 1024]
        m = len(part)
        rest, codes = part[:, None, :], np.empty((m, 1, 0), np.uint8)
        for book in books:
            size = rest.shape[1]
            cost = (rest**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * (rest.reshape(-1, d) @ book.T).reshape(m, size, -1)
            cost = cost.reshape(m, -1)
            keep = min(beam, cost.shape[1])
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
            from_, word = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, from_[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, from_[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        out[lo : lo + m] = codes[np.arange(m), (rest**2).sum(2).argmin(1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, i]] for i, book in enumerate(books))


def fit(x: np.ndarray, rounds: int = REFITS) -> np.ndarray:
    """Codebooks (books x words x dimensions, float32) for unit vectors."""
    rng = np.random.default_rng(SEED)
    x = x.astype(np.float32)
    rest, books = x.copy(), []
    for _ in range(BOOKS):
        books.append(_kmeans(rest, WORDS, rng))
        rest = rest - books[-1][((books[-1] ** 2).sum(1) - 2 * rest @ books[-1].T).argmin(1)]
    books = np.stack(books)
    for _ in range(rounds):
        codes = encode(x, books).astype(np.int64)
        gram, side = np.eye(BOOKS * WORDS) * 1e-2, np.zeros((BOOKS * WORDS, x.shape[1]))
        for i in range(BOOKS):
            mine = slice(i * WORDS, (i + 1) * WORDS)
            np.add.at(side[mine], codes[:, i], x)
            for j in range(BOOKS):
                gram[mine, j * WORDS : (j + 1) * WORDS] += np.bincount(codes[:, i] * WORDS + codes[:, j], minlength=WORDS * WORDS).reshape(WORDS, WORDS)
        books = np.linalg.solve(gram, side + 1e-2 * books.reshape(-1, x.shape[1])).astype(np.float32).reshape(books.shape)
    return books


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that neither huge nor tiny vectors leave the range of a double."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"books": [fit(_unit(_matrix(pdf["embedding"]))).tobytes()]})


def _index(books: np.ndarray):
    def index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """One row for a chunk of candidates."""
        pdf = pdf.sort_values("vec_id", kind="stable")
        vectors = _matrix(pdf["embedding"])
        x = _unit(vectors)
        codes = encode(x.astype(np.float32), books)
        sums = decode(codes, books.astype(np.float64))
        norms, errors = np.sqrt((sums**2).sum(1)), np.sqrt(((x - sums) ** 2).sum(1))
        return pd.DataFrame({"chunk": [key[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()], "norms": [norms.astype(np.float32).tobytes()], "errors": [errors.astype(np.float32).tobytes()], "vectors": [vectors.tobytes()]})

    return index


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": [key[0]], "query_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "queries": [_matrix(pdf["embedding"]).tobytes()]})


def _last(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each row, less what rounding may make of it; of fewer, the least of a double."""
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] - 1e-12 if n >= k else np.full(len(scores), -np.inf)


def _search(books: np.ndarray, k: int, shortlist: int):
    words = books.reshape(-1, books.shape[2]).astype(np.float64)
    slack = np.float32(4e-6 * (1 + np.sqrt((books.astype(np.float64) ** 2).sum(2)).max(1).sum()))  # of sums in single precision

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_buffer() for c in ("ids", "codes", "norms", "errors", "vectors", "query_ids", "queries")}
                ids, qids, norms, errors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["norms"], np.float32), np.frombuffer(row["errors"], np.float32)
                q, x = (_unit(np.frombuffer(row[c], np.float64).reshape(-1, books.shape[2])) for c in ("queries", "vectors"))
                codes = np.ascontiguousarray(np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1).T) + np.arange(len(books))[:, None] * books.shape[1]
                scale = 1 / np.where(norms > 0, norms, np.float32(1))
                n = max(1, min(shortlist, len(ids)))
                for lo in range(0, len(q), 32):
                    some = q[lo : lo + 32]
                    lut = (some @ words.T).astype(np.float32)
                    score = np.zeros((len(lut), len(ids)), np.float32)
                    for code in codes:
                        score += lut[:, code]
                    other = qids[lo : lo + 32, None] != ids
                    near = np.argpartition(np.where(other, -score * scale, np.inf), n - 1, axis=1)[:, :n]
                    exact = np.where(np.take_along_axis(other, near, 1), np.einsum("qd,qnd->qn", some, x[near]), -np.inf)
                    score += errors + slack
                    left = other & (score >= _last(exact, k)[:, None])
                    rows = np.flatnonzero(left.any(0))
                    left = left[:, rows]
                    exact = np.where(left, some @ x[rows].T, -np.inf)
                    left &= exact >= _last(exact, k)[:, None]
                    for j, query_id in enumerate(qids[lo : lo + 32].tolist()):
                        found = rows[left[j]]
                        cosine = (some[j] * x[found]).sum(1)
                        first = np.lexsort((ids[found], -cosine))[:k]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), query_id)), pa.array(ids[found[first]]), pa.array(cosine[first])], ["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of `queries` the k rows of `vectors` found nearest by cosine, without the one of its own id.

    Both tables: vec_id long, embedding array of numbers. Ties go to the smaller vec_id. A null vec_id, and vectors that are null, empty, zero, or
    hold a null or non-finite component, take no part; nor do vectors of another length than the most frequent one (the longest of equally
    frequent). Rows that repeat a vec_id count once, with the smallest vector. Fewer candidates than k give fewer rows; an empty table gives none.

    Of equal vectors only the k + 1 smallest ids are candidates: no more can be among a query's k nearest. Scores are cosines in double
    precision, and no nearer vector is missed. `shortlist` is how many candidates of a query and chunk, those whose codes score best, set the mark that the bounds of the others are held against.
    """
    spark = vectors.sparkSession
    scratch.ship(spark)
    infinite = float("inf")

    def sound(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
        df = df.where(F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("embedding", lambda x: x != 0), F.lit(False)))
        return df.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    every = scratch.save(sound(vectors), "vectors")
    size = every.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return none
    every = every.where(F.size("embedding") == size["d"])
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    kept = scratch.save(every.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "distinct")
    asked = scratch.save(sound(queries).where(F.size("embedding") == size["d"]), "queries")
    n, n_asked = kept.count(), asked.count()
    if not n_asked or not n:
        return none
    sample = kept.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE)
    books = np.frombuffer(sample.groupBy().applyInPandas(lambda pdf: _fit(pdf), "books binary").first()["books"], np.float32).reshape(BOOKS, WORDS, size["d"])

    chunks, blocks = math.ceil(n / max(1, min(CHUNK, CHUNK_BYTES // (8 * size["d"])))), math.ceil(n_asked / BLOCK)
    by = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    index = scratch.save(kept.withColumn("chunk", by(chunks)).groupBy("chunk").applyInPandas(_index(books), "chunk int, ids binary, codes binary, norms binary, errors binary, vectors binary"), "index")
    packed = scratch.save(asked.withColumn("block", by(blocks)).groupBy("block").applyInPandas(lambda key, pdf: _pack(key, pdf), "block int, query_ids binary, queries binary"), "blocks")
    together, best = max(1, BROADCAST // (2 * BLOCK * 8 * (size["d"] + 1))), Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts = []
    for lo in range(0, blocks, together):
        hi = min(blocks, lo + together) - 1
        met = index.withColumn("block", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).join(F.broadcast(packed.where(F.col("block").between(lo, hi))), "block")
        near = met.mapInArrow(_search(books, k, shortlist), "query_id long, vec_id long, score double")
        parts.append(scratch.save(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "near"))
    return reduce(DataFrame.unionByName, parts)

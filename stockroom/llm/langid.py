"""Languages of a text as a mixture: expectation-maximisation over n-gram likelihoods, and a penalised choice of the set.

Each language has a model of hashed byte trigrams over words with their ends. A word's likelihood under a language is the product of its trigrams'. A
document is a mixture: each word comes from one of its languages. EM, run until a text's log likelihood settles, estimates the proportions; of the sets made
of the one, two, ... all most probable languages, the one with the largest log likelihood less `PENALTY` times ln(words) for each further language is
taken. Sets grow until a text's penalised likelihood falls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textvec

BUCKETS, SMOOTHING = 1 << 15, 0.5
PENALTY = 2.0
#: EM of a text ends when a round adds less to its log likelihood than GAIN, a thousandth of the least penalty, or than what sums of that size may be off
#: by rounding. A text that takes MOST_ROUNDS is an error.
GAIN, MOST_ROUNDS = 1e-3, 100_000
UNKNOWN = "und"


def _grams(texts: pa.Array) -> tuple[textvec.Words, np.ndarray]:
    """Words, and the bucket of the trigram around each byte: the byte before, the byte, the byte after, with what is no letter as a blank."""
    words = textvec.Words(texts, letters=True)
    n = len(words.buf)
    padded = np.full(n + 2, 32, np.uint32)
    padded[1:-1] = np.where(textvec.OTHER[words.buf] | ((words.buf >= 48) & (words.buf <= 57)), 32, words.buf)
    before, after = padded[:-2].copy(), padded[2:].copy()
    inner = words.ends[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner] = 32  # texts do not touch
    after[inner - 1] = 32
    code = before << np.uint32(16) | padded[1:-1] << np.uint32(8) | after
    return words, ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for at, part in textvec.slices(batch.column("text")):
            words, bucket = _grams(part)
            letter = ~textvec.OTHER[words.buf]
            doc = np.searchsorted(words.ends, np.flatnonzero(letter), "right") - 1
            names, code = np.unique(langs[at : at + len(part)].astype(str), return_inverse=True)
            found = np.bincount(code[doc] * BUCKETS + bucket[letter], minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, c in zip(names, found, strict=True):
                sums[name] = sums.get(name, 0) + c
    for name, c in sums.items():
        some = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(c[some])], ["lang", "bucket", "n"])


def _logs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    c = np.full(BUCKETS, SMOOTHING)
    c[pdf["bucket"]] += pdf["n"]
    return pd.DataFrame({"lang": [key[0]], "logs": [np.log(c / c.sum()).astype("<f4").tobytes()]})


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a row of bucket log likelihoods for each, from all rows of `docs` (lang, text) with both. BUCKETS floats a language come to the driver."""
    scratch.ship(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    sums = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang").applyInPandas(_logs, "lang string, logs binary").orderBy("lang").collect()  # a group has BUCKETS rows at most
    return [r["lang"] for r in found], np.array([np.frombuffer(r["logs"], "<f4") for r in found]).reshape(len(found), BUCKETS)


def _pick(ptr: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the texts `which`, and where each of these texts' words start."""
    n = ptr[which + 1] - ptr[which]
    starts = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(ptr[which] - starts[:-1], n) + np.arange(starts[-1]), starts


def _mixture(like: np.ndarray, ptr: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) within `allowed`, and the log likelihood of each text, when EM has settled. like: words x languages, largest 1."""
    share = allowed / allowed.sum(1, keepdims=True)
    logs = np.zeros(len(ptr) - 1)
    live = np.flatnonzero(np.diff(ptr) > 0)
    at, starts = _pick(ptr, live)
    mine, before = like[at], np.full(len(live), -np.inf)
    for _ in range(MOST_ROUNDS):
        n = np.diff(starts)
        part = mine * np.repeat(share[live], n, axis=0)
        of_word = part.sum(1)
        logs[live] = now = np.add.reduceat(np.log(of_word), starts[:-1]) if len(live) else np.zeros(0)
        going = now - before > GAIN + 1e-9 * np.abs(now)
        if not going.any():
            return share, logs
        new = np.add.reduceat(part / of_word[:, None], starts[:-1], axis=0) / n[:, None]
        share[live[going]] = new[going]
        if going.all():
            before = now
        else:
            keep = np.repeat(going, n)
            live, before, mine = live[going], now[going], mine[keep]
            starts = np.concatenate([[0], np.cumsum(n[going])])
    raise RuntimeError(f"proportions did not settle in {MOST_ROUNDS} rounds")


def proportions(texts: pa.Array, logs: np.ndarray) -> np.ndarray:
    """Language proportions of each text of a slice (texts x languages), zero for languages outside the chosen set and for texts without words."""
    words, bucket = _grams(texts)
    docs, langs = len(texts), len(logs)
    best = np.zeros((docs, langs))
    if not len(words.start):
        return best
    of_word = np.empty((len(words.start), langs))
    sums = np.zeros(len(words.buf) + 1)
    for i in range(langs):
        np.cumsum(logs[i][bucket], out=sums[1:], dtype=np.float64)
        of_word[:, i] = sums[words.end] - sums[words.start]
    like = np.exp(np.maximum(of_word - of_word.max(1, keepdims=True), -50.0))
    share, ll = _mixture(like, words.ptr, np.ones((docs, langs)))
    order = np.argsort(-share, axis=1, kind="stable")
    price = PENALTY * np.log(np.maximum(words.counts, 2))
    live, value = np.flatnonzero(words.counts > 0), np.full(docs, -np.inf)
    for size in range(1, langs + 1):
        if not len(live):
            break
        allowed = np.zeros((len(live), langs))
        np.put_along_axis(allowed, order[live, :size], 1.0, 1)
        if size == langs:
            found, logs_of = share[live], ll[live]
        else:
            at, starts = _pick(words.ptr, live)
            if size == 1:
                found, logs_of = allowed, np.add.reduceat(np.log(like[at, np.repeat(order[live, 0], np.diff(starts))]), starts[:-1])
            else:
                found, logs_of = _mixture(like[at], starts, allowed)
        now = logs_of - price[live] * (size - 1)
        better = now > value[live]
        best[live[better]], value[live[better]] = found[better], now[better]
        live = live[better]
    return best


def _has_letter(texts: pa.Array) -> np.ndarray:
    buf, ends = textvec.flat(texts)
    low = buf | 0x20
    sums = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (buf < 128))])
    found = sums[ends[1:]] > sums[ends[:-1]]
    for i in np.flatnonzero(~found & (np.diff(ends) > 0)):
        found[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
    return found


def _predict(names: list[str], logs: np.ndarray):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in textvec.slices(batch.column("text")):
                share = proportions(part, logs) if names else np.zeros((len(part), 1))
                ok = _has_letter(part) & (share.max(1) > 0)
                order = np.argsort(-share, axis=1, kind="stable")
                some = [[names[j] for j in order[i] if share[i, j] > 0] if ok[i] else [] for i in range(len(part))]
                parts = [[float(share[i, j]) for j in order[i] if share[i, j] > 0] if ok[i] else [] for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array([x[0] if x else UNKNOWN for x in some], pa.string()), pa.array([min(1.0, x[0]) if x else 0.0 for x in parts], pa.float64()), pa.array(some, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "languages", "proportions"])

    return predict


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, lang_pred, score (proportion of lang_pred), languages and proportions, largest first.

    `model` comes from fit(). lang_pred is `und`, with score 0 and no languages, if the text is null or has no letter, or if nothing was learned.
    Of equal proportions the language first by name wins. Null and repeated doc_ids are kept as they are. An empty table gives no rows. Other
    columns are not looked at.
    """
    scratch.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predict(*model), "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>")

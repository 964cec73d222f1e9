"""Toxicity, languages and vectors: exactness against brute force, and held-out labels."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stockroom.llm import langid, scratch, toxicity, vectors


def test_index_and_votes_against_dense_vectors():
    """Weights, cosines, neighbours, votes and leave-one-out votes recomputed from counts with dense arrays."""
    rng = np.random.default_rng(0)
    words = [np.unique(rng.integers(0, 300, rng.integers(0, 30)).astype(np.uint64) * 7, return_counts=True) for _ in range(600)]
    toxic = np.array([int((t < 280).sum() > 1) for t, _ in words])
    vocabulary = np.unique(np.concatenate([t for t, _ in words]))
    df = rng.integers(1, 5000, len(vocabulary))
    for associate in (True, False):
        ix = toxicity.build(np.arange(600), toxic, words, {0: 1200, 1: int(toxic.sum())}, vocabulary, df, 5000, associate)
        weigh = np.log(5001 / (1 + df)) + 1
        if associate:
            for j, t in enumerate(vocabulary):
                has = np.array([t in w for w, _ in words])
                table = np.array([[np.sum(has & (toxic == y)) for y in (0, 1)], [np.sum(~has & (toxic == y)) for y in (0, 1)]], float)
                expected = table.sum(1, keepdims=True) * table.sum(0) / 600
                weigh[j] *= max(0, 2 * sum(o * np.log(o / e) for o, e in zip(table.ravel(), expected.ravel(), strict=True) if o))
        dense = np.zeros((600, len(vocabulary)))
        for i, (t, n) in enumerate(words):
            dense[i, np.searchsorted(vocabulary, t)] = 1 + np.log(n)
        dense *= weigh
        length = np.sqrt((dense**2).sum(1, keepdims=True))
        dense = np.divide(dense, length, out=np.zeros_like(dense), where=length > 0)
        by_id = np.argsort(ix.ids)
        queries = [(np.searchsorted(vocabulary, t), n, -1) for t, n in words[:40]] + [(np.searchsorted(vocabulary, t), n, i) for i, (t, n) in enumerate(words[:40])]
        for term, n, leave in queries:
            v = np.zeros(len(vocabulary))
            v[term] = (1 + np.log(n)) * weigh[term]
            every = dense @ (v / max(np.linalg.norm(v), 1e-300))
            if leave >= 0:
                every[leave] = 0
            kth = max(np.sort(every)[-toxicity.NEIGHBOURS], 1e-9)
            found, cosine = ix.neighbours(*ix.vector(term, n), leave=int(by_id[leave]) if leave >= 0 else -1)
            want = set(np.flatnonzero(every >= kth + 1e-6))
            assert want <= set(ix.ids[found]) <= set(np.flatnonzero(every >= kth - 1e-6)) and np.allclose(cosine, np.minimum(every[ix.ids[found]], 1), atol=1e-6)
            if len(found) == toxicity.NEIGHBOURS:
                share = np.where(toxic == 1, 1.0, 1200 / (600 - toxic.sum()))[ix.ids[found]] * cosine / (1.02 - cosine)
                assert ix.vote(found, cosine) == pytest.approx((share * toxic[ix.ids[found]]).sum() / share.sum())


def test_calibration_against_a_plain_logistic_fit():
    """Leave-one-out votes recomputed with dense arrays; the slope and intercept are where the penalised likelihood of the labels has no gradient; scores follow from them."""
    rng = np.random.default_rng(9)
    words = [np.unique(rng.integers(0, 200, rng.integers(3, 25)).astype(np.uint64) * 5, return_counts=True) for _ in range(260)]
    toxic = np.array([int(rng.random() < (0.85 if (t < 150).sum() > 3 else 0.1)) for t, _ in words])
    vocabulary = np.unique(np.concatenate([t for t, _ in words]))
    df = rng.integers(1, 900, len(vocabulary))
    ix = toxicity.build(np.arange(260), toxic, words, {0: 700, 1: int(toxic.sum())}, vocabulary, df, 900, False)
    dense = np.zeros((260, len(vocabulary)))
    for i, (t, n) in enumerate(words):
        dense[i, np.searchsorted(vocabulary, t)] = 1 + np.log(n)
    dense *= np.log(901 / (1 + df)) + 1
    dense /= np.sqrt((dense**2).sum(1, keepdims=True))
    stands = np.where(toxic == 1, 1.0, 700 / (260 - toxic.sum()))
    votes = []
    for i in range(260):
        every = dense @ dense[i]
        every[i] = 0
        kth = np.sort(every)[-toxicity.NEIGHBOURS]
        found = np.flatnonzero(every >= kth - toxicity.CLOSE)
        w = stands[found] * every[found] / (1.02 - every[found])
        tied = every[found] <= kth + toxicity.CLOSE
        if len(found) > toxicity.NEIGHBOURS:
            w[tied] *= (toxicity.NEIGHBOURS - (~tied).sum()) / tied.sum()
        votes.append((w * toxic[found]).sum() / w.sum())
    x, weight = toxicity._logit(np.array(votes)), stands / stands.mean()
    p = 1 / (1 + np.exp(-(ix.slope * x + ix.intercept)))
    gradient = [(weight * (toxic - p) * x).sum() - 0.01 * (ix.slope - 1), (weight * (toxic - p)).sum() - 0.01 * ix.intercept]
    assert np.abs(gradient).max() < 1e-2 * len(x) ** 0.5 and ix.slope > 0
    assert ix.score(0.3) == pytest.approx(1 / (1 + np.exp(-(ix.slope * np.log(0.3 / 0.7) + ix.intercept))), rel=0.05)
    assert ix.score(0.1) < ix.score(0.5) < ix.score(0.9)


def test_document_frequencies_over_all_documents(spark):
    rows = [(i, f"common w{i % 7} w{i % 7} only{i}") for i in range(200)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(60)] + [(500, 0)], "doc_id long, toxic int"), associate=False).load()
    place = lambda w: int(np.searchsorted(index.vocabulary, toxicity._terms(pa.array([w]))[0][0]))
    count = {w: sum(w in (t or "").split() for _, t in rows) for w in ("common", "w0", "w3", "only1")}
    assert all(index.idf[place(w)] == pytest.approx(np.log(203 / (1 + n)) + 1) for w, n in count.items()) and len(set(index.ids)) == len(index.ids) < 61


def test_toxicity_on_held_out_labels(spark, awkward, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.join(labels.select("doc_id", "toxic").where(scratch.held_out(F.col("doc_id"))), "doc_id"), index).join(labels, "doc_id").collect()
    right = [(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows]
    caught = [r["score"] >= 0.5 for r in rows if r["toxic"] == 1]
    assert np.mean(right) > 0.97 and np.mean(caught) > 0.8 and len(rows) > 500
    got = toxicity.score(awkward, index).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 and len(r["evidence"]) <= 5 for r in got)
    assert len({(r["score"], len(r["evidence"])) for r in got if r["doc_id"] in (0, 1, 2)}) == 1 and got[0]["score"] < 0.5
    assert toxicity.score(nothing, index).collect() == [] and toxicity.fit(nothing, labels) is None and toxicity.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score(awkward, None).collect()} == {0.0}
    assert toxicity.fit(docs.limit(0).unionAll(docs.select("doc_id", F.lit(None).cast("string").alias("text"), *docs.columns[2:])), labels) is not None


def test_languages(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~scratch.held_out(F.col("doc_id"))))
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(scratch.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98
    a, b = (docs.where((F.col("lang") == x) & (F.col("n_chars") > 1000)).first()["text"][:1000] for x in ("de", "es"))
    mixed = langid.identify(spark.createDataFrame([(1, a + " " + b), (2, a)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert sorted(mixed[0]["languages"]) == ["de", "es"] and mixed[0]["score"] < 0.7 and mixed[1]["languages"] == ["de"] and mixed[1]["score"] == 1.0
    got = {r["doc_id"]: r for r in langid.identify(awkward, model).where("doc_id is not null").collect()}
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["languages"]) == ("und", 0.0, []) for i in (0, 1, 2))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[10]["lang_pred"] != "und"
    assert langid.identify(spark.createDataFrame([(1, "123 ... ⁂ 4")], "doc_id long, text string"), model).first()["lang_pred"] == "und"
    assert langid.identify(nothing, model).collect() == []
    assert langid.identify(awkward, langid.fit(nothing)).select("lang_pred").distinct().collect() == [("und",)]


def _em(like, allowed, rounds):
    """Shares and log likelihoods round by round, by plain loops."""
    share, logs = [1 / len(allowed)] * len(allowed), []
    for _ in range(rounds):
        sums = [0.0] * len(allowed)
        total = 0.0
        for word in like:
            p = [word[j] * s for j, s in zip(allowed, share, strict=True)]
            total += float(np.log(sum(p)))
            sums = [a + b / sum(p) for a, b in zip(sums, p, strict=True)]
        logs.append(total)
        share = [a / len(like) for a in sums]
    return share, logs


def test_mixture_against_plain_loops():
    """Likelihoods never fall, shares are those of a long run, and the chosen set is the best of all sizes."""
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.full(langid.BUCKETS, 0.05), 5) + 1e-9).astype(np.float32)
    texts = pa.array(["".join(rng.choice(list("abcdefg "), n)) for n in (80, 300, 20, 7, 600)] + [None, "12 34"])
    share = langid.proportions(texts, logs)
    assert np.allclose(share[:5].sum(1), 1) and (share[5] == 0).all()
    for i in range(5):
        words, bucket = langid._grams(texts.slice(i, 1))
        like = [[float(logs[j][bucket[a:b]].astype(float).sum()) for j in range(5)] for a, b in zip(words.start, words.end, strict=True)]
        like = [[float(np.exp(max(x - max(w), -50))) for x in w] for w in like]
        full, steps = _em(like, range(5), 400)
        assert all(b >= a - 1e-9 for a, b in zip(steps, steps[1:], strict=False))
        order, best, value = np.argsort(-np.array(full), kind="stable"), None, -np.inf
        for size in range(1, 6):
            one, steps = _em(like, [int(j) for j in order[:size]], 400)
            now = steps[-1] - langid.PENALTY * np.log(max(len(like), 2)) * (size - 1)
            if now <= value:
                break
            best, value = (order[:size], one), now
        assert set(np.flatnonzero(share[i])) == set(np.flatnonzero(np.bincount(best[0], best[1], 5)))
        assert np.allclose(share[i], np.bincount(best[0], best[1], 5), atol=0.05)


def test_a_text_in_all_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~scratch.held_out(F.col("doc_id"))))
    parts = [docs.where((F.col("lang") == x) & (F.col("n_chars") > 1200)).orderBy("doc_id").first()["text"][:1200] for x in model[0]]
    got = langid.identify(spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string"), model).first()
    assert sorted(got["languages"]) == model[0] and len(model[0]) == 4 and max(got["proportions"]) < 0.35


def brute(rows, queries, k=5):
    out = {}
    for q, v in queries:
        u = np.array(v) / np.linalg.norm(v)
        s = sorted(((-float(np.dot(u, np.array(x) / np.linalg.norm(x))), i) for i, x in rows if i != q))
        out[q] = [i for _, i in s[:k]]
    return out


def test_vectors_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    got = {}
    for r in vectors.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    assert np.mean([len(set(g.values()) & set(want[q])) / 5 for q, g in got.items()]) >= 0.95
    for shortlist, least in ((32, 0.9), (5, 0.6)):  # the codes alone narrow 2,000 candidates to so many
        found = {}
        for r in vectors.nearest(df, df.where("vec_id % 50 = 0"), shortlist=shortlist).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert np.mean([len(found[q] & set(want[q])) / 5 for q in want]) >= least


def test_vectors_in_groups_of_blocks(spark, monkeypatch):
    """With chunks, blocks and broadcasts so small that there are many, and a shortlist of all, the result is exact."""
    for name, value in (("CHUNK", 40), ("BLOCK", 3), ("BROADCAST", 2 * 3 * 8 * 9 * 2)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(210, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    got = {}
    for r in vectors.nearest(df, df.where("vec_id % 10 = 0"), shortlist=210).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(0, 210, 10):
        cosine = unit @ unit[q]
        cosine[q] = -2
        assert [got[q][i] for i in range(1, 6)] == np.argsort(-cosine)[:5].tolist()
    assert len(got) == 21


def test_vectors_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [nan, 1.0, 0.0]), (4, [inf, 1.0, 0.0]), (5, [None, 1.0, 0.0]), (6, []), (7, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (50, [1e-30, 1e-30, 0.0]), (51, [1e30, 1e30, 0.0]), (51, [1e30, 1e30, 0.0]), (52, [0.0, 0.0, 1.0])]
    rows += [(i, [2.0, 2.0, 0.0]) for i in range(100, 130)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, chunk string, rank int")
    got = vectors.nearest(df, df.where("vec_id % 50 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert by == {0: [(i + 1, v) for i, v in enumerate([50, 51, 100, 101, 102])], 50: [(i + 1, v) for i, v in enumerate([51, 100, 101, 102, 103])], 100: [(i + 1, v) for i, v in enumerate([50, 51, 101, 102, 103])]}
    two = df.where("vec_id in (0, 50)")
    assert sorted(map(tuple, vectors.nearest(two, two).select("query_id", "vec_id").collect())) == [(0, 50), (50, 0)]
    assert vectors.nearest(df.limit(0), df).collect() == [] and vectors.nearest(df, df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_beam_search_is_no_worse_than_greedy(seed):
    rng = np.random.default_rng(seed)
    x, books = rng.normal(size=(50, 8)).astype(np.float32), rng.normal(size=(4, 16, 8)).astype(np.float32)
    error = lambda beam: ((x - vectors.decode(vectors.encode(x, books, beam), books)) ** 2).sum()
    assert error(8) <= error(1) + 1e-3


def test_vectors_exact_where_codes_tell_nothing(spark):
    """Close copies of a few vectors among unrelated ones, and multiples of one vector: more of them than a shortlist has, alike to the codes."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1600, 64))
    x[:600] = x[0] + 1e-4 * rng.normal(size=(600, 64))
    x[600:900] = x[600] * 2.0 ** rng.integers(-3, 4, (300, 1))
    place = rng.permutation(len(x))
    df = spark.createDataFrame([(i, x[p].tolist()) for i, p in enumerate(place)], "vec_id long, embedding array<double>")
    unit = vectors._unit(x[place])
    got = {}
    for r in vectors.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert len(got) == 32
    for q in range(0, 1600, 50):
        cosine = (unit * unit[q]).sum(1)
        cosine[q] = -2
        assert [got[q][i] for i in range(1, 6)] == np.lexsort((np.arange(1600), -cosine))[:5].tolist()

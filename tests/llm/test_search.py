"""Ranked lexical search and hard negatives against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.llm import lexical, negatives

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by the formula, over all documents."""
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms, df = len(bags), sum(n for *_, n in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    texts = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(t, texts.get(i, t))
    for i, t in texts.items():
        asked = Counter(TERM.findall(t.translate(LOWER)))
        weight = {t: r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t, r in asked.items() if df[t]}
        scored = []
        for d, b, n in bags:
            m = 25 + 75 * n * n_docs // n_terms
            scored.append((sum(w * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, w in weight.items() if t in b), d))
        first = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(i, r, d, s) for r, (s, d) in enumerate(first, 1)]
    return sorted(out, key=repr)


def invented(rng, n, topics=6):
    """Documents of several topics with common words, some equal, some blank."""
    texts = []
    for _ in range(n):
        topic = rng.randrange(topics)
        words = [rng.choice(["the", "of", "Und", "the"]) if rng.random() < 0.4 else f"t{topic}w{int(rng.paretovariate(0.7)) % 200}" for _ in range(rng.randrange(1, 60))]
        texts.append(rng.choice(texts) if texts and rng.random() < 0.2 else " ".join(words))
    return texts


@pytest.fixture()
def small(monkeypatch):
    """Bounds so small that a few hundred documents have several levels, shards and clusters."""
    for name, value in (("SHARD", 40), ("CLUSTER", 4), ("SAMPLE", 64), ("SAMPLE_TERMS", 12), ("ITEMS", 7)):
        monkeypatch.setattr(lexical, name, value)


def test_ranks_are_those_of_all_scores(spark, small):
    rng = random.Random(4)
    docs = [(i if i % 50 else None, t) for i, t in enumerate([*invented(rng, 400), None, "", " -- ", "TheTHE the", "漢字 ñandú ÑANDÚ the"])]
    items = [(i, rng.choice(docs)[1]) for i in range(24)] + [(100, "the of und"), (101, "zzz"), (102, None), (103, ""), (None, "the"), (104, "ñandú the ÑANDÚ"), (104, "ñandú"), (105, "the the the")]
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ranks(docs, items)


def test_one_hot_group_of_copies(spark, small):
    rng = random.Random(8)
    docs = [(i, t) for i, t in enumerate(invented(rng, 200) + ["same words in many copies"] * 150)]
    rng.shuffle(docs)
    items = [(1, "copies of same words"), (2, docs[0][1]), (3, "many")]
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 7).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ranks(docs, items, 7)


def test_shards_are_bounded_by_postings_too(spark, small, monkeypatch):
    """Long documents make more shards instead of larger ones, with the same ranks."""
    monkeypatch.setattr(lexical, "POSTINGS", 300)
    rng = random.Random(9)
    docs = [(i, t) for i, t in enumerate(invented(rng, 120) + [" ".join(f"w{rng.randrange(900)}" for _ in range(400)) for _ in range(40)])]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"))
    held = index.rows.where("term is not null").groupBy("shard").agg(F.sum("df").alias("postings")).collect()
    alone = index.rows.where("term is null").where("df = 1").select("shard").collect()
    assert all(r["postings"] <= 300 or (r["shard"],) in alone for r in held) and len(held) > 40
    items = [(i, docs[i * 7][1]) for i in range(20)]
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ranks(docs, items)


def test_stopping_leaves_clusters_out(monkeypatch):
    """Clusters below the last rank found are not searched, and nothing is lost by it."""
    monkeypatch.setattr(lexical, "CLUSTER", 8)
    n = 512
    lists = [np.array(sorted({1 + i // 64, 100 + i, 7}), np.uint64) for i in range(n)]
    import pyarrow as pa

    order = np.random.default_rng(2).permutation(n)
    docs = pa.table({"doc_id": pa.array(order), "n": pa.array([3] * n), "terms": [lists[i].tobytes() for i in order], "tf": [np.ones(len(lists[i]), np.int32).tobytes() for i in order]})
    shard = lexical.Postings(lexical._shard(0, docs, n, 3 * n))
    seen = []
    shard.ids = type("Ids", (), {"__getitem__": lambda self, at, ids=shard.ids: (seen.append(len(at)), ids[at])[1]})()
    score, ids, _ = shard.search(np.array([3, 7]), np.array([5000, 10]), 0, 10)
    assert ids.tolist() == list(range(128, 138)) and len(set(score.tolist())) == 1
    assert len(seen) <= 12  # 8 clusters hold the topic, of 64


def test_bisection_brings_alike_documents_together():
    rng = np.random.default_rng(1)
    topic = rng.permutation(np.repeat(np.arange(8), 32))
    lists = [np.unique(np.append(rng.choice(30, 10, replace=False) + 1000 * t, rng.choice(40, 5))).astype(np.uint64) for t in topic]
    ptr = np.cumsum([0, *map(len, lists)])
    order, levels = lexical.bisect(ptr, np.concatenate(lists), 3)
    assert sorted(order.tolist()) == list(range(256))
    assert (np.diff(topic[order]) != 0).sum() <= 14 and len(levels) == 3


def test_awkward_documents(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "word5 x5 漢字"), (3, "same")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    got = lexical.rank(awkward, items).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ranks(docs, [(r.item_id, r.text) for r in items.collect()])
    assert lexical.rank(nothing, items).collect() == []
    assert lexical.rank(awkward, items.where("false")).collect() == []


def plain_negatives(rows, anchors, k=5, most=10):
    """[(anchor, positive, rank, negative, positive score, negative score)] by the definition."""
    rows = {i: ([math.floor(256 * x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in rows:
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(rows[a][0], v, strict=True)), i, y == rows[a][1]) for i, (v, y) in rows.items() if i != a)
        for p, i, _ in [x for x in scored if x[2]][:k]:
            fit = [(-s, j) for s, j, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p][:most]
            out += [(a, i, r, j, -p, s) for r, (s, j) in enumerate(fit, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, rank string, part int, anchor string"


def test_negatives_are_those_of_all_pairs(spark, monkeypatch):
    for name, value in (("CHUNK", 50), ("BLOCK", 4), ("SCORES", 200), ("BROADCAST", 4 * 100)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0.2, 0.5, 4).round(1))], int(rng.integers(0, 4)), "x", 7, "y") for i in range(260)]
    rows += [(300, [0.5] * 4, 1, *[None] * 3)] * 2 + [(i, [0.25] * 4, i % 2, *[None] * 3) for i in range(400, 480)]  # a repeated row, a hot vector
    rows += [(500, None, 1, *[None] * 3), (None, [1.0] * 4, 1, *[None] * 3), (520, [1.0] * 4, None, *[None] * 3), (540, [1.0, None, 1.0, 1.0], 1, *[None] * 3), (560, [float("nan")] * 4, 1, *[None] * 3), (580, [float("inf")] * 4, 1, *[None] * 3), (600, [9.0] * 3, 1, *[None] * 3), (620, [], 0, *[None] * 3), (640, [0.1] * 4, 77, *[None] * 3)]
    df = spark.createDataFrame(rows, VECTORS)
    plain = [r[:3] for r in rows if r[1] is None or len(r[1]) == 4]
    got = negatives.mine(df, F.col("vec_id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(plain, lambda i: i % 20 == 0)
    assert negatives.mine(df.where("false"), F.lit(True)).collect() == [] == negatives.mine(df, F.lit(None).cast("boolean")).collect()


def test_scores_of_any_size():
    big = np.array([[2**40, -3], [5, 2**33]])
    assert negatives.scores(big, big).tolist() == [[negatives.LARGEST, 5 * 2**40 - 3 * 2**33], [5 * 2**40 - 3 * 2**33, negatives.LARGEST]]
    rng = np.random.default_rng(3)
    for top in (5, 2**61, negatives.LARGEST):
        s = rng.integers(-top, top, 500)
        s[::3] = s[1]
        assert negatives.sort(s).tolist() == sorted(range(500), key=lambda i: (-int(s[i]), i))
    for p in (-7, 0, 1, 10, 333):
        low, high = negatives.limits(p, 30, 90)
        assert [n for n in range(-500, 500) if 30 * p <= 100 * n <= 90 * p] == list(range(low, high + 1))

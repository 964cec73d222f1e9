"""Near-duplicates against brute force."""

import random

import numpy as np
import pytest

from stockroom.llm import minhash_dedup
from stockroom.llm.components import components
from stockroom.llm.minhash_dedup import SLOTS, banding, near_duplicates


def brute(rows, num=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if any(a and b and 100 * len(a & b) >= num * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"new{rnd.randrange(10**6)}"
    return out


@pytest.mark.parametrize("seed", range(2))
def test_chains_of_edits_and_groups_of_copies(spark, seed):
    """Chains whose ends are far apart, a large group of near copies around the limit, copies, shared passages, short texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(3000)}"
    texts, passage = [], [word() for _ in range(60)]
    for _ in range(6):
        t = [word() for _ in range(150)]
        for _ in range(12):
            texts.append(" ".join(t))
            t = edited(rnd, t, rnd.randrange(1, 5))
    base = [word() for _ in range(120)]
    texts += [" ".join(edited(rnd, base, rnd.randrange(0, 4))) for _ in range(90)]
    texts += [" ".join(base)] * 30
    texts += [" ".join([*passage, *(word() for _ in range(rnd.randrange(10, 60)))]) for _ in range(40)]
    texts += ["a b c", "A b  c", "a b", "", None, " ", "x"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_blocks_find_what_the_star_does_not(spark, monkeypatch):
    """The same result with blocks of a few shingles, so that buckets are dealt out."""
    from stockroom.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "BLOCK", 800)
    monkeypatch.setattr(minhash_dedup, "SALT", 4)
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(900)}" for _ in range(110)]
    rows = [(i, " ".join(edited(rnd, base, rnd.randrange(0, 3)))) for i in range(80)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_awkward(spark, awkward, nothing):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    assert all((r["n_shingles"], r["component_id"], r["kept"]) == (0, i, True) for i in (0, 1, 2) for r in by[i])
    assert len(by[5]) == 2 and all(r["component_id"] == 5 for i in (5, 6, 7) for r in by[i]) and not by[6][0]["kept"]
    assert by[9][0]["n_shingles"] > 100_000
    assert near_duplicates(nothing).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, 3), (3, 9), (9, 5), (7, 7)] + [(1000, i) for i in range(1001, 1400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, 3: 3, 5: 3, 9: 3, **{i: 1000 for i in range(1000, 1400)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_bands_follow_the_limit():
    for num, den in ((85, 100), (80, 100), (1, 2), (95, 100)):
        bands, rows = banding(num, den)
        assert bands * rows == SLOTS and (1 - (num / den) ** rows) ** bands <= 1e-6
    assert banding(85, 100) == (30, 6) and banding(80, 100) == (36, 5)


@pytest.mark.parametrize("backwards", [False, True])
def test_ids_with_several_texts_take_the_links_of_all(spark, backwards, monkeypatch):
    """Repeated ids with different texts, equal ones, and blanks, in both orders of the rows; hot keys joined apart."""
    from stockroom.llm import scratch

    monkeypatch.setattr(scratch, "HOT", 3)
    rnd = random.Random(11)
    a, z, y = ([f"w{rnd.randrange(2000)}" for _ in range(120)] for _ in range(3))
    rows = [(1, a), (2, edited(rnd, a, 1)), (2, z), (3, edited(rnd, z, 1)), (4, y), (5, y), (5, a), (6, z), (7, y[:60]), (7, y[:60]), (8, []), (8, a), (9, [])]
    rows = [(i, " ".join(t)) for i, t in rows]
    rows = rows[::-1] if backwards else rows
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(found) == len(rows)
    want = brute(rows)
    assert all(r["component_id"] == (want[r["doc_id"]] if r["n_shingles"] else r["doc_id"]) for r in found) and want[3] == want[6] == want[4] == 1 and want[7] == 7


def test_without_the_estimate(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(900)}" for _ in range(110)]
    rows = [(i, " ".join(edited(rnd, base, rnd.randrange(0, 3)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df, estimate=False).collect()} == brute(rows)


def test_long_texts_in_chunks(monkeypatch):
    """Signatures are the same however texts are cut, and memory does not follow the longest one."""
    import tracemalloc

    rng = np.random.default_rng(5)
    sizes = [0, 1, 3, 500, 0, 2000, 7, 1, 0]
    h = np.concatenate([np.sort(rng.integers(0, 2**63, n).astype(np.uint64)) for n in sizes])
    ptr = np.cumsum([0, *sizes])
    whole = minhash_dedup.superminhash(h, ptr)
    for chunk in (1, 37, 512):
        monkeypatch.setattr(minhash_dedup, "CHUNK", chunk)
        assert (minhash_dedup.superminhash(h, ptr) == whole).all()
    monkeypatch.undo()
    peaks = []
    for n in (200_000, 2_000_000):
        long = rng.integers(0, 2**63, n).astype(np.uint64)
        tracemalloc.start()
        minhash_dedup.superminhash(long, np.array([0, n]))
        peaks.append(tracemalloc.get_traced_memory()[1] - 8 * n)
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 16 * 2_000_000

"""Vectorised words and windows against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stockroom.llm import textvec
from stockroom.llm.minhash_dedup import SLOTS, superminhash

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t\u000b漢.", max_size=30)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_windows(texts):
    arr = pa.array(texts, pa.string())
    w = textvec.Words(arr)
    want = [(t or "").encode().split() for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    assert [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == [y for x in want for y in x]
    h = w.hashes(lower=True)
    flat = [y.lower() for x in want for y in x]
    assert len(set(h.tolist())) == len(set(flat)) and len({(a, b) for a, b in zip(h.tolist(), flat, strict=True)}) == len(set(flat))
    s, doc, _ = textvec.windows(h, w.ptr, 3, short=True)
    got = [set(s[doc == i].tolist()) for i in range(len(texts))]
    sets = [{tuple(x[j : j + 3]) for j in range(max(1, len(x) - 2))} if x else set() for x in ([y.lower() for y in x] for x in want)]
    assert [len(x) for x in got] == [len(x) for x in sets]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(sets[i] & sets[j])


def test_slices_hold_all_texts():
    arr = pa.array(["x" * n for n in (0, 5, 3_000_000, 1, 2_000_000, 200_000)])
    got = [(at, part.to_pylist()) for at, part in textvec.slices(arr)]
    assert [t for _, p in got for t in p] == arr.to_pylist() and [at for at, _ in got] == [0, 2, 3, 5][: len(got)]
    assert list(textvec.slices(pa.array([], pa.string()))) == []


def test_signatures_estimate_jaccard_with_less_variance_than_independent_hashes():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(200):
        pool = rng.integers(0, 2**63, 90, dtype=np.uint64)
        a, b = np.sort(pool[:70]), np.sort(pool[20:])
        sig = superminhash(np.concatenate([a, b]), np.array([0, 70, 140]))
        errors.append((sig[0] == sig[1]).mean() - 50 / 90)
    j = 50 / 90
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < j * (1 - j) / SLOTS


def test_one_signature_for_one_set_and_none_for_the_empty_one():
    h = np.arange(5, dtype=np.uint64)
    sig = superminhash(np.concatenate([h, h]), np.array([0, 5, 5, 10]))
    assert (sig[0] == sig[2]).all() and (sig[1] == np.iinfo(np.uint64).max).all()

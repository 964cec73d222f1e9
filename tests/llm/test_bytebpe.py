"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stockroom.llm import bytebpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bytebpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids(codec, texts):
    out = [[] for _ in texts]
    for row, piece in bytebpe.Encoder(codec).texts(iter(texts)):
        out[row] += piece.tolist()
    return out


def test_random_texts(codec, library):
    rng = random.Random(3)
    signs = [*"abcdefghijklmnop  \n\t'sdl0123456789.,!?", "é", "漢", "字", "　", "😀", "\U0003f430", "՘", "\x85", "т", "ا", "'ll", "'re", " the", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(rng.choices("abcdetns", k=rng.randrange(60, 400))) for _ in range(200)]
    assert ids(codec, texts) == [library.encode_ordinary(t) for t in texts]


def test_repeats_and_lengths_around_the_bound(codec, library):
    w = bytebpe.WIDEST
    texts = ["", *(unit * n for unit in ("a", "ab", "=", "\n", "漢", "-=") for n in (1, 2, 3, w // 2, w - 1, w, w + 1, 2 * w + 1, 1000))]
    assert ids(codec, texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(codec, library, text):
    assert ids(codec, [text]) == [library.encode_ordinary(text)]


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=2, max_size=90), st.permutations([a + b + c for a in ("", *"abc") for b in "abc" for c in "abc"]))
def test_any_order_of_ranks(text, order):
    """Ranks of any order, so that a merge can make a pair of a lower rank than its own: in matrices and in rows of their own."""
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(order)}
    c = bytebpe.Codec.__new__(bytebpe.Codec)
    c.ranks, c.base = ranks, bytebpe.np.arange(256, dtype="int32")
    made = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    c.pairs = bytebpe.Pairs(*bytebpe.np.array(made, "int32").T)
    parts = [text[i : i + 1].encode() for i in range(len(text))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    want = [ranks[p] for p in parts]
    assert c._long(text.encode()).tolist() == want
    assert c._matrix([text.encode(), b"ab"], 128)[0].tolist() == want


def test_long_text_and_forgetting(codec, library, monkeypatch):
    for name, value in (("MEMORY", 300), ("PART", 1000), ("CELLS", 256)):
        monkeypatch.setattr(bytebpe, name, value)
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(30_000))
    assert ids(codec, [text, "one", text[::-1]]) == [library.encode_ordinary(t) for t in (text, "one", text[::-1])]


def test_tables(spark, library, awkward, nothing):
    rows = bytebpe.encode(awkward, PATH, P.PATTERN).collect()
    texts = [r.text or "" for r in awkward.select("text").collect()]
    assert sorted((r.doc_id or -1, r.ids) for r in rows) == sorted((r.doc_id or -1, library.encode_ordinary(t)) for r, t in zip(awkward.collect(), texts, strict=True))
    assert sorted(r.decoded for r in rows) == sorted(texts) and all(r.n_tokens == len(r.ids) for r in rows)
    digests = bytebpe.encode(awkward, PATH, P.PATTERN, digests=True).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted((len(i), sha(",".join(map(str, i)).encode()), sha(t.encode())) for t in texts for i in [library.encode_ordinary(t)])
    assert bytebpe.encode(nothing, PATH, P.PATTERN).collect() == []
    assert bytebpe.encode(nothing, PATH, P.PATTERN, digests=True).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_query(spark, library, sf_dir):
    from stockroom.llm.queries import QUERIES

    sha = lambda b: hashlib.sha256(b).hexdigest()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {(r.doc_id, len(i), sha(",".join(map(str, i)).encode()), sha((r.text or "").encode())) for r in docs for i in [library.encode_ordinary(r.text or "")]}
    assert {tuple(r) for r in QUERIES["op11_byte_bpe"](spark, sf_dir).collect()} == want

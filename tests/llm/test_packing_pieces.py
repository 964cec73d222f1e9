"""Packing and piece encoding against the libraries."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from stockroom.llm.packing import Encoder, fullest, pack, plan
from stockroom.llm.pieces import encode, model

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ENCODER, SLOW = Encoder(BPE), tokenizers.Tokenizer.from_file(BPE)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_ids_are_the_librarys(text):
    assert ENCODER.encode(text) == SLOW.encode(text, add_special_tokens=False).ids
    ids = [1, *LIBRARY.encode(text), 2]
    got = model(PIECES).encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert model(PIECES).decode(ids).decode() == LIBRARY.decode(ids)


def test_special_strings_and_runs():
    for t in ("<|endoftext|>a<|endoftext|>", " " * 50, "\n\n\n  \n", "a" * 3000, "don't I'LL we've", "١٢٣ ²Ⅷ\x85\x1c"):
        assert ENCODER.encode(t) == SLOW.encode(t, add_special_tokens=False).ids
    rnd = random.Random(3)
    vocabulary = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    for n in range(60):
        for t in (" " * n, " " * n + "x", "x" + " " * n, " " * n + "漢", "▁" * n, "a" * n, "<s></s><0x41>" * n, "".join(rnd.choice(vocabulary) for _ in range(n))):
            got = model(PIECES).encode(t)
            assert np.frombuffer(got, "<u4").tolist() == [1, *LIBRARY.encode(t), 2], t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_fullest_is_the_best_combination_with_the_longest(lengths):
    counts = Counter(lengths)
    found = fullest(dict(counts), 12)
    assert found[max(counts)] >= 1 and all(c <= counts[n] for n, c in found.items())
    rest = sorted(lengths)[:-1]
    best = max(sum(c) for r in range(len(rest) + 1) for c in itertools.combinations(rest, r) if sum(c) + max(counts) <= 12) + max(counts)
    assert sum(n * c for n, c in found.items()) == best


def test_plan_places_every_piece_once():
    rnd = random.Random(1)
    counts = Counter(max(1, int(min(64, rnd.lognormvariate(2.5, 1)))) for _ in range(5000))
    rows = plan(dict(counts), 64)
    bins, at = defaultdict(int), defaultdict(list)
    for n, first, seq, off in rows.tolist():
        at[n].append((first, seq, off))
    for n, c in counts.items():
        spans = sorted(at[n])
        assert spans[0][0] == 0
        for (a, seq, off), (b, *_) in zip(spans, [*spans[1:], (c,)], strict=True):
            for i in range(b - a):
                bins[seq + i] += n
    assert max(bins.values()) <= 64 and sum(bins.values()) == sum(n * c for n, c in counts.items())
    assert len(bins) <= -(-sum(bins.values()) // 64) + 2


def check_packed(rows, texts, size=1024):
    """texts: list of (doc_id, text). Rows of one id are told apart by what they hold."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= size
    want = Counter()
    for i, t in texts:
        ids = np.array([*SLOW.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % size or size if len(ids) > size else len(ids)
        cuts = [0, *range(first, len(ids) + 1, size)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(bins), sum(n for _, _, _, n, _ in want.elements())


def test_pack_tables(spark, sf_dir, awkward, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, total = check_packed(pack(docs, BPE).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert n <= 1.02 * -(-total // 1024) + 1
    check_packed(pack(awkward, BPE).collect(), [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert pack(nothing, BPE).collect() == []


def test_encode_tables(spark, sf_dir, awkward, nothing):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), awkward):
        want = Counter()
        for r in docs.collect():
            ids = [1, *LIBRARY.encode(r["text"] or ""), 2]
            want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()] += 1
        assert Counter(map(tuple, encode(docs, PIECES, digests=True).collect())) == want
    for r in encode(awkward, PIECES).where("doc_id = 10").collect():
        assert r["ids"] == [1, *LIBRARY.encode("élan ñandú ß 漢字 😀 \u0000 end"), 2] and r["decoded"] == "élan ñandú ß 漢字 😀 \u0000 end"
    assert encode(nothing, PIECES).collect() == []


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(PIECES, "rb") as f:
        m.ParseFromString(f.read())
    m.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError, match="identity normalisation"):
        model(str(tmp_path / "m"))

"""SentencePiece encoding and decoding of merge-type models by a prefix table.

For merge-type (BPE) models the encoding of every prefix of a text ends in one certain token: the only piece that ends there and is compatible with the
last token of the prefix before it. So the table over prefixes needs one token each. It is filled from left to right: an automaton gives the
pieces that end at a place, longest first; a pair test tells whether two neighbouring tokens stay as they are when their characters are merged
together. From the last prefix, the ids are read backwards.

Pieces never run over a change from another character to the space mark, if the vocabulary has no piece that does; the table then starts anew at
each such place, and what a stretch gave before is remembered, within a bounded memory.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

MARK = "▁"
#: Stretches, and pairs, that are remembered by a process: up to about 300 MB. Beyond that, memory starts anew; results don't change.
MEMORY = 1_000_000
#: Longest stretch in characters that is remembered.
LONGEST = 64


class Model:
    """A merge-type model file: identity normaliser with a leading space mark, byte fallback, no pieces of other kinds than normal, byte, unknown, control."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm, kinds = m.normalizer_spec, m.SentencePiece
        if m.trainer_spec.model_type != m.trainer_spec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or not m.trainer_spec.byte_fallback or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model with identity normalisation, a leading space mark and byte fallback is needed")
        if odd := {p.type for p in m.pieces} - {kinds.NORMAL, kinds.BYTE, kinds.UNKNOWN, kinds.CONTROL}:
            raise ValueError(f"pieces of kind {odd} are not supported")
        self.begin, self.end = m.trainer_spec.bos_id, m.trainer_spec.eos_id
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in m.pieces if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        #: What an id stands for when decoded; a control id for nothing.
        self.bytes = [bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else p.piece.replace(MARK, " ").encode() if p.type == kinds.NORMAL else m.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else b"" for p in m.pieces]
        #: Runs of the mark have one score among them, lower than any other: they are merged last, from the left.
        runs = {p for p in self.id if not p.strip(MARK)}
        words = {p for p in self.id if p not in runs or p == MARK}
        if MARK not in words or any(MARK in p[1:] for p in words) or max(map(self.score.get, runs - {MARK}), default=0) >= min(self.score[w] for w in words - {MARK}):
            raise ValueError("pieces run over a space mark")
        self._made: dict[str, tuple[str, str] | None] = {}
        self.runs = sorted(map(len, runs), reverse=True)
        if any(self._run(n) != [*map(len, self._merge(MARK * n)[0])] for n in range(3 * self.runs[0])):
            raise ValueError("runs of the space mark don't merge from the left")
        self.automaton = ahocorasick.Automaton()
        for p in words:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str, bytes] = {}

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merges characters, best score first, leftmost of equals: the tokens, and the last merge."""
        parts, score, last = list(text), self.score, None
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (score.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in score:
                break
            last = (parts[best], parts[best + 1])
            parts[best : best + 2] = ["".join(last)]
        return parts, last

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """What the piece is made of by its last merge; two empty strings for a character; None if its characters merge to something else."""
        if piece not in self._made:
            parts, last = self._merge(piece)
            self._made[piece] = None if len(parts) > 1 else last or ("", "")
        return self._made[piece]

    def _run(self, n: int) -> list[int]:
        """The pieces of n marks in a row: from the left the longest, then the longest that fits."""
        out = [self.runs[0]] * (n // self.runs[0])
        n %= self.runs[0]
        for k in self.runs:
            while k <= n:
                out.append(k)
                n -= k
        return out

    def _compatible(self, left: str, right: str) -> bool:
        """Whether the two stay as they are when their characters are merged together.

        Undoes the merges next to the boundary, latest first (of equals the right one, as the left is made first). The pair fails if the tokens that
        then meet would have merged with each other before the one that was undone.
        """
        score, limit, a, b = self.score, -np.inf, left, right
        while True:
            if score.get(a + b, -np.inf) > limit:
                return False
            x, y = score[a] if len(a) > 1 else np.inf, score[b] if len(b) > 1 else np.inf
            if x == y == np.inf:
                return True
            if x < y:
                limit, a = x, self._halves(a)[1]
            else:
                limit, b = y - 0.5, self._halves(b)[0]

    def _table(self, word: str) -> list[str]:
        """The tokens of a stretch with at most one mark, at its start. Characters outside the vocabulary are tokens of their own that merge with nothing."""
        n = len(word)
        last, known, pairs, made = [""] * (n + 1), self.id, self._pairs, self._made
        for at, piece in self.automaton.iter(word):  # the pieces that end at a place, longest first
            if last[at + 1]:
                continue
            before = last[at + 1 - len(piece)] if len(piece) <= at else ""
            if piece not in made:
                self._halves(piece)
            if made[piece] is None:
                continue
            if not before and len(piece) <= at:  # a character outside the vocabulary
                before = word[at - len(piece)]
            if before and before in known:
                if (good := pairs.get((before, piece))) is None:
                    if len(pairs) >= MEMORY:
                        pairs.clear()
                    good = pairs[before, piece] = self._compatible(before, piece)
                if not good:
                    continue
            last[at + 1] = piece
        out, i = [], n
        while i:
            out.append(last[i] or word[i - 1])
            i -= len(out[-1])
        return out[::-1]

    def _stretch(self, text: str) -> bytes:
        """The ids of a stretch: marks, then other characters."""
        marks = len(text) - len(text.lstrip(MARK))
        tokens = self._table(text[max(0, marks - 1) :]) if marks < len(text) else []
        run = marks - bool(tokens and marks and tokens[0] != MARK)
        if tokens and tokens[0] == MARK:
            del tokens[0]
        ids = [self.id[MARK * n] for n in self._run(run)]
        for t in tokens:
            ids.extend([self.id[t]] if t in self.id else (self.byte[b] for b in t.encode()))
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, in UTF-8. One space is the leading mark; bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(map(self.bytes.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace").encode()

    def encode(self, text: str) -> bytes:
        """The ids with begin and end, as little-endian 32-bit integers."""
        known, ids = self._words, [struct.pack("<I", self.begin)]
        if text:
            for s in STRETCH.findall(MARK + text.replace(" ", MARK)):
                if (found := known.get(s)) is None:
                    found = self._stretch(s)
                    if len(s) <= LONGEST:
                        if len(known) >= MEMORY:
                            known.clear()
                        known[s] = found
                ids.append(found)
        ids.append(struct.pack("<I", self.end))
        return b"".join(ids)


STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _encode(path: str, whole: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            got = [(i, m.decode(np.frombuffer(i, "<u4").tolist())) for i in (m.encode(t.as_py() or "") for t in batch.column("text"))]
            cols = [batch.column("doc_id"), pa.array([len(i) // 4 for i, _ in got], pa.int64())]
            if whole:
                ids = pa.array(np.frombuffer(b"".join(i for i, _ in got), "<u4").astype(np.int32))
                cols += [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(i) // 4 for i, _ in got)]).astype(np.int32)), ids), pa.array([t.decode() for _, t in got], pa.string())]
            else:
                cols += [pa.array([hashlib.sha256(x).hexdigest() for x in both], pa.string()) for both in zip(*got, strict=True)] if got else [pa.array([], pa.string())] * 2
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", *(["ids", "decoded"] if whole else ["ids_sha256", "decoded_sha256"])])

    return encode


def encode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_tokens, ids array<int> with begin and end ids, decoded string; with `digests`, the last two as
    SHA-256 of the ids (little-endian 32-bit) and of the decoded UTF-8.

    `path`: a merge-type model file on every executor. A null text is as an empty one: begin and end ids, decoded to "". A null or repeated doc_id changes
    nothing. An empty table gives no rows. Other columns are not looked at.
    """
    scratch.ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(path, not digests), schema)

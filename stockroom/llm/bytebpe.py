"""Byte-level BPE, encoding and decoding, by merging many matches at once in padded numpy matrices.

A text is cut by the tokenizer's pattern. Each distinct match of a task is encoded once: matches are dealt to matrices by length, one match a row, padded. In
every round each row merges its leftmost pair of the least rank; pairs are looked up in a hash table of all pairs that make a token. Rows with nothing left to
merge leave the matrix, and columns behind a merge move up. A match longer than `WIDEST` bytes is a row of its own, where one round merges all pairs of
the least rank from left to right, up to the first whose new neighbours have a lower rank: the same merges in the same order, in at most about as many rounds as there are tokens.

Ids of a text, their decimal form and the decoded bytes are ragged gathers from tables by match and by id.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Longest match, in bytes, that shares a matrix; cells of a matrix; matches that are worked on at once; matches and ids of them that are remembered.
WIDEST, CELLS, PART, MEMORY, MEMORY_IDS = 64, 1 << 19, 1 << 17, 1 << 18, 1 << 22
NONE, EMPTY, _GOLD = np.int32(2**31 - 1), np.int64(-2), np.uint64(0x9E3779B97F4A7C15)


def ragged(flat: np.ndarray, ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists `rows` of a ragged table, one after another, and each one's length."""
    n = (ptr[1:] - ptr[:-1])[rows]
    shift = ptr[rows] - (np.cumsum(n) - n)
    return flat[np.arange(int(n.sum())) + np.repeat(shift, n)], n


def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


class Pairs:
    """Hash table with open addressing: pair of ids -> id of what they merge to, which is its rank too."""

    def __init__(self, left: np.ndarray, right: np.ndarray, to: np.ndarray) -> None:
        bits = max(4, int(len(to)).bit_length() + 2)
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.to = np.full(1 << bits, EMPTY), np.full(1 << bits, NONE)
        key = left.astype(np.int64) << 32 | right
        at = self._home(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] == EMPTY)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.to[at[free]] = key[free], to[free]
            rest = np.ones(len(key), bool)
            rest[free] = False
            key, to, at = key[rest], to[rest], (at[rest] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _GOLD >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, of any shape; NONE where they make no token or one of the two is padding (below 0)."""
        key = np.where((left < 0) | (right < 0), np.int64(-1), left.astype(np.int64) << 32 | right)
        at = self._home(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.to[at], NONE)
        lost = np.flatnonzero((seen != key) & (seen != EMPTY))
        key, at = key.ravel()[lost], at.ravel()[lost]
        while len(lost):
            at = (at + 1) & self.mask
            seen = self.keys[at]
            hit = seen == key
            out.ravel()[lost[hit]] = self.to[at[hit]]
            on = ~hit & (seen != EMPTY)
            lost, key, at = lost[on], key[on], at[on]
        return out


def standins(pattern: str) -> dict[int, str]:
    """Characters that the regex library and tiktoken class differently, as they know different versions of Unicode: each with one that both class as tiktoken does."""
    import regex
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    alone = {bytes([b]): b for b in range(256)}
    mine, theirs = np.zeros(0x110000, np.int64), np.zeros(0x110000, np.int64)
    for i, one in enumerate(sorted(set(re.findall(r"\\[pP]\{\w+\}|\\[swd]", pattern)))):
        codec = tiktoken.Encoding("class", pat_str=one, mergeable_ranks=alone, special_tokens={})
        mine[[ord(c) for c in regex.findall(one, every)]] |= 1 << i
        theirs[[ord(c) for c in codec.decode_bytes(codec.encode_ordinary(every)).decode()]] |= 1 << i
    agreed = {int(k): chr(at) for k, at in zip(*np.unique(np.where(mine == theirs, theirs, -1)[128:], return_index=True), strict=True)}
    return {int(c): chr(ord(agreed[int(theirs[c])]) + 128) for c in np.flatnonzero(mine != theirs)}


class Codec:
    """Ids as the tiktoken library gives them for a file of ranks, without special tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        if lacking := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"{path}: no rank for byte {lacking[0]}")
        self.base = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes, self.decimals = _table(tokens), _table([b",%d" % i for i in range(len(tokens))])
        made = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        self.pairs = Pairs(*np.array(made, np.int32).reshape(-1, 3).T)
        self._cut, self._differ = regex.compile(pattern), standins(pattern)
        at = np.array(sorted(self._differ), np.int64)
        runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
        self._strange = re.compile("[" + "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs) + "]") if runs else None

    def matches(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches, PART at a time."""
        if self._strange is not None and not text.isascii() and self._strange.search(text):
            found = (text[m.start() : m.end()] for m in self._cut.finditer(text.translate(self._differ)))
        elif len(text) <= PART:
            if text:
                yield self._cut.findall(text)
            return
        else:
            found = (m.group() for m in self._cut.finditer(text))
        while part := list(islice(found, PART)):
            yield part

    def _matrix(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of rows of 1 to `width` bytes, all merged together, one pair a row and round."""
        length = np.array([len(r) for r in rows])
        ids = np.full((len(rows), width), np.int32(-1))
        ids[np.arange(width) < length[:, None]] = self.base[np.frombuffer(b"".join(rows), np.uint8)]
        rank = np.full((len(rows), width), NONE)
        rank[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        out, mine = [np.zeros(0, np.int32)] * len(rows), np.arange(len(rows))
        while len(mine):
            at = rank.argmin(1)
            least = rank[np.arange(len(mine)), at]
            for i in np.flatnonzero(least == NONE):
                out[mine[i]] = ids[i, : length[i]].copy()
            on = least != NONE
            if not on.all():
                mine, ids, rank, length, at, least = mine[on], ids[on], rank[on], length[on], at[on], least[on]
                if not len(mine):
                    break
            row, width = np.arange(len(mine)), int(length.max()) - 1
            ids[row, at] = least
            source = np.arange(width) + (np.arange(width) > at[:, None])
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            length = length - 1
            after = np.where(at + 1 < length, ids[row, np.minimum(at + 1, width - 1)], np.int32(-1))
            rank[row, at] = self.pairs.find(least, after)
            behind = np.flatnonzero(at > 0)
            rank[behind, at[behind] - 1] = self.pairs.find(ids[behind, at[behind] - 1], least[behind])
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """Ids of one row of any length."""
        ids = self.base[np.frombuffer(word, np.uint8)]
        rank = np.append(self.pairs.find(ids[:-1], ids[1:]), NONE)
        while len(ids) > 1 and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            run = np.cumsum(np.diff(at, prepend=-2) > 1) - 1  # of pairs that overlap, every second one is merged
            first = at[np.searchsorted(run, np.arange(run[-1] + 1))]
            at = at[(at - first[run]) % 2 == 0]
            joined = np.full(len(at), least)
            before = np.where(np.diff(at, prepend=-2) == 2, least, np.where(at > 0, ids[np.maximum(at - 1, 0)], np.int32(-1)))
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], np.int32(-1))
            lower = (self.pairs.find(before, joined) < least) | (self.pairs.find(joined, after) < least)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            at = at - np.arange(len(at))
            rank[at] = self.pairs.find(ids[at], np.append(ids, np.int32(-1))[at + 1])
            at = at[at > 0] - 1
            rank[at] = self.pairs.find(ids[at], ids[at + 1])
        return ids

    def words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each match. One that is a token itself is that token, whatever its merges give."""
        raw = [w.encode() for w in words]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            if (whole := self.ranks.get(r)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(r) > WIDEST:
                out[i] = self._long(r)
            else:
                buckets.setdefault(1 << (len(r) - 1).bit_length(), []).append(i)
        for width, mine in buckets.items():
            size = max(1, CELLS // width)
            for lo in range(0, len(mine), size):
                some = mine[lo : lo + size]
                for i, ids in zip(some, self._matrix([raw[i] for i in some], width), strict=True):
                    out[i] = ids
        return out


class Known(dict):
    """match -> its number; one not seen before gets the next, and waits in `new` to be encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes texts one after another and remembers the ids of matches, within a bound."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.ptr = Known(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of matches one after another, and how many each has."""
        if len(self.known) > MEMORY or len(self.flat) > MEMORY_IDS:
            self._forget()
        rows = np.fromiter(map(self.known.__getitem__, matches), np.int64, len(matches))
        if self.known.new:
            got = self.codec.words(self.known.new)
            self.flat = np.concatenate([self.flat, *got])
            self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum([len(g) for g in got])])
            self.known.new = []
        return ragged(self.flat, self.ptr, rows)

    def texts(self, texts: Iterator[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids): a text's ids in one or more pieces, in order; none for an empty text. Short texts are gathered and worked on together."""
        rows, sizes, held = [], [], []
        for row, text in enumerate(texts):
            for part in self.codec.matches(text):
                rows.append(row)
                sizes.append(len(part))
                held += part
                if len(held) >= PART:
                    yield from self._pieces(rows, sizes, held)
                    rows, sizes, held = [], [], []
        if held:
            yield from self._pieces(rows, sizes, held)

    def _pieces(self, rows: list[int], sizes: list[int], held: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        ids, n = self.ids(held)
        ends = np.cumsum(n)[np.cumsum(sizes) - 1]
        for row, piece in zip(rows, np.split(ids, ends[:-1]), strict=True):
            yield row, piece


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _encode(path: str, pattern: str, digests: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        encoder = Encoder(c)
        for batch in batches:
            count = np.zeros(batch.num_rows, np.int64)
            texts = (t.as_py() or "" for t in batch.column("text"))
            if digests:
                sums = [(hashlib.sha256(), hashlib.sha256()) for _ in range(batch.num_rows)]
                for row, ids in encoder.texts(texts):
                    listed = ragged(*c.decimals, ids)[0].tobytes()
                    sums[row][0].update(listed if count[row] else listed[1:])
                    sums[row][1].update(ragged(*c.bytes, ids)[0].tobytes())
                    count[row] += len(ids)
                cols = [pa.array([s[i].hexdigest() for s in sums], pa.string()) for i in (0, 1)]
            else:
                pieces: list[list[np.ndarray]] = [[] for _ in count]
                for row, ids in encoder.texts(texts):
                    pieces[row].append(ids)
                    count[row] += len(ids)
                whole = [np.concatenate(p) if p else np.zeros(0, np.int32) for p in pieces]
                cols = [pa.array(whole, pa.list_(pa.int32())), pa.array([ragged(*c.bytes, ids)[0].tobytes().decode("utf-8", "replace") for ids in whole], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), *cols], ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])])

    return encode


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_tokens, ids array<int> and decoded string; with `digests`, the last two as SHA-256 of the decimal
    ids joined by commas and of the decoded bytes.

    `path`: a file of ranks (base64 token, rank) on every executor; `pattern`: how texts are cut before merging. Strings of special tokens are ordinary text. A null
    text is as an empty one: no ids, decoded to "". A null or repeated doc_id changes nothing. An empty table gives no rows. Other columns are not
    looked at. Memory follows a batch of texts and the longest match, not a text's number of matches; without `digests`, also the longest text's ids.
    """
    scratch.ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(path, pattern, digests), schema)

"""Vectorised words, shingles and hashes over Arrow text columns.

A text column's bytes lie one after another in one buffer; everything here runs over that buffer with numpy, so no Python object is made for a
word. Hashes have 64 bits and depend on the bytes alone: not on the process, the batch or the place in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once. A longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_WIDE = _U(0xD1342543DE82EF95)  # odd: a base for polynomials mod 2^64
_WIDE_INV = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

OTHER = np.ones(256, bool)
OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def fold(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z, and U+00C0 to U+00DE in UTF-8, in lower case."""
    out = buf + ((buf >= 65) & (buf <= 90)) * np.uint8(32)
    after = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)
    out[1:][after] += 0x20
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _GOLD)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_WIDE, _WIDE_INV)):
            t = np.full(n, base, _U)
            t[0] = 1
            _powers[i] = np.cumprod(t, dtype=_U)
    return _powers


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) such that a slice holds `most` bytes, or one longer text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's place in them (one more than texts). A null is as an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    buf = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, ends - ends[0]


class Words:
    """Words of a slice of texts: maximal runs of bytes other than space and \\x09-\\x0D, never across texts.

    start, end: places in the buffer. ptr: words of text i are ptr[i]:ptr[i + 1]. doc: text of each word.
    """

    def __init__(self, texts: pa.Array, letters: bool = False, latin: bool = True) -> None:
        """With `letters`, words are runs of letters and digits instead (ASCII ones, or any byte of other characters), with case folded in Latin-1 if `latin`."""
        buf, ends = flat(texts)
        if letters and latin:
            buf = fold(buf)
        self.buf, self.ends = buf, ends
        n = len(buf)
        full = np.zeros(n + 1, bool)
        np.logical_not((OTHER if letters else SPACE)[buf], out=full[:n])
        first = np.empty(n + 1, bool)
        first[0] = True
        np.logical_not(full[: n], out=first[1:])
        first[ends] = True  # a text's first byte starts a word, and the byte before it ends one
        start = np.flatnonzero(full & first)
        last = np.empty(n + 1, bool)
        np.logical_not(full[1:], out=last[:n])
        last[n] = True
        last[ends[1:] - 1] = True
        end = np.flatnonzero(full & last) + 1
        self.start, self.end = start, end
        self.ptr = np.searchsorted(start, ends)
        self.counts = np.diff(self.ptr)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A hash for each word; with `lower`, A-Z as a-z."""
        if not len(self.start):
            return np.zeros(0, _U)
        up, down = _power_tables(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, _U)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.buf] * up[: len(self.buf)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(_U))


def windows(w: np.ndarray, ptr: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every k words in a row; with `short`, a text of 1 to k - 1 words gives one window of all it has."""
    counts = np.diff(ptr)
    n = len(w)
    if n >= k:
        acc = w[: n - k + 1].copy()
        for j in range(1, k):
            acc = acc * _WIDE + w[j : n - k + 1 + j]
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        out, doc = mix(acc[at] + _U(k)), doc[at]
    else:
        out, doc, at = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if short and len(few := np.flatnonzero((counts > 0) & (counts < k))):
        h = w[ptr[few]].copy()
        for j in range(1, k):
            more = counts[few] > j
            h[more] = h[more] * _WIDE + w[ptr[few][more] + j]
        out, doc, at = np.concatenate([out, mix(h + counts[few].astype(_U))]), np.concatenate([doc, few]), np.concatenate([at, ptr[few]])
        order = np.argsort(doc, kind="stable")
        out, doc, at = out[order], doc[order], at[order]
    return out, doc, at


def distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, ascending, and where they start (one more than texts). `doc` ascends."""
    ptr = np.searchsorted(doc, np.arange(docs + 1))
    parts = [np.unique(h[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    return (np.concatenate(parts) if parts else h[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)

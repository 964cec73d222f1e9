"""Packing documents into token sequences by minimum bin slack.

1. `pieces`: each document's ids and end id, cut if longer than a sequence, with the number each piece has among its task's pieces of the same
   length. Written to shared storage, so that these numbers hold.
2. `plan`: needs only how many pieces of each length there are, at most as many numbers as a sequence has places. For one bin after another, a
   bitset subset-sum over the lengths left finds the fullest feasible combination with the longest piece left; it is removed, as often in a row as
   the counts allow. Equal combinations cost one step, so the work follows the number of lengths, not of documents.
3. Each piece's number among all pieces of its length comes from counts by task; the plan turns it into a sequence and a place. No pieces are
   sorted or gathered.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

SIZE, END = 1024, 2
#: Fixed value: how byte-level BPE of this family cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, without special tokens added.

    Where the file's ids are the merges' ranks, the merging is done by tiktoken with these ranks: the same ids, several times faster.
    """

    def __init__(self, path: str) -> None:
        import tokenizers

        self._slow = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"].get("merges", [])]
        vocab, byte = spec["model"]["vocab"], _byte_of()
        self._fast = None
        if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and all(vocab.get(m) == 256 + i for i, m in enumerate(merges)):
            import tiktoken

            special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
            self._fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        if self._fast is not None:
            try:
                return self._fast.encode(text, allowed_special="all")
            except (Exception, BaseException) as e:  # noqa: BLE001  its regex gives up on very long runs; that comes as a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self._slow.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, size: int, end: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*enc.encode(text.as_py() or ""), end], "<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for col, v in zip(rows, (doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), seen[b - a]), strict=True):
                        col.append(v)
                    seen[b - a] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(rows, types, strict=True)), pa.array(np.full(len(rows[0]), task, np.int32))], ["doc_id", "piece", "start", "length", "ids_crc32", "number", "task"])

    return pieces


def fullest(counts: dict[int, int], size: int) -> dict[int, int]:
    """length -> copies of the fullest combination with the longest length left, by subset sums in the bits of an integer.

    Lengths are added from long to short and the search ends when the bin can be full; so of equally full combinations it takes long pieces, and
    keeps the short ones, which fill gaps.
    """
    seed = max(counts)
    room, reach, steps = size - seed, 1, []
    mask = (1 << (room + 1)) - 1
    for n in sorted(counts, reverse=True):
        most = min(counts[n] - (n == seed), room // n)
        if most <= 0:
            continue
        steps.append((n, most, reach))
        k = 1
        while most > 0:
            take = min(k, most)
            reach |= (reach << (take * n)) & mask
            most, k = most - take, 2 * k
        if reach >> room & 1:
            break
    left, found = reach.bit_length() - 1, {seed: 1}
    for n, most, before in reversed(steps):
        copies = next(c for c in range(min(most, left // n) + 1) if before >> (left - c * n) & 1)
        if copies:
            found[n] = found.get(n, 0) + copies
            left -= copies * n
    return found


def plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Rows (length, first number, first sequence, offset), by length and number: pieces of a length from that number on, up to the next row's, lie in
    consecutive sequences from that one on, at that offset."""
    left, taken, sequence, rows = {n: c for n, c in counts.items() if c}, dict.fromkeys(counts, 0), 0, []
    while left:
        found = fullest(left, size)
        times, offset = min(left[n] // c for n, c in found.items()), 0
        for n, copies in found.items():
            for _ in range(copies):
                rows.append((n, taken[n], sequence, offset))
                taken[n] += times
                offset += n
            left[n] -= copies * times
            if not left[n]:
                del left[n]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(rows: np.ndarray):
    lengths = rows[:, 0] << 44 | rows[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("number").to_numpy() + batch.column("before").to_numpy()
            r = rows[np.searchsorted(lengths, batch.column("length").to_numpy() << 44 | number, "right") - 1]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(r[:, 2] + number - r[:, 1]), pa.array(r[:, 3])], [*keep, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `docs` has doc_id and text; `tokenizer` is the path of a byte-level BPE file, on every executor. Each row of `docs` is a document of its own, also one
    that repeats a doc_id or has none. A null or empty text has the end id alone. A document of more than `size` ids is cut into pieces of
    `size`, the first of which is what is left over. Every sequence is filled from 0 without gaps. An empty table gives no rows. Other
    columns are not looked at.
    """
    scratch.ship(docs.sparkSession)
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer, size, end), "doc_id long, piece int, start long, length long, ids_crc32 long, number long, task int")
    pieces = scratch.save(pieces, "pieces")
    by_task = scratch.save(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    before = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    numbered = pieces.join(scratch.small_side(before, by_task.count(), 200_000), ["task", "length"])
    return numbered.mapInArrow(_place(plan(counts, size)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

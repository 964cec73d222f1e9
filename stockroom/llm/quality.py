"""Quality rules: counted base rules and compression bands.

Text that zstandard shrinks far more than other texts of its length repeats itself; text that it can't shrink is noise, codes or encoded bytes. Short texts
compress worse than long ones for the same kind of content, so the limits depend on length, and are taken from the corpus. Whole documents are measured, and chunks of even length
that cover all of a text: one outside its band shows a repetitive or random passage that the whole document's ratio hides.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, textvec

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


@dataclass(frozen=True)
class Bands:
    """Limits of compressed bytes over bytes.

    `documents`: (bytes, least, most) for whole texts, in between by the logarithm of the length, beyond the ends as there. Without it they follow from the texts themselves, as
    ratios of one corpus say little of another's: of the distinct texts of `short` bytes and more that pass the base rules, in each doubling of the length with `enough` of them, the limits lie
    `spreads` times as far from the median as the quartiles do (by 0.005 at least). So up to a quarter of junk of either kind moves no limit. Beyond the lengths with enough
    texts, limits widen by `slope` with each doubling; where no length has enough, `wide` holds, which no limit exceeds. `chunk`: for chunks of any text; far from what prose has, so that long texts don't fail by chance.

    A text is cut into bytes // chunk_bytes chunks, even to a byte, so each has chunk_bytes to 1.5 times as many and no tail is left over; one of fewer than two chunks is measured
    whole. A document is rejected if its ratio is outside its band, or if more than `bad_share` of its chunks are outside theirs. Texts of under `short` bytes are too short for a ratio to
    tell anything and have no band.
    """

    level: int = 3
    chunk_bytes: int = 512
    documents: tuple[tuple[float, float, float], ...] | None = None
    chunk: tuple[float, float] = (0.25, 0.80)
    bad_share: float = 0.0
    short: int = 256
    spreads: float = 6.0
    enough: int = 30
    slope: float = 0.03
    wide: tuple[float, float] = (0.15, 0.85)

    def limits(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most ratio of whole texts of these sizes; 0 and infinity below `short`."""
        at, least, most = zip(*(self.documents or ((self.short, *self.wide),)), strict=True)
        some, x = size >= self.short, np.log2(np.maximum(size, 1))
        return np.where(some, np.interp(x, np.log2(at), least), 0.0), np.where(some, np.interp(x, np.log2(at), most), np.inf)


def _failed(found: dict[str, np.ndarray]) -> np.ndarray:
    """Which texts the base rules reject."""
    return (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])


def _measure(bands: Bands):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """print, size and ratio (in ten thousandths) of the texts that limits are taken from."""
        import zstandard

        press = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        for batch in batches:
            for at, part in textvec.slices(batch.column("text")):
                buf, ends = textvec.flat(part)
                size = np.diff(ends)
                some = np.flatnonzero((size >= bands.short) & ~_failed(counts(part)))
                ratio = [round(10_000 * len(press.compress(buf[ends[i] : ends[i + 1]])) / int(size[i])) for i in some]
                yield pa.RecordBatch.from_arrays([batch.column("print").take(pa.array(some + at)), pa.array(size[some]), pa.array(ratio, pa.int32())], ["print", "size", "ratio"])

    return measure


def fit(docs: DataFrame, bands: Bands = Bands()) -> Bands:
    """`bands` with limits for whole texts that follow from the texts of `docs` (text): exact quartiles of all of them, from at most 10,000 numbers a length."""
    scratch.ship(docs.sparkSession)
    text = F.col("text").cast("string")
    seen = scratch.save(docs.select(F.xxhash64(text).alias("print"), text.alias("text")).mapInArrow(_measure(bands), "print long, size long, ratio int"), "measured")
    held = seen.distinct().groupBy(F.floor(F.log2("size")).cast("int").alias("doubling"), "ratio").agg(F.count("*").alias("n"))
    rows = held.groupBy("doubling").agg(F.sum("n").alias("n"), F.percentile("ratio", [0.25, 0.5, 0.75], F.col("n")).alias("q")).where(F.col("n") >= bands.enough).orderBy("doubling").collect()
    table = []
    for r in rows:  # one row a doubling of the length
        low, middle, high = (q / 10_000 for q in r["q"])
        table.append((2 ** (r["doubling"] + 0.5), max(bands.wide[0], middle - bands.spreads * max(middle - low, 0.005)), min(bands.wide[1], middle + bands.spreads * max(high - middle, 0.005))))
    if table:  # longer texts compress better, shorter ones worse
        table.insert(0, (table[0][0] / 8, table[0][1], min(bands.wide[1], table[0][2] + 3 * bands.slope)))
        table.append((table[-1][0] * 1024, max(bands.wide[0], table[-1][1] - 10 * bands.slope), table[-1][2]))
    return replace(bands, documents=tuple(table) or None)


def _repeats(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in it."""
    docs = len(ptr) - 1
    w, doc, at = textvec.windows(h, ptr, 3)
    if not len(w):
        return np.zeros(docs, np.int64)
    key = textvec.mix(w + doc.astype(np.uint64) * textvec._GOLD)
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    inside = np.zeros(len(h) + 3, bool)
    starts = at[order[twice]]
    for j in range(3):
        inside[starts + j] = True
    sums = np.concatenate([[0], np.cumsum(inside[: len(h)])])
    return sums[ptr[1:]] - sums[ptr[:-1]]


def _repeated_lines(words: textvec.Words) -> np.ndarray:
    """Lines of each text, cut at \\n, with a word, that equal an earlier line of it."""
    buf, ends = words.buf, words.ends
    docs, n = len(ends) - 1, len(buf)
    if not n:
        return np.zeros(docs, np.int64)
    breaks = np.flatnonzero(buf == 10)
    first = np.union1d(ends[:-1], breaks + 1)
    first = first[first < n]
    stop = np.append(first[1:], n)
    stop = stop - ((buf[stop - 1] == 10) & (stop > first))
    up, down = textvec._power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(textvec._BYTE[buf] * up[:n], out=sums[1:])
    h = textvec.mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64))
    full = np.searchsorted(words.start, first) < np.searchsorted(words.start, stop)
    doc = np.searchsorted(ends, first, "right") - 1
    h, doc = h[full], doc[full]
    key = textvec.mix(h + doc.astype(np.uint64) * textvec._GOLD)
    _, kept = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=docs) - np.bincount(doc[kept], minlength=docs)


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a slice."""
    words = textvec.Words(texts)
    buf, ends, docs = words.buf, words.ends, len(texts)
    per = lambda flags: (lambda c: c[ends[1:]] - c[ends[:-1]])(np.concatenate([[0], np.cumsum(flags)]))
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per(~textvec.SPACE[buf] & ~_CONTINUES[buf]) if docs else np.zeros(0, np.int64),
        "n_symbols": per(SYMBOLS[buf]) if docs else np.zeros(0, np.int64),
        "n_dup_lines": _repeated_lines(words),
        "n_repeat_words": _repeats(words.hashes(), words.ptr),
    }


def _rate(bands: Bands):
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        for batch in batches:
            for at, part in textvec.slices(batch.column("row").field("text")):
                found = counts(part)
                buf, ends = textvec.flat(part)
                whole, share, size = np.full(len(part), np.nan), np.full(len(part), np.nan), np.diff(ends)
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if b - a >= bands.short:
                        whole[i] = len(press.compress(buf[a:b])) / (b - a)
                        if (n := (b - a) // bands.chunk_bytes) > 1:  # else the whole text says as much
                            cuts = [a + (b - a) * j // n for j in range(n + 1)]
                            parts = (len(press.compress(buf[x:y])) / (y - x) for x, y in itertools.pairwise(cuts))
                            share[i] = sum(not bands.chunk[0] <= r <= bands.chunk[1] for r in parts) / n
                least, most = bands.limits(size)
                inside = np.isnan(whole) | ((whole >= least) & (whole <= most) & (np.nan_to_num(share) <= bands.bad_share))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(part)), *(pa.array(found[n].astype(np.int64)) for n in COUNTS), pa.array(size), *(pa.array(x, from_pandas=True) for x in (whole, share)), pa.array(inside)], ["row", *COUNTS, "n_bytes", "ratio", "bad_chunks", "inside"])

    return rate


def rate(docs: DataFrame, bands: Bands = Bands(), column: str = "quality") -> DataFrame:
    """All rows and columns of `docs`, with one more column: struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bytes, ratio, bad_chunks
    (share of chunks outside their band), inside (the bands' verdict), base_failed, kept. A column of `docs` with that name is replaced.

    Words are runs of bytes other than ASCII white space. base_failed: under 50 words, or over half of them in repeated 3-word windows. kept: not
    base_failed, and inside the bands, whose limits are fitted to `docs` unless `bands` has them. A null or blank text has no words: base_failed. Texts too short for a band have a null ratio; those of one
    chunk have null bad_chunks. Ids aren't looked at, so null or repeated ones change nothing. An empty table gives no rows.
    """
    scratch.ship(docs.sparkSession)
    bands = bands if bands.documents else fit(docs, bands)
    names = [c for c in docs.columns if c != column]
    rows = docs.select(F.struct(*(F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in names)).alias("row"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("n_bytes", T.LongType()), T.StructField("ratio", T.DoubleType()), T.StructField("bad_chunks", T.DoubleType()), T.StructField("inside", T.BooleanType())])
    out = rows.mapInArrow(_rate(bands), schema)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("inside"))
    return out.select("row.*", F.struct(*(c for c in out.columns if c != "row")).alias(column))

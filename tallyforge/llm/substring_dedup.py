"""Substring deduplication by difference-cover anchors.

A window is `window` consecutive words. Of each document, only shorter windows at the positions of a difference cover
modulo a period are hashed: whatever the offsets of a repeated window in two documents, one of these anchors lies at
the same place inside both copies. Where an anchor is shared, the match is extended to whole windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_array, bit_rows, frequent, has_bit, look_up, stored

#: Fixed values, perfect difference sets: each number modulo the period is the difference of two members.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
}
#: Bits in the filter of shared anchors for each of them, and the most in all: 64 MB. Beyond, more windows are candidates.
BITS_EACH, MOST_BITS = 16, 1 << 29
#: Documents handled at once in a task.
SLICE = 512
#: A null id comes after all others.
LAST = 2**63 - 1

#: Of the sums that runs of words are told apart by.
_BASES = (0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F)


def period(window: int) -> int:
    return max(v for v in COVERS if v <= max(3, window * 5 // 8))


class Rolling:
    """Hashes of the runs of words in a document: sums of word hashes times powers, wrapping round, then mixed."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: list[bytes]):
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        self.sums: dict[int, np.ndarray] = {}

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The powers of a base and of its inverse, n or more of each; kept for the next document."""
        own = cls._powers.get(base)
        if own is None or len(own[0]) <= n:
            both = [np.full(2 * n + 64, x, dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64))]
            for x in both:
                x[0] = 1
            own = cls._powers[base] = tuple(map(np.multiply.accumulate, both))
        return own

    def at(self, starts: np.ndarray, length: int, base: int = _BASES[0]) -> np.ndarray:
        """The 64-bit hashes of the runs of `length` words."""
        times, back = self.powers(base, len(self.hashes))
        if (sums := self.sums.get(base)) is None:
            sums = self.sums[base] = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.hashes * times[: len(self.hashes)], dtype=np.uint64)))
        x = (sums[starts + length] - sums[starts]) * back[starts]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x.view(np.int64)

    def check(self, starts: np.ndarray, length: int) -> np.ndarray:
        """32 more bits of each run, from sums of their own."""
        return (self.at(starts, length, _BASES[1]) >> 32).astype(np.int32)


def cover_positions(n: int, window: int) -> np.ndarray:
    """Where anchors start in a document of n words."""
    v = period(window)
    inside = np.zeros(v, dtype=bool)
    inside[list(COVERS[v])] = True
    return np.flatnonzero(np.resize(inside, max(0, n - (window - v))))


def _filter_bits(h, size: int) -> list:
    """The two bits of an anchor's hash, from 0, as columns or arrays."""
    return [h % size, (h // size) % size]


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                hashes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = (t or "").encode("utf-8", "surrogatepass").split()
                    if len(words) >= window:
                        h = np.unique(Rolling(words).at(cover_positions(len(words), window), window - period(window) + 1))
                        hashes.append(h)
                        ids.append(np.full(len(h), d, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(ids))], ["h", "d"])

    return docs.select("d", "_text").mapInArrow(run, "h long, d long")


def _candidates(docs: DataFrame, window: int, packed, size: int) -> DataFrame:
    """(h, g, d, k, at): hash, more bits of it, and start of each window that holds an anchor of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, v = packed.value, period(window)
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                out = [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int64, np.int64, np.int32)]
                for d, t, k in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    words = (t or "").encode("utf-8", "surrogatepass").split()
                    n = len(words)
                    if n < window:
                        continue
                    own, where = Rolling(words), cover_positions(n, window)
                    one, two = _filter_bits(own.at(where, window - v + 1) & LAST, size)
                    where = where[has_bit(bits, one) & has_bit(bits, two)]
                    if not len(where):
                        continue
                    change = np.zeros(n + 2, np.int32)
                    np.add.at(change, np.maximum(where - v + 1, 0), 1)
                    np.add.at(change, where + 1, -1)
                    starts = np.flatnonzero(np.cumsum(change)[: n - window + 1] > 0)
                    for x, y in zip(out, (own.at(starts, window), own.check(starts, window), np.full(len(starts), d, np.int64), np.full(len(starts), k, np.int64), starts.astype(np.int32)), strict=True):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["h", "g", "d", "k", "at"])

    return docs.select("d", "_text", "k").mapInArrow(run, "h long, g int, d long, k long, at int")


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the words left, joined by one blank).

    A word [^\\x20\\x09-\\x0D]+ goes if a window over it has the same words as a window that starts in a document with a
    smaller id, judged on the input. A null id counts as larger than all others, a null text as empty. Rows with the
    same id do not clear each other, and equal rows give equal results; an empty table gives none; further columns are
    not read. Windows are compared by 96 bits of hashes: among 10^13 of them, two different ones are taken for equal with a probability of 0.001.

    No pairs are made. Shared anchors (two ids or more) become a filter of at most MOST_BITS bits for the tasks; windows
    that hold one are counted by their hash, and a window goes if its id is larger than its hash's smallest.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"))
    base = base.select("doc_id", "_text", F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("doc_id", "_text").alias("k"))

    ends = [F.min("d").alias("lo"), F.max("d").alias("hi")]
    shared = stored(_anchors(base, window).groupBy("h").agg(*ends).filter("lo < hi").select(F.col("h").bitwiseAND(F.lit(LAST)).alias("h")))
    size = 1 << 20
    while size < min(MOST_BITS, BITS_EACH * shared.count()):
        size *= 2
    two = F.array(F.pmod(F.col("h"), F.lit(size)), F.pmod(F.expr(f"h div {size}"), F.lit(size)))
    packed = spark.sparkContext.broadcast(bit_array(bit_rows(shared.select(F.explode(two).alias("b")), F.col("b") + 1), size))

    rows = _candidates(base, window, packed, size).select(F.struct("h", "g").alias("h"), "d", "k", "at")
    first = stored(rows.groupBy("h").agg(*ends, F.count("*").alias("n")).filter("lo < hi").select("h", "lo", "n"))
    total = first.select(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = stored(first.filter(F.col("n") > max(total // 1000, 1)).select("h"))
    known = look_up(rows, first.select("h", "lo"), "h", often)
    covered = known.filter("lo < d").groupBy("k").agg(F.array_sort(F.collect_set("at")).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                counts, gone, kept = [], [], []
                for t, starts in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    words = t.encode("utf-8", "surrogatepass").split()
                    n = len(words)
                    left = words
                    if starts.is_valid:
                        # Rows meet again by a hash; a place that is none in this text is another row's.
                        at = starts.values.to_numpy()
                        at = at[at + window <= n]
                        change = np.zeros(n + 1, np.int32)
                        change[at] += 1
                        change[at + window] -= 1
                        left = [words[j] for j in np.flatnonzero(np.cumsum(change[:n]) == 0).tolist()]
                    counts.append(n)
                    gone.append(n - len(left))
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    joined = base.select("doc_id", "_text", "k").join(covered.hint("merge"), "k", "left").select("doc_id", "_text", "starts")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")

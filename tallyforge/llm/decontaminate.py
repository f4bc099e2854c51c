"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: A-Z to a-z; all other ASCII but digits and letters to a space; other bytes as they are.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of benchmark text whose search tables one scan of the documents holds; a larger benchmark takes more scans.
BLOCK_BYTES = 8_000_000
#: Words in a block of the shift table.
BLOCK = 2


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class WuManber:
    """Search for windows of `length` words of a text of word numbers.

    shift: for the last words of a position's window, how far the search may move on; without an entry, no window has
    that block and the whole window but one block is skipped. Where it may not move on, the entry names the bucket of the
    windows that end in the block: they are compared word by word. Windows are places in `words`; nothing is copied.
    """

    def __init__(self, length: int, words: np.ndarray, starts: np.ndarray, owners: np.ndarray, vocabulary: int):
        self.length, self.block, self.base = length, min(BLOCK, length), vocabulary + 1
        blocks = words.astype(np.int64) + 1
        for _ in range(self.block - 1):
            blocks = blocks[:-1] * self.base + words[len(words) - len(blocks) + 1 :] + 1
        last = blocks[starts + length - self.block]
        order = np.argsort(last, kind="stable")
        self.words, self.starts, self.owners = words.tolist(), starts[order].tolist(), owners[order].tolist()
        ends, first = np.unique(last[order], return_index=True)
        self.bounds = [*first.tolist(), len(starts)]
        # In the order of their shifts, so that a block's first entry is its least.
        keys = np.concatenate([blocks[starts + length - self.block - s] for s in range(length - self.block + 1)])
        every, at = np.unique(keys, return_index=True)
        self.shift = dict(zip(every.tolist(), (at // len(starts)).tolist(), strict=True)) | dict(zip(ends.tolist(), (-1 - np.arange(len(ends))).tolist(), strict=True))

    def find(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(first word, owner) of each occurrence; ids: word numbers, -1 for words that are in no window."""
        m, base, shift, skip = self.length, self.base, self.shift.get, self.length - self.block + 1
        end, n, two = m, len(ids), self.block == 2
        while end <= n:
            key = (ids[end - 2] + 1) * base + ids[end - 1] + 1 if two else ids[end - 1] + 1
            step = shift(key, skip)
            if step > 0:
                end += step
                continue
            own = ids[end - m : end]
            for k in range(self.bounds[-1 - step], self.bounds[-step]):
                if self.words[self.starts[k] : self.starts[k] + m] == own:
                    yield end - m, self.owners[k]
            end += 1


class Search:
    """The tables of some items (id, text), made once in each worker that they are sent to."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.items, self.window = items, window

    def __getstate__(self) -> dict:
        return {"items": self.items, "window": self.window}

    @cached_property
    def tables(self) -> tuple[dict[bytes, int], list[WuManber]]:
        vocabulary: dict[bytes, int] = {}
        flat: list[int] = []
        places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for owner, (_, text) in enumerate(self.items):
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            if ids:
                m = min(self.window, len(ids))
                places[m].append((len(flat), len(ids) - m + 1, owner))
                flat += ids
        text, machines = np.array(flat, np.int32), []
        for m, own in places.items():
            starts = np.concatenate([np.arange(a, a + n) for a, n, _ in own])
            machines.append(WuManber(m, text, starts, np.repeat([o for *_, o in own], [n for _, n, _ in own]), len(vocabulary)))
        return vocabulary, machines

    def ids(self, text: str | None) -> list[int]:
        known = self.tables[0].get
        return [known(w, -1) for w in words(text)]


def _scan(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Search(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        names = [i for i, _ in search.items]
        for b in batches:
            count, hit, found = [], [], []
            for t in b.column(1):
                own = search.ids(t.as_py())
                spans, owners = [], set()
                for machine in search.tables[1]:
                    for at, who in machine.find(own):
                        spans.append((at, at + machine.length))
                        owners.add(who)
                places: list[int] = []
                for a, z in sorted(spans):
                    places.extend(range(max(a, places[-1] + 1) if places else a, z))
                count.append(len(own))
                hit.append(places)
                found.append(sorted({names[o] for o in owners if names[o] is not None}))
            arrays = [b.column(0), pa.array(count, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), b.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "hit", "items", "_row"])

    return docs.mapInArrow(run, "doc_id long, n_words long, hit array<int>, items array<string>, _row long")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The benchmark's distinct items as (i, t), and into how many blocks they are dealt."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    total = items.select(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    return items, max(1, -(-total // block_bytes))


def _block(items: DataFrame, n: int, k: int) -> list[tuple[str | None, str | None]]:
    return [tuple(r) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def _hit(spark: SparkSession, items: list[tuple[str | None, str | None]], window: int):
    sent = spark.sparkContext.broadcast(Search(items, window))

    @F.arrow_udf("boolean")
    def hit(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = sent.value
        for batch in texts:
            found = []
            for t in batch:
                ids = search.ids(t.as_py())
                found.append(any(next(m.find(ids), None) for m in search.tables[1]))
            yield pa.array(found, pa.bool_())

    return hit


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a hit by `contamination`, all columns as they are; a null text has no hits and stays.

    A benchmark of several blocks is searched for block by block, each among the documents that the blocks before left.
    """
    items, n = _blocks(benchmark, item_col, item_text_col, block_bytes)
    for k in range(n):
        docs = docs.filter(~_hit(docs.sparkSession, _block(items, n, k), window)(F.col(text_col).cast("string")))
        docs = stored(docs) if k + 1 < n else docs
    return docs


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_words, hit (positions of hit words, ascending), items (ids of items found).

    A window is `window` consecutive words of an item; a shorter item, unless it has no words, is one window. A word of
    a document is hit where it lies inside an occurrence of any window. A null text has no words; an item without an
    id hits words but is named by none; repeated items count once; empty tables give no rows, or no hits. Texts are
    not shuffled. The benchmark's tables are sent to the tasks only up to `block_bytes` of text at once (or one item):
    a larger benchmark is dealt into blocks, each searched for in a scan of its own, and the scans' hits are united.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    items, n = _blocks(benchmark, item_col, item_text_col, block_bytes)
    if n == 1:
        return _scan(base.withColumn("_row", F.lit(0).cast("long")), _block(items, 1, 0), window).drop("_row")
    base = stored(base.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "_text")).select("doc_id", "_text", "_row")
    parts = []
    for k in range(n):
        parts.append(stored(_scan(base, _block(items, n, k), window)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return every.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), flat("hit").alias("hit"), flat("items").alias("items")).drop("_row")

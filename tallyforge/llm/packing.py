"""Order-preserving packing: windows cut by dynamic programming at document or sentence ends, with a monotone queue."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import LONG, REMEMBERED, byte_characters

#: Costs in tokens of padding: a cut at a sentence's end, one inside a sentence, and each sequence.
SENTENCE_CUT, INNER_CUT, SEQUENCE = 2.0, 8.0, 256.0
#: Inside a longer sentence, one may cut every so many tokens.
INNER_STEP = 24
#: Lengths that need no padding and are worth a sequence of their own.
UNPADDED = (256, 512, 1024)
#: Tokens laid out at once.
BLOCK = 1 << 18
#: Fixed value: how byte-level vocabularies of this kind cut texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode's white space. A chunk is what the vocabulary's own pattern never reaches over: one blank and the run after it.
_WS = "\t-\r \x85\xa0  -     　"
_CHUNKS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class Memory(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(chunk), "<u4").tobytes()
        if len(chunk) <= LONG:
            self[chunk] = ids
        return ids


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, as the tokenizers library gives them for a byte-level BPE.

    Texts are cut into chunks, and a chunk's ids are remembered. New chunks are encoded by tiktoken from the ranks of the
    same file: for strings of a few bytes, the tokenizers library takes ten times as long, with the same result.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        back = {c: b for b, c in byte_characters().items()}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.encode = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.sentence_end = np.zeros(max([*ranks.values(), *added.values()]) + 1, dtype=bool)
        for t, i in ranks.items():
            self.sentence_end[i] = t.endswith((b".", b"!", b"?")) or b"\n" in t
        self.memory = Memory(self.encode)

    def __call__(self, text: str) -> bytes:
        get = self.memory.__getitem__
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        if not (self.cut and any(s in text for s in self.special)):
            return b"".join(map(get, _CHUNKS.findall(text)))
        out = []
        for token, part in zip([None, *self.cut.findall(text)], self.cut.split(text), strict=True):
            out += [self.special[token]] if token else []
            out += map(get, _CHUNKS.findall(part))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(ids: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one document may be cut (counts of ids before the cut, the last at its end) and what each cut costs."""
    n = len(ids)
    at = np.flatnonzero(sentence_end[ids[: n - 1]]) + 1
    bounds = np.concatenate(([0], at, [n]))
    cost = np.full(len(at), SENTENCE_CUT)
    if (wide := np.flatnonzero(np.diff(bounds) > 2 * INNER_STEP)).size:
        inner = np.concatenate([np.arange(bounds[k] + INNER_STEP, bounds[k + 1] - INNER_STEP + 1, INNER_STEP) for k in wide])
        at, cost = np.concatenate((at, inner)), np.concatenate((cost, np.full(len(inner), INNER_CUT)))
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return np.append(at, n), np.append(cost, 0.0)


def windows(at: np.ndarray, cost: np.ndarray, size: int, unpadded: tuple[int, ...] = UNPADDED) -> list[int]:
    """Indexes into `at` of the cuts that end windows, for the least padding plus costs. at[0] is 0, gaps are at most size.

    best(j) = min over i with at[j] - at[i] <= size of best(i) + padding + cost[j]. The padding is size - (at[j] - at[i]),
    so the minimum of best(i) + at[i] over a sliding range is wanted: a queue with rising values keeps it. Lengths in
    `unpadded` have no padding; they are tried besides.
    """
    n = len(at)
    exact = []
    for length in unpadded:
        if length < size:
            i = np.searchsorted(at, at - length)
            exact.append(np.where(at[np.minimum(i, n - 1)] == at - length, i, -1).tolist())
    free = list(zip(*exact, strict=True)) if exact else [()] * n
    where, extra = at.tolist(), cost.tolist()
    best, origin = [0.0] * n, [0] * n
    queue, key, head = [0], [0.0] * n, 0
    for j in range(1, n):
        p = where[j]
        low = p - size
        while where[queue[head]] < low:
            head += 1
        i = queue[head]
        b = key[i] + size - p
        for k in free[j]:
            if k >= 0 and best[k] < b:
                b, i = best[k], k
        best[j] = b = b + extra[j] + SEQUENCE
        origin[j] = i
        key[j] = v = b + p
        while len(queue) > head and key[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(j)
        j = origin[j]
    return out[::-1]


class Packer:
    """Lays out a stream of documents block by block; a block's last window is laid out again with the next block."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence = size, first_sequence
        self.docs: list[list] = []  # [doc_id, bytes of ids, ids, ids laid out]
        self.at: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.total = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes, at: np.ndarray, cost: np.ndarray) -> None:
        self.docs.append([doc_id, ids, len(ids) // 4, 0])
        self.at.append(at + self.total)
        self.cost.append(cost)
        self.total += len(ids) // 4
        if self.total >= BLOCK:
            self.lay_out(last=False)

    def lay_out(self, last: bool) -> None:
        if not self.total:
            return
        at, cost = np.concatenate(([0], *self.at)), np.concatenate(([0.0], *self.cost))
        ends = windows(at, cost, self.size)
        if not last:
            ends.pop()
        begin, k = 0, 0
        for j in ends:
            end, offset = int(at[j]), 0
            while begin + offset < end:
                doc_id, ids, n, done = doc = self.docs[k]
                take = min(n - done, end - begin - offset)
                crc = zlib.crc32(memoryview(ids)[4 * done : 4 * (done + take)])
                self.rows.append((doc_id, done, take, crc, n, self.sequence, offset))
                doc[3] += take
                offset += take
                k += doc[3] == n
            begin = end
            self.sequence += 1
        self.docs = self.docs[k:]
        keep = ends[-1] + 1 if ends else 1
        self.at, self.cost, self.total = [at[keep:] - begin], [cost[keep:]], self.total - begin


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs the documents of its partition in their order, so nothing is shuffled and a lost task is done again
    alone; only a partition's last sequence is cut short by the partition. A null text is empty and gives `end_id` alone;
    null ids and repeated rows are documents like others; an empty table gives no rows; further columns are not read.
    path: the vocabulary's JSON file, there on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def rows() -> Iterator[pa.RecordBatch]:
            if packer.rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*packer.rows, strict=True)], names)
                packer.rows = []

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids = encode(text.as_py()) + end
                packer.add(doc_id.as_py(), ids, *cuts(np.frombuffer(ids, "<u4"), encode.sentence_end))
            yield from rows()
        packer.lay_out(last=True)
        yield from rows()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"))
    return base.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

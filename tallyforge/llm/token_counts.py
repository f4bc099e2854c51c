"""Token counts by heap-and-linked-list byte-pair merging: initial symbols minus merges, no identifiers."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries in a worker's memory of chunks and of words; it starts anew beyond that.
REMEMBERED = 400_000
#: Longer chunks are counted anew each time.
LONG = 64


def byte_characters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter:
    """Counts as the tokenizers library does for a lower-casing byte-level BPE with word ends, read from its JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        pre = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"] or not pre[0]["invert"]:
            raise ValueError(f"{path}: not a lower-casing byte-level vocabulary with word ends")
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # White space by Unicode's property, as the library's engine has it: Python's \s has U+001C to U+001F besides.
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"].replace("[^\\s", "[^\\p{White_Space}"))
        self.chunk = regex.compile(r"\P{White_Space}+")
        self.byte = byte_characters()
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of one word: pop the pair of lowest rank, leftmost first, join it in the linked list, push its new neighbours."""
        symbols: list[str | None] = [self.byte[b] for b in word.encode("utf-8", "replace")]
        symbols[-1] += self.end
        n, rank = len(symbols), self.rank
        after, before, count = list(range(1, n + 1)), list(range(-1, n - 1)), n
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been joined to another meanwhile
            symbols[i], symbols[j] = a + b, None
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(p := (symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, p))
            if (h := before[i]) >= 0 and (r := rank.get(p := (symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, p))
        return count

    def of_word(self, word: str) -> int:
        if (n := self.words.get(word)) is None:
            n = self.merged(word)
            if len(word) <= LONG:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = n
        return n

    def of_chunk(self, chunk: str) -> int:
        if (n := self.chunks.get(chunk)) is None:
            # The library lower-cases character by character: a capital sigma never becomes a final one.
            text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
            n = sum(map(self.of_word, self.pattern.findall(text.lower())))
            if len(chunk) <= LONG:
                if len(self.chunks) >= REMEMBERED:
                    self.chunks.clear()
                self.chunks[chunk] = n
        return n

    def __call__(self, text: str | None) -> int:
        total = 0
        if text and self.cut and any(s in text for s in self.special):
            total, parts = len(self.cut.findall(text)), self.cut.split(text)
        else:
            parts = [text or ""]
        for part in parts:
            # Words never reach over white space, so each chunk between it is counted by itself.
            chunks = self.chunk.findall(part) if _ODD.search(part) else part.split()
            total += sum(map(self.of_chunk, chunks))
        return total


_ODD = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    A null text is empty: no bytes, no tokens. Repeated rows and null ids give rows of their own; an empty table gives
    none; further columns are not read. No shuffle. path: the vocabulary's JSON file, there on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t.as_py()) for t in b.column(1)], pa.int64()), b.column(2)], ["doc_id", "n_tokens", "n_bytes"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = base.mapInArrow(run, "doc_id long, n_tokens long, n_bytes long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

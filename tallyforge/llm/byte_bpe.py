"""Byte-level BPE by a global shuffle of distinct words: each word is encoded once, whatever the number of its uses.

Texts are cut into pre-tokens in slices of some MB. A slice keeps, for each document, the numbers of its pre-tokens in
their positions, and its distinct pre-tokens go to the shuffle by word, already without their repeats, so that a very
frequent word has one row for each slice. Equal words meet in one task, in order, and are encoded once there; the ids
go back to the slices, which lie in buckets, and each document is put together by position there.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import bucketed
from .common import give_back

#: A slice ends with the document that brings it to so many characters, or to so many different words.
SLICE_CHARS, SLICE_WORDS = 1 << 25, 1 << 19
#: Documents whose numbers are packed together; words in one row.
SHEET_DOCS, ROW_WORDS = 512, 4096
#: Words of all slices that a task gathers before it sends ids back.
SENT_WORDS = 1 << 20
_CODEC = pa.Codec("zstd", compression_level=3)


def pattern(source: str) -> regex.Pattern:
    """A pattern of the tokenizer's kind: its white space is Unicode's property, while \\s here has U+001C to U+001F besides."""
    return regex.compile(source.replace("[^\\s", "[^\\p{White_Space}").replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def word_encoder(path: str):
    """The merges of one pre-token: the pattern takes any text as a whole."""
    return tiktoken.Encoding("word", pat_str="(?s:.+)", mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def token_bytes(path: str) -> pa.Array:
    """The bytes of each id, null where an id has none."""
    known = ranks(path)
    out: list[bytes | None] = [None] * (max(known.values()) + 1)
    for token, rank in known.items():
        out[rank] = token
    return pa.array(out, pa.binary())


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed byte plane by byte plane: most of the upper ones are zero."""
    return _CODEC.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T), asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_CODEC.decompress(blob, decompressed_size=4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Numbers(dict):
    """Each word's number, in the order of their first uses."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


#: A sheet has ids, counts (words of each document) and numbers; a word row has words in their order, each with its number.
_SLICES = "slice long, ids array<long>, counts array<int>, numbers binary, words array<string>, places array<int>"
_ROW = pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("numbers", pa.binary()), ("words", pa.list_(pa.string())), ("places", pa.list_(pa.int32()))])


def _slice_rows(at: int, words: list[str], ids: list, codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sheets and word rows of a slice. The most frequent word becomes number 0, so that most numbers are small."""
    row = lambda **values: pa.RecordBatch.from_pylist([{"slice": at} | values], _ROW)
    number = np.empty(len(words), np.uint32)
    number[np.argsort(-np.bincount(np.concatenate(codes), minlength=len(words)), kind="stable")] = np.arange(len(words))
    for i in range(0, len(ids), SHEET_DOCS):
        part = codes[i : i + SHEET_DOCS]
        yield row(ids=ids[i : i + SHEET_DOCS], counts=[len(c) for c in part], numbers=packed(number[np.concatenate(part)]))
    order = sorted(range(len(words)), key=words.__getitem__)
    for i in range(0, len(order), ROW_WORDS):
        part = order[i : i + ROW_WORDS]
        yield row(words=[words[k] for k in part], places=number[part].astype(np.int32))


def _cut(batches: Iterator[pa.RecordBatch], source: str, task: int) -> Iterator[pa.RecordBatch]:
    """Sheets and word rows of the documents (doc_id, text) of one task."""
    find = pattern(source).findall
    at, chars, known, ids, codes = task << 32, 0, Numbers(), [], []
    for b in batches:
        for doc_id, each in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = each.as_py()
            found = find(text)
            ids.append(doc_id)
            codes.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
            chars += len(text)
            if chars >= SLICE_CHARS or len(known) >= SLICE_WORDS:
                yield from _slice_rows(at, list(known), ids, codes)
                at, chars, known, ids, codes = at + 1, 0, Numbers(), [], []
                give_back()
    if ids:
        yield from _slice_rows(at, list(known), ids, codes)
    del known, ids, codes
    give_back()


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(slice, n, places, lengths, ids) of rows (slice, place, word) in the order of their words: a run of equal words is encoded once."""
    encode, word, ids = word_encoder(path), None, []
    sent: dict[int, tuple[list, list, list]] = {}
    n = 0

    def flush() -> pa.RecordBatch:
        rows = [(s, len(p), packed(np.array(p)), packed(np.array(k)), len(i), packed(np.array(i))) for s, (p, k, i) in sent.items()]
        sent.clear()
        return pa.RecordBatch.from_pylist([dict(zip(("slice", "n", "places", "lengths", "n_ids", "ids"), r, strict=True)) for r in rows], _SENT)

    for b in batches:
        for at, place, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if own != word:
                word, ids = own, encode(own)
            places, lengths, all_ids = sent.setdefault(at, ([], [], []))
            places.append(place)
            lengths.append(len(ids))
            all_ids += ids
            n += 1
        if n >= SENT_WORDS:
            yield flush()
            n = 0
    if sent:
        yield flush()
    give_back()


_SENT = pa.schema([("slice", pa.int64()), ("n", pa.int32()), ("places", pa.binary()), ("lengths", pa.binary()), ("n_ids", pa.int32()), ("ids", pa.binary())])


def _by_position(sheets: pa.Table, sent: pa.Table) -> pa.Table:
    """(doc_id, ids) of the documents of one slice."""
    rows = sent.to_pylist()
    n = sum(r["n"] for r in rows)
    first, length = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    flat, before = [], 0
    for r in rows:
        places, lengths = unpacked(r["places"], r["n"]), unpacked(r["lengths"], r["n"]).astype(np.int64)
        length[places] = lengths
        first[places] = before + np.cumsum(lengths) - lengths
        flat.append(unpacked(r["ids"], r["n_ids"]))
        before += r["n_ids"]
    flat = np.concatenate(flat) if flat else np.empty(0, "<u4")
    out = []
    for k in range(sheets.num_rows):  # a sheet is a batch of the result: neither side holds a slice's ids as a whole
        s = sheets.slice(k, 1).to_pylist()[0]
        counts = np.array(s["counts"], np.int64)
        numbers = unpacked(s["numbers"], int(counts.sum()))
        each = length[numbers]
        ends = np.concatenate(([0], np.cumsum(each)))
        tokens = flat[np.repeat(first[numbers] - ends[:-1], each) + np.arange(ends[-1])]
        cuts = ends[np.concatenate(([0], np.cumsum(counts)))]
        ids = [tokens[a:b].tobytes() for a, b in pairwise(cuts.tolist())]
        out.append(pa.RecordBatch.from_arrays([pa.array(s["ids"], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"]))
    return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))


def encode(docs: DataFrame, path: str, source: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers), as tiktoken's encode_ordinary gives them.

    Each match of the pattern `source` is encoded by itself by the ranks of the file `path`, which is there on every
    machine; what matches nothing is left out. A null text is empty and has no ids. Null ids and repeated rows are
    documents like others; an empty table gives no rows; further columns are not read. A very long text makes a slice
    of its own: a task holds one document, or SLICE_CHARS characters of several, at a time.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    cut = bucketed(base.mapInArrow(lambda batches: _cut(batches, source, TaskContext.get().partitionId()), _SLICES), "slice")
    words = cut.filter("words is not null").select("slice", F.explode(F.arrays_zip("places", "words")).alias("w"))
    by_word = words.select("slice", F.col("w.places").alias("place"), F.col("w.words").alias("word")).repartition("word").sortWithinPartitions("word")
    sent = by_word.mapInArrow(lambda batches: _encoded(batches, path), "slice long, n int, places binary, lengths binary, n_ids int, ids binary")
    sheets = cut.filter("ids is not null").select("slice", "ids", "counts", "numbers")
    out = sheets.groupBy("slice").cogroup(sent.groupBy("slice")).applyInArrow(_by_position, "doc_id long, ids binary")
    return out.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with `decoded`, the bytes of its ids: each id is joined with its row of the token-byte table.

    The table has one row for each token of the vocabulary and is the same file on every machine, so the join needs no
    shuffle and keeps the positions. A null in ids_col stays null; an id that the table does not have is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for b in (b.slice(i, SHEET_DOCS) for b in batches for i in range(0, b.num_rows, SHEET_DOCS)):
            out = []
            for blob in b.column(ids_col).to_pylist():
                ids = None if blob is None else np.frombuffer(blob, "<u4")
                tokens = None if blob is None else table.take(pa.array(np.minimum(ids, len(table) - 1)))
                if tokens is not None and (tokens.null_count or (ids >= len(table)).any()):
                    raise ValueError(f"{path} has no token for some id")
                out.append(None if tokens is None else joined(tokens))
            yield b.append_column("decoded", pa.array(out, pa.binary()))
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def joined(tokens: pa.BinaryArray) -> bytes:
    """All tokens one behind the other: they lie so in the array's buffer."""
    if not len(tokens):
        return b""
    offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    return tokens.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes()

"""Near-duplicates by pigeonring: op6's SimHash of word shingles, and the pipeline's fingerprints of shingle sets, whose links are confirmed by
the sets themselves; groups by connected components.

Two sets of similarity 0.8 differ in some ten of 64 SimHash bits, and no exact key of a ring with so many differences prunes anything. So the
pipeline's ring is made of minima, of which such sets share 80 in a hundred.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, frequent, give_back, look_up, stored

BITS = 64
#: Parts of a set's fingerprint, and the minima in each: two sets of similarity s agree in none of them with probability
#: (1 - s ** 4) ** 20, which is 3 in 100,000 at 0.8.
PARTS, MINIMA = 20, 4
#: Documents handled at once in a task.
SLICE = 512
#: Bits of each minimum in the ring, so that a segment, the minima of a part, has 16: a ring is RING longs. Two sets of similarity 0.8 differ in 32
#: of its 320 bits, with a deviation of 8; of 100,000 simulated pairs, 99.99 % meet by a part and keep its chain within this budget (all of them from 0.85
#: on), as do 15 % at 0.5 and 0.6 % at 0.4.
NIBBLE, RING, BUDGET = 4, 5, 72
#: Longs of a set's bit map, behind its ring: a shingle sets one of their bits.
MAP = 16
#: Members of a key up to which a join makes its pairs. In a key with more they are compared in blocks of ROOM hashes a side (4 MB).
FEW, ROOM = 64, 1 << 19
#: A null id comes after all others.
LAST = 2**63 - 1
#: Shingles whose hash bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit SimHash of the text's shingles of `width` words, as a signed long; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, hashes = xxhash.xxh64_intdigest, np.empty(n, dtype=np.uint64)
    runs = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    hashes[:] = np.fromiter((digest(b" ".join(x), 42) for x in runs), dtype=np.uint64, count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


#: A-Z to a-z, all else as it is.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, row_col: str | None = None) -> DataFrame:
    """(doc_id, _row, fp): fp as a signed long. A null or wordless text has fp 0. row_col: a column that numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], ["doc_id", "_row", "fp"])

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("_row"), F.col(text_col).cast("string").alias("_text"))
    return base.mapInArrow(run, "doc_id long, _row long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ring's segments. With 3 d + 1 segments, a chain's first three allow no difference."""
    m = 3 * distance + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _chain(x: Column, at: int, parts: list[tuple[int, int]], distance: int) -> Column:
    """Whether the chain from segment `at` keeps, over its first k segments for each k, to k * distance / m differences."""
    m, total, ok = len(parts), F.lit(0), F.lit(True)
    for k in range(1, m + 1):
        first, width = parts[(at + k - 1) % m]
        total = total + F.bit_count(F.shiftrightunsigned(x, first).bitwiseAND(F.lit((1 << width) - 1)))
        ok = ok & (total <= k * distance // m)
    return ok


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints `fp` that differ in at most `distance` bits, each pair once.

    By the pigeonring principle, some start on the ring of m segments has, for every k, at most k * distance / m
    differences in its k next segments. With m = 3 d + 1 its first three segments are equal: they are the join key (27
    of 64 bits for d = 2). The pair comes from the first start that holds; further segments prune before the full check.
    """
    parts = segments(distance)
    m = len(parts)

    def keys(name: str) -> DataFrame:
        each = []
        for i in range(m):
            mask = 0
            for j in range(3):
                first, width = parts[(i + j) % m]
                mask |= ((1 << width) - 1) << first
            mask = mask - (1 << BITS) if mask >> (BITS - 1) else mask
            each.append(F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
        return distinct.select(F.col("fp").alias(name), F.explode(F.array(*each)).alias("k")).select(name, "k.at", "k.key")

    left, right = keys("a"), keys("b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(None).cast("int")
    for i in reversed(range(m)):
        first = F.when(_chain(x, i, parts, distance), i).otherwise(first)
    close = (left["at"] == right["at"]) & (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (first == left["at"])
    return left.join(right, close & (F.bit_count(x) <= distance)).select("a", "b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root) for each node: the smallest `rank` of its component, where nodes is (fp, rank), ranks unique.

    Each round every node takes the smallest root among its neighbours', roots follow their neighbours' (hooking), and
    paths are shortened by look-up, so the rounds are about the logarithm of the longest chain. Every table is stored.
    """
    both = stored(edges.select(F.col("a").alias("fp"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("fp"), F.col("a").alias("other"))))
    linked = both.select("fp").distinct()
    label = stored(nodes.join(linked, "fp", "left_semi").select("fp", F.col("rank").alias("root")))
    n = label.count()
    while n:
        near = both.join(label.select(F.col("fp").alias("other"), F.col("root").alias("_near")), "other").groupBy("fp").agg(F.min("_near").alias("_near"))
        step = stored(label.join(near, "fp").select("fp", "root", F.least("root", "_near").alias("_best")))
        if step.filter("_best < root").isEmpty():
            break
        # A root goes where any of its members can go; then every member follows its root.
        hook = stored(step.groupBy("root").agg(F.min("_best").alias("_to")))
        for _ in range(2):  # a root's own target may have moved in this round
            up = hook.select(F.col("root").alias("_to"), F.col("_to").alias("_up"))
            hook = stored(look_up(hook, up, "_to", frequent(hook, "_to", hook.count())).select("root", F.coalesce(F.least("_up", "_to"), "_to").alias("_to")))
        label = stored(look_up(step, hook, "root", frequent(step, "root", n)).select("fp", F.col("_to").alias("root")))
    return nodes.join(label, "fp", "left").select("fp", F.coalesce("root", "rank").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (the smallest doc_id of its group), kept (one row of each group).

    Links are sought between different fingerprints only, so that copies cost nothing: one table row for each text
    class. Null ids take part; they name a group only if it has no other id (component_id is then null). Repeated rows
    give repeated rows, one of them kept at most; an empty table an empty result; further columns are not read. row_col: a
    column that numbers the rows; it is added to the result.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle, row_col))
    distinct = stored(fps.groupBy("fp").agg(_rank()))
    return _grouped(fps, distinct, stored(links(distinct.select("fp"), distance)), row_col)


def _rank() -> Column:
    """Null ids rank last."""
    return F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "_row")).alias("rank")


def _grouped(fps: DataFrame, distinct: DataFrame, edges: DataFrame, row_col: str | None) -> DataFrame:
    """The result of near_dedup from (doc_id, _row, fp), (fp, rank) and the links between different fp."""
    roots = components(distinct, edges).select("fp", F.nullif(F.col("root.id"), F.lit(LAST)).alias("component_id"), F.col("root._row").alias("_keep"))
    out = look_up(fps, stored(roots), "fp", frequent(fps, "fp", fps.count())).withColumn("kept", F.col("_row") == F.col("_keep"))
    return out.select("doc_id", "fp", "component_id", "kept", *([F.col("_row").alias(row_col)] if row_col else []))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles of `width` words, sorted; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n, width = max(1, len(words) - width + 1), min(width, len(words))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    return np.unique((out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))


_r = np.random.default_rng(20)
_TIMES, _PLUS = _r.integers(0, 1 << 64, (2, PARTS * MINIMA, 1), np.uint64)
_TIMES |= np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash of a set in each of PARTS * MINIMA orders."""
    least = np.full(PARTS * MINIMA, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        each = hashes[i : i + 1024] * _TIMES
        each += _PLUS  # in place: half the time
        np.minimum(least, each.min(1), out=least)
    return least


def parts_of(least: np.ndarray) -> list[int]:
    """The PARTS signed keys of a set: each of MINIMA minima."""
    rows = least.reshape(PARTS, MINIMA)
    return [xxhash.xxh64_intdigest(rows[k].tobytes(), k) - (1 << 63) for k in range(PARTS)]


def ring_of(least: np.ndarray) -> list[int]:
    """RING longs: NIBBLE bits of each minimum, so that part k is the k-th segment of 16 bits, from the lowest of the first long on."""
    nibbles = (least & np.uint64((1 << NIBBLE) - 1)).astype(np.uint8)
    return (nibbles[0::2] | nibbles[1::2] << np.uint8(NIBBLE)).view(np.int64).tolist()


def map_of(hashes: np.ndarray) -> list[int]:
    """MAP longs with the bit of each hash."""
    bits = np.zeros(MAP * 64, bool)
    bits[(hashes >> np.uint64(64 - (MAP * 64 - 1).bit_length())).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


def may_be_alike(a: str, b: str, least: float) -> Column:
    """The full Hamming check of two structs (n, bits): sizes that allow the similarity, rings that differ in BUDGET bits at most, and maps that allow it.

    The map's bound is exact: a bit that only one set has stands for one or more of its hashes that the other lacks, so they share no more than the rest.
    It tells short texts of 0.75 from those of 0.8, of which a group may have very many pairs.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")

    def counted(first: int, end: int, of: Callable[[Column, Column], Column]) -> Column:
        return sum((F.bit_count(of(F.col(f"{a}.bits")[i], F.col(f"{b}.bits")[i])) for i in range(first, end)), F.lit(0))

    differing = counted(0, RING, lambda x, y: x.bitwiseXOR(y))
    own, other = (counted(RING, RING + MAP, f) for f in (lambda x, y: x.bitwiseAND(F.bitwise_not(y)), lambda x, y: y.bitwiseAND(F.bitwise_not(x))))
    shared = F.least(n - own, m - other)
    return (F.least(n, m) / F.greatest(n, m) >= least) & (differing <= BUDGET) & (shared / (n + m - shared) >= least)


def in_chain(rows: DataFrame, a: str, b: str, at: str) -> DataFrame:
    """The rows whose rings a.bits and b.bits keep, from segment `at` on and over its next k segments for each k, to k * BUDGET / PARTS differences.

    With E(j) = differences before segment j less j * BUDGET / PARTS, that is: no E behind `at` is above E(at), and none before it is by more than
    the ring has left of its budget.
    """
    differing = [F.bit_count(F.shiftrightunsigned(F.col(f"{a}.bits")[k // 4].bitwiseXOR(F.col(f"{b}.bits")[k // 4]), 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))) for k in range(PARTS)]
    counted = rows.withColumn("_d", F.array(*differing))
    ahead = F.aggregate("_d", F.array(F.lit(0.0)), lambda out, d: F.concat(out, F.array(F.element_at(out, -1) + d - BUDGET / PARTS)))
    counted = counted.withColumn("_e", ahead)
    own = F.get("_e", F.col(at))
    behind = F.array_max(F.slice("_e", F.col(at) + 2, PARTS)) <= own + 1e-9
    before = F.array_max(F.slice("_e", F.lit(1), F.col(at) + 1)) + F.element_at("_e", -1) <= own + 1e-9
    return counted.filter(behind & before).drop("_d", "_e")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows, so that a task holds the sets of no more."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, _row, fp, n, keys, bits) of docs (doc_id, _row, _text): fp a hash of the whole set, n its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            fps, sizes, keys, bits = [], [], [], []
            for t in b.column(2):
                hashes = shingle_set(t.as_py(), width)
                least = minima(hashes)
                fps.append(xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63))
                sizes.append(len(hashes))
                keys.append(parts_of(least) if len(hashes) else [])
                bits.append(ring_of(least) + map_of(hashes))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, bits)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "_row", "fp", "n", "keys", "bits"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, _row long, fp long, n long, keys array<long>, bits array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(fp, hashes) of texts (fp, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = pa.array([shingle_set(t.as_py(), width).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["fp", "hashes"])
        give_back()

    return texts.mapInArrow(run, "fp long, hashes array<long>")


def _pairs(found: DataFrame, other: str, own: str, others: str, least: float) -> DataFrame:
    """(a, b), a < b, each once and stored, of rows (fp, other, at) whose rings `own` and `others` hold a chain from their segment `at` on."""
    near = in_chain(found.filter((F.col("fp") != F.col(other)) & may_be_alike(own, others, least)), own, others, "at")
    return stored(near.select(F.least("fp", other).alias("a"), F.greatest("fp", other).alias("b")).distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b), stored, whose sets have a Jaccard similarity of at least `least`."""
    n = pairs.count()
    for name in ("a", "b"):
        side = sets.select(F.col("fp").alias(name), F.col("hashes").alias(f"_{name}"))
        pairs = look_up(pairs, side, name, frequent(pairs.select("a", "b"), name, n))
    both = F.size(F.array_intersect("_a", "_b"))
    return stored(pairs.filter(both / (F.size("_a") + F.size("_b") - both) >= least).select("a", "b"))


def _first_links(rows: pa.Table, least: float) -> pa.Table:
    """(a, b): the links between the two sides of a block, rows (own, fp, at, n, bits, root, main, hashes), by the tests of a join's pairs and then
    by the sets themselves. Of a set's links to one component the first is given: the others would join the same two components."""

    def side(own: bool) -> tuple:
        t = rows.filter(pc.equal(rows.column("own"), own))
        bits = t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, RING + MAP)  # bits of signed numbers are those of their sizes
        sets = t.column("hashes").combine_chunks()
        begin = np.append(0, np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False)))
        return *(t.column(c).to_numpy() for c in ("fp", "n", "root", "main")), np.ascontiguousarray(bits[:, :RING]).view(np.uint16), bits[:, RING:], sets.flatten().to_numpy(), begin

    *left, own_hashes, own_begin = side(True)
    fp, n, root, main, ring, bitmap, hashes, begin = side(False)
    known, number = np.unique(np.concatenate((own_hashes, hashes)), return_inverse=True)
    own_number, number = number[: len(own_hashes)], number[len(own_hashes) :]
    at, mark, out = rows.column("at")[0].as_py(), np.zeros(len(known), bool), []
    for i, (a, size, own_root, _, own_ring, own_map) in enumerate(zip(*left, strict=True)):
        differing = np.bitwise_count(ring ^ own_ring)
        own, other = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (own_map & ~bitmap, bitmap & ~own_map))
        shared = np.minimum(size - own, n - other)
        near = (np.minimum(n, size) / np.maximum(n, size) >= least) & (differing.sum(1, dtype=np.int64) <= BUDGET) & (shared / (n + size - shared) >= least)
        near = np.flatnonzero(near & (root != own_root) & ((root == main) | (a < fp)))
        # As in in_chain.
        ahead = np.cumsum(np.concatenate((np.zeros((len(near), 1)), differing[near] - BUDGET / PARTS), 1), 1)
        near = near[(ahead[:, at + 1 :].max(1) <= ahead[:, at] + 1e-9) & (ahead[:, : at + 1].max(1) + ahead[:, -1] <= ahead[:, at] + 1e-9)]
        mine = own_number[own_begin[i] : own_begin[i + 1]]
        mark[mine] = True
        both = np.fromiter((np.count_nonzero(mark[number[begin[j] : begin[j + 1]]]) for j in near), np.int64, len(near))
        mark[mine] = False
        linked = near[both / (size + n[near] - both) >= least]
        out += [(min(a, b), max(a, b)) for b in fp[linked[np.unique(root[linked], return_index=True)[1]]].tolist()]
    return pa.table({name: pa.array([x[k] for x in out], pa.int64()) for k, name in enumerate("ab")})


def _block_links(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b), stored, between the members of keys with many of them, of rows (key, fp, at, root, _main, _a, _m, _left, _n) and sets (fp, hashes).

    Each block of members outside a key's main component meets each block of all its members in a task of its own, which holds no more than
    their sets; no pair becomes a row before it is a link.
    """
    blocks = lambda count: F.ceil(F.col(count) * F.col("_n") / ROOM).cast("int")
    rows = rows.join(sets, "fp").withColumns({"_lefts": blocks("_left"), "_rights": blocks("_m")})
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    dealt = lambda count: F.pmod(F.xxhash64("fp"), F.col(count)).cast("int")
    columns = ["fp", "at", "_a.n", "_a.bits", "root", F.col("_main").alias("main"), "hashes"]
    left = rows.filter("root <> _main").select("key", dealt("_lefts").alias("_l"), every("_rights").alias("_r"), F.lit(True).alias("own"), *columns)
    right = rows.select("key", every("_lefts").alias("_l"), dealt("_rights").alias("_r"), F.lit(False).alias("own"), *columns)
    found = left.unionByName(right).groupBy("key", "_l", "_r").applyInArrow(lambda block: _first_links(block, least), "a long, b long")
    return stored(found.distinct())


def similar_links(docs: DataFrame, distinct: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b) between the sets of distinct (fp, rank, n, keys, bits) that are alike by `least`; with them, the components are
    those of all candidates, sets that share a key.

    In a group of m copies not all m * m pairs are made: first each with the first of every key, then with the one that has most
    links so far, and last those of a key that are in different components still and whose rings allow the similarity: by a join where a key has
    few members, in blocks where it has many. Each pair meets by a part that both share, the first segment of a chain, and is compared only if the
    chain holds over the whole ring.
    """
    keys = stored(distinct.select("fp", F.col("rank._row").alias("_row"), F.posexplode("keys").alias("at", "key")))
    often = frequent(keys, "key", keys.count())
    # No set is in more rows of these two joins than it has keys.
    maps = lambda name, own: distinct.select(F.col("fp").alias(name), F.struct("n", "bits").alias(own))
    each = keys.groupBy("key").agg(F.count("*").alias("_m"), F.min(F.struct("_row", "fp")).alias("_first")).filter("_m > 1")
    firsts = stored(each.select("key", F.col("_first.fp").alias("other")).join(maps("other", "_b"), "other"))
    members = stored(look_up(keys, firsts, "key", often).filter("other is not null").join(maps("fp", "_a"), "fp"))
    wanted = stored(members.select("fp", F.col("_row").alias(ROW)).distinct())

    def made(fps: DataFrame) -> DataFrame:
        """The sets of fps. Most sets are not asked for; the rows of those that are, two numbers each, go to the tasks by their size, or Spark joins by a shuffle."""
        rows = stored(wanted.join(fps.distinct(), "fp", "left_semi"))
        return stored(_sets(docs.join(rows, ROW).select("fp", "_text"), shingle))

    either = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("fp"))
    tested = _pairs(members, "other", "_a", "_b", least)
    found = _confirmed(tested, made(either(tested)), least)

    members = members.select("fp", "at", "key", "_a")
    degree = either(found).groupBy("fp").agg(F.count("*").alias("_d"))
    best = stored(members.join(stored(degree), "fp").groupBy("key").agg(F.max(F.struct("_d", "fp", "_a")).alias("_best")))
    near = look_up(members, best, "key", often).filter("_best is not null")
    more = stored(_pairs(near.withColumn("other", F.col("_best.fp")), "other", "_a", "_best._a", least).join(tested, ["a", "b"], "left_anti"))
    tested, found = stored(tested.union(more)), stored(found.union(_confirmed(more, made(either(more)), least)))

    roots = stored(components(distinct.select("fp", "rank"), found).select("fp", F.col("root._row").alias("root")))
    members = stored(members.join(roots, "fp"))
    each = members.groupBy("key", "root").agg(F.count("*").alias("count"), F.max("_a.n").alias("_n")).groupBy("key")
    main = each.agg(F.max_by("root", "count").alias("_main"), F.sum("count").alias("_m"), (F.sum("count") - F.max("count")).alias("_left"), F.max("_n").alias("_n")).filter("_left > 0")
    open_ = stored(look_up(members, main, "key", often).filter("_main is not null"))
    many = open_.filter(F.col("_m") > FEW)
    found = stored(found.union(_block_links(many, made(many.select("fp")), least)))
    few = open_.filter(F.col("_m") <= FEW)
    left = few.filter("root <> _main").select("key", "at", "fp", "root", "_a")
    right = few.select("key", F.col("fp").alias("other"), F.col("root").alias("_root"), "_main", F.col("_a").alias("_b"))
    apart = (F.col("root") != F.col("_root")) & ((F.col("_root") == F.col("_main")) | (F.col("fp") < F.col("other"))) & may_be_alike("_a", "_b", least)
    rest = in_chain(left.join(right, (left["key"] == right["key"]) & apart), "_a", "_b", "at")
    once = stored(rest.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
    return stored(found.union(_confirmed(once, made(either(once)), least)))


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, row_col: str = ROW) -> DataFrame:
    """Like near_dedup, with fp a hash of the text's set of shingles and links where two sets have a Jaccard similarity of at least `least`.

    Texts with the same set are one class: of equal rows one is kept, and null, empty and blank texts, which have no shingles, are one group. A
    text of fewer words is one shingle of them all; a very long one is read whole, by one task. Candidates share a part of their rings (see PARTS);
    every link is confirmed by the sets themselves. Null ids take part and come last; an empty table gives no rows; further columns are not read.
    row_col: a column that numbers the rows of docs, which are stored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(row_col).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    sketches = stored(_sketches(base, shingle))
    distinct = stored(sketches.groupBy("fp").agg(_rank(), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")))
    edges = similar_links(base.select(F.col("_row").alias(ROW), "_text"), distinct, shingle, least)
    return _grouped(sketches.select("doc_id", "_row", "fp"), distinct.select("fp", "rank"), edges, row_col)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

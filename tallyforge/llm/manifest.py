"""A Merkle manifest of a data set: a digest of each row, of each tree of rows and of all trees, and each row's proof.

Rows are leaves in an order of their own within each tree; every `fan` consecutive nodes become their digest, level by
level, until one is left. Leaves are numbered by a range partitioning, and aligned blocks of fan ** DEPTH nodes are gone
through each by itself: a postorder recursion returns the digest of a subtree and appends its siblings to the leaves in
it while it unwinds. The roots of the blocks are the leaves of the next such pass, so a tree of any size takes
log(rows) / log(fan ** DEPTH) passes, and no task holds more than a block.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Levels of the tree in a block: 4096 nodes for a fan of 2.
DEPTH = 12
#: The siblings at one level, on either side, as joined digests of 32 bytes; both empty where a run has one node.
PATH = "array<struct<left: binary, right: binary>>"
_PATH = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the columns in a row: `-` for null, else the value's byte count, `:` and the value."""
    text = [F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in columns]
    return F.sha2(F.concat(*(F.coalesce(t, F.lit("-")) for t in text)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    hexed = lambda b: F.lower(F.hex(b))
    return F.aggregate(path, leaf, lambda held, at: F.sha2(F.concat(hexed(at["left"]), held, hexed(at["right"])), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda at: F.lower(F.concat(F.hex(at["left"]), F.hex(at["right"])))), ""), 256)


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with `at`, the place in the tree from 0, and `size`, the nodes of the tree; stored on the way.

    A range partitioning by tree and order, so that a tree with most rows is spread over the tasks; then each task's
    share of each tree is counted, which makes no more rows than there are trees and tasks.
    """
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = stored(ranged.withColumn("_id", F.monotonically_increasing_id())).withColumn("_task", F.shiftright("_id", 33))
    shares = ranged.groupBy("tree", "_task").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    size = F.sum("_n").over(Window.partitionBy("tree"))
    shares = stored(shares.select("tree", "_task", shift.alias("_shift"), size.alias("size")))
    out = ranged.join(shares, ["tree", "_task"]).withColumn("at", F.col("_id") + F.col("_shift"))
    return out.drop("_id", "_task", "_shift")


def _traverse(digests: list[bytes], fan: int, height: int) -> tuple[bytes, list[list[tuple[bytes, bytes]]]]:
    """The digest of a block's subtree of that height, and each node's siblings from the lowest level up."""
    paths: list[list[tuple[bytes, bytes]]] = [[] for _ in digests]

    def digest(low: int, high: int, height: int) -> bytes:
        if not height:
            return digests[low]
        step = fan ** (height - 1)
        parts = [(i, min(i + step, high)) for i in range(low, high, step)]
        found = [digest(*part, height - 1) for part in parts]
        for k, (first, end) in enumerate(parts):
            siblings = b"".join(found[:k]), b"".join(found[k + 1 :])
            for leaf in range(first, end):
                paths[leaf].append(siblings)
        return sha256(b"".join(found).hex().encode()).digest()

    return digest(0, len(digests), height), paths


def _levels(nodes: DataFrame, fan: int, depth: int) -> list[DataFrame]:
    """The passes from the leaves up, each stored: nodes (tree, at, size, digest, ...) with `path` in their block and `root` of the block."""
    span, out = fan**depth, []

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        size, height = table["size"][0].as_py(), 0
        while height < depth and fan**height < size:
            height += 1
        root, paths = _traverse(table["digest"].to_pylist(), fan, height)
        more = pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], _PATH)
        return table.append_column("path", more).append_column("root", pa.array([root] * len(paths), pa.binary()))

    while True:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
        by_block = nodes.groupBy("tree", F.floor(F.col("at") / span).alias("_block"))
        out.append(stored(by_block.applyInArrow(block, f"{schema}, path {PATH}, root binary")))
        ends = (F.col("at") % span == 0) & (F.col("size") > span)
        nodes = out[-1].filter(ends).select("tree", F.expr(f"at div {span}").alias("at"), F.ceil(F.col("size") / span).alias("size"), F.col("root").alias("digest"))
        if nodes.isEmpty():
            return out


def _joined(levels: list[DataFrame], span: int, name: str, above: DataFrame | None = None, more: list[str] = ()) -> DataFrame:
    """The rows of the lowest level with their whole `path` and `name`, the root of their tree; with above (tree, path, more), the path goes on there.

    The joins are on blocks, so no key has more rows than a block has nodes.
    """
    upper = None
    for level in reversed(levels):
        # Trees of one block end here.
        ends = level.filter((F.col("at") == 0) & (F.col("size") <= span)).select("tree", F.lit(0).cast("long").alias("_block"), F.col("root").alias(name))
        if above is None:
            ends = ends.withColumn("_up", F.array().cast(PATH))
        else:
            ends = ends.join(above.withColumnRenamed("path", "_up"), "tree")
        if upper is not None:
            ends = ends.unionByName(stored(upper.select("tree", F.col("at").alias("_block"), name, F.col("path").alias("_up"), *more)))
        upper = level.drop("root").withColumn("_block", F.expr(f"at div {span}")).join(stored(ends), ["tree", "_block"])
        upper = upper.withColumn("path", F.concat("path", "_up")).drop("_up", "_block")
    return upper


def manifest(docs: DataFrame, columns: list[str], tree_col: str, order_col: str = "doc_id", more: dict[str, Column] | None = None, fan: int = 2, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs: order_col as it is, tree_col, leaf, subroot and root (lowercase hexadecimal), path, and the columns `more`.

    leaf is leaf_digest of `columns`. Within each tree leaves ascend by order_col, a null first, then by their digest,
    so equal rows change nothing by their order. Every `fan` consecutive nodes become their digest, and fewer at the
    end, even one, until one is left: the tree's subroot, a lone leaf as it is. The subroots, by tree_col, a null
    first, else by its UTF-8 bytes, are made the root in the same way. path leads from a leaf to its siblings level by
    level, through the subroot to the root; see `folded`. Null values and empty and very long texts have digests like
    others; an empty table gives no rows; columns that are not named are not read, whatever their names. `more` may not
    take the names tree, at, size, digest, path and root.
    """
    tree = F.when(F.col(tree_col).isNotNull(), F.concat(F.lit("="), F.col(tree_col).cast("string"))).otherwise("")
    leaves = docs.select(tree.alias("tree"), F.col(order_col).alias("_order"), F.unhex(leaf_digest(*(F.col(c) for c in columns))).alias("digest"), *(c.alias(n) for n, c in (more or {}).items()))
    span = fan**depth
    levels = _levels(_numbered(leaves, ["_order", "digest"]), fan, depth)
    tops = None
    for level in levels:
        own = level.filter((F.col("at") == 0) & (F.col("size") <= span)).select(F.lit("").alias("tree"), F.col("tree").alias("_name"), F.col("root").alias("digest"))
        tops = own if tops is None else tops.unionByName(own)
    top = _joined(_levels(_numbered(tops, ["_name"]), fan, depth), span, "root")
    above = stored(top.select(F.col("_name").alias("tree"), "path", F.col("root").alias("_top")))
    out = _joined(levels, span, "subroot", above, ["_top"])
    hexed = lambda c: F.lower(F.hex(c))
    return out.select(
        F.col("_order").alias(order_col),
        F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1)).alias(tree_col),
        hexed("digest").alias("leaf"),
        hexed("subroot").alias("subroot"),
        hexed("_top").alias("root"),
        "path",
        *(more or {}),
    )

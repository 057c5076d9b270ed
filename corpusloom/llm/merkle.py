"""Merkle manifest of a table: a hash tree for each language over its rows in the order of doc_id, and one over the languages' roots.

Superblock reduction: a node's index, divided by fanout ** LEVELS, names its superblock. One applyInPandas call
collapses LEVELS levels of a superblock (at most fanout ** LEVELS rows, whatever the table's size) into its root and
gives each of its nodes the siblings met on the way. Roots of superblocks are the nodes of the next reduction, until
each tree has one node. Coming down again, each node's lower proof is joined with its superblock's upper proof.

Indices come from a range sort: a row's place in its partition, and the rows of its tree in earlier partitions, which
are sums over one row for each partition and tree. No tree is ever in one task, however large one language is.

Cases: a null in a column is `-` in the leaf's input; a null doc_id comes first in its language and is never tampered with;
repeated doc_ids stand in the order of their leaves, and equal rows are leaves of their own with one digest. Rows
without lang form the first tree. An empty table gives no rows. Columns besides the five take no part; their names don't matter.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Levels that one call collapses, and children of a node.
LEVELS, FANOUT = 10, 2


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of one row: each value with the length of its UTF-8 form before it."""
    value = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in value]), 256)


def run_of(i: int, n: int, fanout: int) -> range:
    """The indices of the run that node i of n belongs to."""
    first = i // fanout * fanout
    return range(first, min(first + fanout, n))


def fold(node: str, proof: str, places: list[tuple[int, int]], fanout: int) -> str:
    """The root that follows from a node, its siblings in order, and its (index, nodes) in each tree from the lowest up."""
    used = 0
    for i, n in places:
        while n > 1:
            parts = []
            for j in run_of(i, n, fanout):
                if j == i:
                    parts.append(node)
                else:
                    parts.append(proof[used : used + 64])
                    used += 64
            node, i, n = digest("".join(parts)), i // fanout, -(-n // fanout)
    return node


def collapse(nodes: list[str], n: int, levels: int, fanout: int) -> tuple[str, list[str]]:
    """The root of one superblock, whose tree has n nodes, and each of its nodes' siblings on the way to it."""
    proofs, level = [[] for _ in nodes], nodes
    owners = [[k] for k in range(len(nodes))]
    for _ in range(levels):
        if n == 1:
            break
        above, held = [], []
        for at in range(0, len(level), fanout):
            run = level[at : at + fanout]
            for j in range(len(run)):
                beside = "".join(run[:j] + run[j + 1 :])
                for k in owners[at + j]:
                    proofs[k].append(beside)
            above.append(digest("".join(run)))
            held.append([k for o in owners[at : at + fanout] for k in o])
        level, owners, n = above, held, -(-n // fanout)
    return level[0], ["".join(p) for p in proofs]


def indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, written, with `_idx` (place in the order within their `_tree`) and `_n` (rows of that tree)."""
    keys = ["_tree", *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    ordered = common.written(ordered.withColumn("_part", F.shiftright("_mid", 33)), "merkle-order")
    counts = common.written(ordered.groupBy("_tree", "_part").agg(F.min("_mid").alias("_from"), F.count("*").alias("_rows")), "merkle-counts")
    tree = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_tree", "_part", (before - F.col("_from")).alias("_shift"), F.sum("_rows").over(tree).alias("_n"))
    found = ordered.join(counts, ["_tree", "_part"])
    return found.withColumn("_idx", F.col("_mid") + F.col("_shift")).drop("_mid", "_part", "_shift")


def reduced(nodes: DataFrame, levels: int, fanout: int) -> list[DataFrame]:
    """One table for each reduction: (_tree, _idx, _n, _block, _node, _proof, _root); _root is null but for the first node of a superblock.

    In the last table each tree has one superblock, whose root is the tree's.
    """
    size, tables = fanout**levels, []
    ddl = "_tree string, _idx bigint, _n bigint, _block bigint, _node string, _proof string, _root string"

    def one(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_idx")
        root, proofs = collapse(block["_node"].tolist(), int(block["_n"].iloc[0]), levels, fanout)
        return block.assign(_proof=proofs, _root=[root] + [None] * (len(block) - 1))[["_tree", "_idx", "_n", "_block", "_node", "_proof", "_root"]]

    while True:
        blocks = nodes.select("_tree", "_idx", "_n", F.floor(F.col("_idx") / size).cast("bigint").alias("_block"), "_node")
        tables.append(common.written(blocks.groupBy("_tree", "_block").applyInPandas(one, ddl), "merkle-level"))
        most = tables[-1].agg(F.max("_n")).first()[0]
        if most is None or most <= size:
            return tables
        left = F.ceil(F.col("_n") / size).cast("bigint")
        nodes = tables[-1].where(F.col("_root").isNotNull()).select("_tree", F.col("_block").alias("_idx"), left.alias("_n"), F.col("_root").alias("_node"))


def descended(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """The nodes of the first table with their whole proofs: (_tree, _idx, _n, _node, _proof), and what `top` has for each _tree.

    top's column _proof goes on above each tree's root. A join's key has at most one superblock of rows.
    """
    above = top.withColumn("_block", F.lit(0).cast("bigint")).withColumnRenamed("_proof", "_upper")
    extra = [c for c in top.columns if c not in ("_tree", "_proof")]
    for table in reversed(tables):
        found = table.drop("_root").join(above, ["_tree", "_block"])
        found = found.select("_tree", "_idx", "_n", "_node", F.concat("_proof", "_upper").alias("_proof"), *extra)
        above = found.select("_tree", F.col("_idx").alias("_block"), F.col("_proof").alias("_upper"), *extra)
    return found


def manifest(rows: DataFrame, order: list[str], levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """rows (with _tree and _leaf) and, for each: its place, subroot, root, and its proof, the siblings' digests from the leaf to the root.

    The table is written in between: what is read must not change until this returns.
    """
    rows = common.written(indexed(rows, order), "merkle-leaves")
    trees = reduced(rows.select("_tree", "_idx", "_n", F.col("_leaf").alias("_node")), levels, fanout)
    subroots = trees[-1].where(F.col("_root").isNotNull()).select(F.col("_tree").alias("_name"), F.col("_root").alias("_node"), F.lit("").alias("_tree"))
    subroots = common.written(indexed(subroots, ["_name"]), "merkle-subroots")
    forest = reduced(subroots.select("_tree", "_idx", "_n", "_node"), levels, fanout)
    root = forest[-1].where(F.col("_root").isNotNull()).select("_tree", F.lit("").alias("_proof"), F.col("_root").alias("root"))
    top = descended(forest, root).join(subroots.select("_idx", F.col("_name")), "_idx")
    top = top.select(F.col("_name").alias("_tree"), "_proof", "root", F.col("_node").alias("subroot"), F.col("_idx").alias("_tree_idx"), F.col("_n").alias("_trees"))
    return rows.join(descended(trees, top).drop("_n", "_node"), ["_tree", "_idx"])


def folded(leaf: Column, proof: Column, places: list[Column], fanout: int = FANOUT) -> Column:
    """The root recomputed from a leaf; places: index and nodes of its tree, then of the tree of subroots."""

    def run(leaf: pd.Series, proof: pd.Series, i: pd.Series, n: pd.Series, j: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([fold(x, p, [(a, b), (c, d)], fanout) for x, p, a, b, c, d in zip(leaf, proof, i, n, j, m, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(leaf, proof, *places)


def verified(docs: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """One row for each of docs: its leaf, roots, the digest of its proof, and what its proof says of the row as it may have been tampered with.

    Where 7 divides the crc32 of doc_id's decimal text, the row is held against the tree with 1 added to n_chars.
    """
    doc = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.coalesce(F.crc32(doc[0].cast("string")) % 7 == 0, F.lit(False))
    more = F.col("n_chars").cast("decimal(20,0)") + F.when(changed, 1).otherwise(0)
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    leaves = docs.select("doc_id", tree.alias("_tree"), leaf(*doc).alias("_leaf"), F.when(changed, leaf(*doc[:3], more.cast("decimal(20,0)"), doc[4])).alias("_changed"))
    found = manifest(common.written(leaves, "merkle-rows"), ["doc_id", "_leaf"], levels, fanout)
    held = F.coalesce("_changed", "_leaf")
    found = found.withColumn("folded_root", folded(held, F.col("_proof"), [F.col(c) for c in ("_idx", "_n", "_tree_idx", "_trees")], fanout))
    return found.select(
        "doc_id", F.col("_leaf").alias("leaf"), "subroot", "root", F.sha2(F.col("_proof"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )

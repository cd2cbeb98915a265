"""Merkle manifest of a dataset: a tree over the rows of each language, a tree over the languages, a proof for each row.

Rows are sorted by language and id over ranges, and numbered from the counts of the ranges. Aligned blocks of leaves are
worked on one by one: the nodes above a block are the leaves of the next level, so that trees of any height are a few
rounds of bounded blocks. Inside a block, fractal traversal emits the authentication paths one after another: the block's
tree is cut into levels of small subtrees, of which one each is at hand (existing) while the one to its right grows by two
steps a leaf (desired). The path of a block itself, found the same way a level higher, is appended to those of its leaves.

A step of a proof is `<` or `>` and the sibling that stands left or right, or `=` where a node has none.

Edge cases: every null field is `-`; a null language is a language of its own, first in order; rows without an id come
before the others, rows alike in id are ordered by leaf, wholly equal rows each are a leaf; an empty table has no root and
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Scratch

#: Heights of a block and of the subtrees within it.
BLOCK_HEIGHT = 10
SUBTREE_HEIGHT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def parent(left: bytes, right: bytes) -> bytes:
    """The digest of a run of two, of one where the right is missing; none of a run of none."""
    return hashlib.sha256(left + right).hexdigest().encode() if left else b""


def block_height(n: int, most: int = BLOCK_HEIGHT) -> int:
    """How high the blocks of a tree of n leaves are: as high as blocks go, unless the tree is lower."""
    return min(most, (n - 1).bit_length())


class Growing:
    """A subtree that grows by a leaf or a node at a time. It keeps its nodes of heights low to high - 1; lower ones are on
    a stack of one node a height only."""

    def __init__(self, leaves: Sequence[bytes], low: int, high: int, first: int) -> None:
        self.leaves, self.low, self.high = leaves, low, high
        self.at, self.end = first, first + (1 << high)
        self.nodes: dict[tuple[int, int], bytes] = {}
        self.stack: list[tuple[int, int, bytes]] = []

    def add(self, height: int, index: int, node: bytes) -> None:
        self.stack.append((height, index, node))
        if node and self.low <= height < self.high:
            self.nodes[height, index] = node

    def grow(self, steps: int) -> None:
        for _ in range(steps):
            if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
                (height, index, left), (_, _, right) = self.stack[-2:]
                del self.stack[-2:]
                self.add(height + 1, index >> 1, parent(left, right))
            elif self.at < self.end:
                self.add(0, self.at, self.leaves[self.at] if self.at < len(self.leaves) else b"")
                self.at += 1
            else:
                return


def top(leaves: Sequence[bytes], height: int) -> bytes:
    """The digest over a block: its lone node after `height` rounds."""
    nodes = list(leaves)
    for _ in range(height):
        nodes = [parent(nodes[k], nodes[k + 1] if k + 1 < len(nodes) else b"") for k in range(0, len(nodes), 2)]
    return nodes[0]


def paths(leaves: Sequence[bytes], height: int, subtree: int = SUBTREE_HEIGHT) -> Iterator[list[bytes]]:
    """For each leaf its siblings from height 0 up, empty where there is none. At hand are two small subtrees a level."""
    cuts = [(low, min(low + subtree, height)) for low in range(0, height, subtree)]
    existing = []
    for low, high in cuts:
        first = Growing(leaves, low, high, 0)
        first.grow(2 << high)
        existing.append(first.nodes)
    desired = [Growing(leaves, low, high, 1 << high) for low, high in cuts[:-1]]
    for s in range(len(leaves)):
        yield [existing[k // subtree].get((k, (s >> k) ^ 1), b"") for k in range(height)]
        for i, (low, high) in enumerate(cuts[:-1]):
            if (s + 1) % (1 << high) == 0:
                existing[i] = desired[i].nodes
                desired[i] = Growing(leaves, low, high, s + 1 + (1 << high))
            desired[i].grow(2)


def steps_of(path: list[bytes], index: int) -> list[str]:
    """A path as steps that can be followed without knowing the leaf's place."""
    return [("<" if index >> k & 1 else ">") + side.decode() if side else "=" for k, side in enumerate(path)]


def follow(leaf: str, steps: Sequence[str]) -> str:
    """The root that a leaf and a proof lead to."""
    node = leaf
    for step in steps:
        node = hashlib.sha256((step[1:] + node if step[0] == "<" else node + step[1:]).encode()).hexdigest()
    return node


@F.pandas_udf(StringType())
def folded(leaf: pd.Series, steps: pd.Series) -> pd.Series:
    """The root that a leaf and its proof lead to."""
    return pd.Series([follow(x, s) for x, s in zip(leaf, steps, strict=True)], dtype=object)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def _positions(rows: DataFrame, group: str, order: list[Column], scratch: Scratch, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with part and nth, runs): rows in order over ranges, each with its range and its place there; for each range
    and group, where the group begins there and how many of its rows there are in it."""
    spread = F.monotonically_increasing_id()  # rows alike in everything are dealt to several ranges, too
    sorted_ = rows.withColumn("spread", spread).orderBy(F.col(group).asc_nulls_first(), *order, "spread").drop("spread")
    numbered = scratch(sorted_.withColumn("at", F.monotonically_increasing_id()), label)
    numbered = numbered.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")).drop("at")
    return numbered, scratch(numbered.groupBy(group, "part").agg(F.min("nth").alias("first"), F.count("*").alias("here")), f"{label}-runs")


def _placed(numbered: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """numbered with pos, the place in the group. runs has a row for each range and group, so no group is in one place."""
    before = F.sum("here").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0)))
    runs = runs.withColumnRenamed(group, "of").withColumnRenamed("part", "in")
    return numbered.join(runs, (F.col("part") == F.col("in")) & F.col(group).eqNullSafe(F.col("of"))).withColumn("pos", F.col("nth") - F.col("first") + F.col("before")).drop("part", "nth", "first", "here", "before", "in", "of")


def _climb(level: DataFrame, scratch: Scratch, height: int, label: str) -> list[DataFrame]:
    """Levels of (tree, pos, node, n), from the leaves to one node a tree. n: how many nodes the tree has in that level."""

    def up(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n = int(block["n"].iloc[0])
        node = top([x.encode() for x in block["node"]], block_height(n, height)).decode()
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "node": [node], "n": [-(-n >> height)]})

    levels = [level]
    while (level.agg(F.max("n")).first()[0] or 1) > 1:
        nodes = level.select("tree", F.shiftright("pos", height).alias("block"), "pos", "node", "n")
        level = scratch(nodes.groupBy("tree", "block").applyInPandas(up, "tree long, pos long, node string, n long"), f"{label}-{len(levels)}")
        levels.append(level)
    return levels


def _descend(levels: list[DataFrame], upper: DataFrame, scratch: Scratch, height: int, label: str) -> DataFrame:
    """The leaves' rows with their proofs: their block's own path, then what leads from the block on. upper: (tree, pos,
    steps, ...) of the last level; its other columns are handed down, too."""
    more = [f for f in upper.schema.fields if f.name not in ("tree", "pos", "steps")]
    handed = [f.name for f in more]

    def down(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos").reset_index(drop=True)
        there = above.iloc[0]
        tall = block_height(int(block["n"].iloc[0]), height)
        rest = list(there["steps"])
        block["steps"] = [steps_of(p, s) + rest for s, p in enumerate(paths([x.encode() for x in block["node"]], tall))]
        for name in handed:
            block[name] = there[name]
        return block.drop(columns=["n", "block"])

    for k in range(len(levels) - 2, -1, -1):
        nodes = levels[k].withColumn("block", F.shiftright("pos", height))
        fields = [f for f in levels[k].schema.fields if f.name != "n"]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*fields, *more]) + ", steps array<string>"
        upper = nodes.groupBy("tree", "block").cogroup(upper.groupBy("tree", "pos")).applyInPandas(down, schema)
        if k:
            upper = scratch(upper.drop("node"), f"{label}-proofs-{k}")
    return upper


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", by: str = "lang", carry: dict[str, Column] | None = None, height: int = BLOCK_HEIGHT) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot of its group, root, steps (its proof), and the columns in carry,
    which are made from docs (strings)."""
    scratch = Scratch()
    extra = {f"carry{k}": (name, c) for k, (name, c) in enumerate((carry or {}).items())}  # can't clash with the columns in between
    ident = docs[id_col].cast("long").cast("string").alias("doc_id")  # pandas would make numbers with nulls floats
    rows = docs.select(docs[by].cast("string").alias("group"), ident, leaf(*(docs[c] for c in fields)).alias("node"), *(c.cast("string").alias(k) for k, (_, c) in extra.items()))
    rows = scratch(rows, "rows")  # the sort below looks at its input twice
    numbered, runs = _positions(rows, "group", [F.col("doc_id").cast("long").asc_nulls_first(), F.col("node").asc()], scratch, "leaves")
    groups = runs.groupBy("group").agg(F.sum("here").alias("size")).withColumn("all", F.lit(0))
    listed, parts = _positions(groups, "all", [F.col("group").asc_nulls_first()], scratch, "groups")
    trees = scratch(_placed(listed, parts, "all").select(F.col("group").alias("named"), F.col("pos").alias("tree"), F.col("size").alias("n")), "trees")
    runs = runs.join(trees, F.col("group").eqNullSafe(F.col("named"))).drop("named")
    leaves = scratch(_placed(numbered, runs, "group").select("tree", "pos", "node", "n", "doc_id", *extra), "nodes")
    own = _climb(leaves, scratch, height, "tree")
    lone = own[-1].select("tree", F.col("node").alias("subroot"))
    n_trees = trees.count()
    shared = _climb(lone.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("subroot").alias("node"), F.lit(n_trees).cast("long").alias("n")), scratch, height, "top")
    root = shared[-1].select("node").first()  # one node is left
    start = shared[-1].select("tree", "pos", F.array().cast("array<string>").alias("steps"))
    proofs = _descend(shared, start, scratch, height, "top") if len(shared) > 1 else start
    proofs = proofs.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "steps").join(lone, "tree")
    if len(own) > 1:
        out = _descend(own, scratch(proofs, "subroots"), scratch, height, "tree")
    else:  # each tree is a lone leaf
        out = leaves.join(proofs.drop("pos"), "tree")
    named = (F.col(k).alias(name) for k, (name, _) in extra.items())
    out = out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("node").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "steps", *named)
    return scratch.keep(out, "manifest")


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf of a row whose n_chars grew by one where 7 divides the CRC-32 of its decimal id, else its own."""
    hit = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 7 == 0, F.lit(False))
    n = F.when(hit, docs["n_chars"] + 1).otherwise(docs["n_chars"])
    return leaf(docs["doc_id"], docs["source"], docs["lang"], n, docs["text"])


def audit(docs: DataFrame) -> DataFrame:
    """The manifest's digests, and whether each row, some of them tampered with, still leads to the root."""
    out = manifest(docs, carry={"shown": tampered_leaf(docs)})
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.substring(s, 2, 64)), ""), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded("shown", "steps").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

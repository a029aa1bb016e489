"""Merkle dataset manifest: a hash tree over each source's documents, and a tree over the sources.

A leaf hashes a document's fields; every three consecutive nodes become the hash of their
digests (the last run of a level may hold fewer, even one), until one is left. Leaves are dealt
out in aligned blocks of 3^7. A first pass makes each block's root; blocks of roots make the levels
above, in as many rounds as a block's levels fit into the tree's height. Going down
again, a block gets the path of its own root and emits its leaves' authentication paths by fractal
traversal: for every two levels it keeps the subtree that is in use and builds the next
one, a leaf at a time, so what it holds beside its leaves are some dozens of digests.

Sources may be of any size: leaves get their ranks by ranges of (source, id), and no step holds more
than a block. Paths grow with the logarithm of the number of documents.

Null fields are hashed as ``-``. A null source is a source, and comes first; null ids come first
in their source. Rows with one id are ordered by their digests; repeated rows are leaves of their own.
Without rows there is no root and no result. Other columns are not part of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallytree.functions.ordering import ranked
from tallytree.llm.common import documents, id_crc, stored

ARITY = 3
#: Levels of a block: 2187 leaves are what a task holds at a time.
BLOCK_LEVELS = 7
BLOCK = ARITY**BLOCK_LEVELS
#: Levels of each of the subtrees that are stacked in a block.
SUBTREE_LEVELS = 2
PATH = "array<struct<left:string,right:string>>"
_PATH = pa.struct([("left", pa.string()), ("right", pa.string())])


def digest_of(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Subtree:
    """The nodes of levels low to top - 1 below the index-th node of level top, built leaf by leaf."""

    def __init__(self, leaves: list[str], low: int, top: int, index: int):
        self.leaves, self.low, self.top, self.index = leaves, low, top, index
        self.at = index * ARITY**top
        self.end = min(len(leaves), self.at + ARITY**top)
        self.open: list[list[str]] = [[] for _ in range(top)]
        self.nodes: list[list[str]] = [[] for _ in range(low, top)]
        self.root = ""

    def step(self) -> None:
        """Takes in one leaf; after the last one, runs that are not full are closed."""
        if self.at >= self.end:
            return
        self._add(0, self.leaves[self.at])
        self.at += 1
        if self.at == self.end:
            for level in range(self.top):
                if self.open[level]:
                    self._close(level)

    def complete(self) -> Subtree:
        while self.at < self.end:
            self.step()
        return self

    def _add(self, level: int, digest: str) -> None:
        if level == self.top:
            self.root = digest
            return
        if level >= self.low:
            self.nodes[level - self.low].append(digest)
        self.open[level].append(digest)
        if len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._add(level + 1, digest_of(*run))

    def siblings(self, leaf: int, level: int) -> tuple[str, str]:
        """What stands left and right of the leaf's node of a level in its run."""
        node = leaf // ARITY**level - self.index * ARITY ** (self.top - level)
        first = node // ARITY * ARITY
        nodes = self.nodes[level - self.low]
        return "".join(nodes[first:node]), "".join(nodes[node + 1 : first + ARITY])


def traversal(leaves: list[str], levels: int, step: int = SUBTREE_LEVELS) -> Iterator[list[tuple[str, str]]]:
    """Each leaf's (left, right) siblings, level by level, in the order of the leaves."""
    spans = [(low, min(low + step, levels)) for low in range(0, levels, step)]
    existing = [Subtree(leaves, low, top, 0).complete() for low, top in spans]
    desired = [Subtree(leaves, low, top, 1) for low, top in spans]
    for leaf in range(len(leaves)):
        yield [tree.siblings(leaf, level) for tree in existing for level in range(tree.low, tree.top)]
        for k, (low, top) in enumerate(spans):
            desired[k].step()
            if (leaf + 1) % ARITY**top == 0:  # the next subtree took as many steps as this one has leaves
                existing[k], desired[k] = desired[k], Subtree(leaves, low, top, desired[k].index + 1)


def _levels_of(block: pa.Table) -> int:
    return min(BLOCK_LEVELS, height(block["n"][0].as_py()))


def _block_roots(nodes: DataFrame, key: str) -> DataFrame:
    """key, rank, n, digest of the nodes BLOCK_LEVELS above."""

    def work(block: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        levels = _levels_of(block)
        root = Subtree(block["digest"].to_pylist(), levels, levels, 0).complete().root
        first = block.slice(0, 1)
        up = pa.array([first["rank"][0].as_py() // BLOCK], pa.int64()), pa.array([-(-first["n"][0].as_py() // BLOCK)], pa.int64())
        return pa.table([first[key], *up, pa.array([root])], names=[key, "rank", "n", "digest"])

    rows = nodes.select(key, "rank", "n", "digest", F.expr(f"rank div {BLOCK}").alias("_block"))
    return rows.groupBy(key, "_block").applyInArrow(work, rows.drop("_block").schema)


def climbed(nodes: DataFrame, key: str) -> list[DataFrame]:
    """nodes (key, rank, n, digest), and the blocks' roots above until each key has one."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        levels.append(stored(_block_roots(levels[-1], key), "roots"))
    return levels


def descended(levels: list[DataFrame], top: DataFrame, key: str) -> DataFrame:
    """levels[0] with path and top's other columns; top: key, rank, path and others, of the last level's nodes."""
    carried = [c for c in top.columns if c not in (key, "rank", "path")]
    for nodes in reversed(levels[:-1]):
        top = _paths(nodes, top.select(key, "rank", "path", *carried), key, carried)
    return top


def _paths(nodes: DataFrame, above: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """nodes with their paths: siblings in the block by traversal, then the path of the block's root."""
    columns = nodes.columns

    def work(block: pa.Table, root: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        upper = root["path"][0].as_py()
        high_left, high_right = [x["left"] for x in upper], [x["right"] for x in upper]
        left: list[str] = []
        right: list[str] = []
        levels = _levels_of(block)
        for path in traversal(block["digest"].to_pylist(), levels):
            left += [x[0] for x in path] + high_left
            right += [x[1] for x in path] + high_right
        ends = pa.array(np.arange(len(block) + 1, dtype=np.int32) * (levels + len(upper)))
        paths = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(_PATH)))
        same = [root[c].combine_chunks().take(pa.array(np.zeros(len(block), np.int64))) for c in carried]
        return pa.table([*(block[c] for c in columns), paths, *same], names=[*columns, "path", *carried])

    schema = StructType([*nodes.schema.fields, *(above.schema[c] for c in ("path", *carried))])
    blocks = nodes.withColumn("_block", F.expr(f"rank div {BLOCK}")).groupBy(key, "_block")
    return blocks.cogroup(above.withColumnRenamed("rank", "_block").groupBy(key, "_block")).applyInArrow(work, schema)


def authentication_paths(leaves: DataFrame) -> DataFrame:
    """leaves (source, doc_id, digest and others) with path, subroot and root.

    path: for each level from the leaf to the root, the digests left and right of the node in its run,
    each side joined. Hashing left, node, right level by level gives the root.
    """
    keyed = leaves.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))  # a null source comes first
    nodes = ranked(keyed, ["_key"], ["doc_id", "digest"], stored)
    levels = climbed(stored(nodes, "leaves"), "_key")
    subroots = levels[-1].select("_key", F.col("digest")).withColumn("_all", F.lit(0))
    above = climbed(stored(ranked(subroots, ["_all"], ["_key"], stored), "subroots"), "_all")
    none = F.array().cast(PATH)
    root = above[-1].select("_all", "rank", none.alias("path"), F.col("digest").alias("root"), *(["_key", "digest"] if len(above) == 1 else []))
    tops = descended(above, root, "_all").select("_key", "path", F.col("digest").alias("subroot"), "root")
    last = levels[-1].join(tops, "_key")  # a row for each source
    if len(levels) == 1:  # each source is one leaf
        return last.drop("_key", "rank", "n")
    return descended(levels, last.select("_key", "rank", "path", "subroot", "root"), "_key").drop("_key", "rank", "n")


def leaf_digest(text: Column) -> Column:
    """The digest of a document's fields with this text."""
    fields = []
    for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text):
        value = c.cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]).cast("binary"), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and digest of its path; half of them are checked with tampered texts."""
    docs = documents(spark, sf_dir)
    tampered = F.when((id_crc(F.col("doc_id")) % 2 == 0) & F.col("text").contains("\n"), leaf_digest(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    leaves = stored(docs.select("doc_id", "source", leaf_digest(F.col("text")).alias("digest"), tampered.alias("tampered")), "digests")
    found = authentication_paths(leaves)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    found = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded(F.col("path"), F.coalesce("tampered", "digest")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

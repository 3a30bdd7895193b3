"""Merkle manifest of a dataset with a witness for every row.

Rows become leaves. The leaves of a tree, in order, are joined two by two, level by level, up to the tree's subroot, and
the subroots in the order of their trees likewise up to the root. A last node without a neighbour is hashed alone.

Witnesses are built incrementally (``Frontier``): nodes are appended one after the other; a subtree stays open until its
sibling is complete, and what completes extends the partial witnesses that are attached to both. A tree is cut into
aligned blocks of ``BLOCK`` leaves, each appended by one task and kept as one row with its partial witnesses. The roots
of blocks are appended in the same way, block by block of roots, until one is left, and extend the witnesses of the
blocks below. So no task sees more than ``BLOCK`` nodes at a time, whatever a tree's share of the rows, and texts are
hashed where they are read and never shuffled.

A witness is a list of steps from the leaf to the root: a kind (the sibling is on the left, on the right, or there is
none) and the sibling's digest.

Defined cases: the leaves of one key follow by their digests, null keys come first; repeated rows are leaves each; null
fields have a mark of their own; a tree of one leaf is that leaf, a null tree is a tree like any other and comes
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize
from tidewatch.operators.joins import null_safe

#: Leaves or roots that one task appends at a time; a power of two. It changes cost only.
BLOCK = 1024
LEFT, RIGHT, ALONE = b"L", b"R", b"-"
_DIGEST = 32


def digest(*parts: bytes) -> bytes:
    """Digests are hashed as their lower-case hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


class Frontier:
    """Open subtrees of a run of nodes that is only appended to, and the partial witnesses of all nodes."""

    def __init__(self) -> None:
        self._open: list[tuple[int, bytes, int, int]] = []  # height, root, first node, node after the last
        self.witnesses: list[list[bytes]] = []

    def append(self, node: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._add((0, node, at, at + 1))

    def _add(self, tree: tuple[int, bytes, int, int]) -> None:
        while self._open and self._open[-1][0] == tree[0]:
            height, left, first, middle = self._open.pop()
            _, right, _, last = tree
            self._extend(first, middle, RIGHT + right)
            self._extend(middle, last, LEFT + left)
            tree = (height + 1, digest(left, right), first, last)
        self._open.append(tree)

    def _extend(self, first: int, last: int, step: bytes) -> None:
        for witness in self.witnesses[first:last]:
            witness.append(step)

    def close(self, height: int = 0) -> bytes:
        """The root of everything, at ``height`` at least: subtrees without a sibling are hashed alone."""
        while len(self._open) > 1 or self._open[0][0] < height:
            own, root, first, last = self._open.pop()
            self._extend(first, last, ALONE)
            self._add((own + 1, digest(root), first, last))
        return self._open[0][1]


def steps(witness: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(witness):
        kind = witness[at:at + 1]
        end = at + 1 + (0 if kind == ALONE else _DIGEST)
        yield kind, witness[at + 1:end]
        at = end


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for kind, sibling in steps(witness):
        leaf = digest(leaf) if kind == ALONE else digest(sibling, leaf) if kind == LEFT else digest(leaf, sibling)
    return leaf


def siblings_digest(witness: bytes) -> bytes:
    return digest(*(sibling for kind, sibling in steps(witness) if kind != ALONE))


# --- leaves ---------------------------------------------------------------------------------------

def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    def written(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(written, fields)).cast("binary"), 256))


# --- positions ------------------------------------------------------------------------------------

def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of a written table with ``pos`` among the rows of their ``tree`` (from 0) and the tree's ``size``. Rows are
    sorted over all tasks; a position is the row's number in its task and the tree's rows in the tasks before."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    stored = materialize(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")), "ordered-leaves")
    sizes = stored.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(sizes.select("tree", "part", (before - F.col("first")).alias("base"), F.sum("n").over(tree).alias("size")), "leaf-bases")
    return null_safe(stored, bases, ["tree", "part"], "inner").withColumn("pos", F.col("base") + F.col("nth")).drop("part", "nth", "base", *order)


# --- blocks ---------------------------------------------------------------------------------------

def _append(nodes: list[bytes], size: int, block: int) -> tuple[bytes, list[bytes]]:
    """Root and witnesses of one block; a block that is not its tree's only one is as high as the others."""
    frontier = Frontier()
    for node in nodes:
        frontier.append(node)
    root = frontier.close(block.bit_length() - 1 if size > block else 0)
    return root, [b"".join(w) for w in frontier.witnesses]


_LEAF_BLOCK = "tree string, block long, size long, root binary, keys array<long>, leaves array<binary>, claims array<binary>, witnesses array<binary>"
_NODES = "tree string, pos long, witness binary, block long, size long, root binary"


def _leaf_blocks(leaves: DataFrame, block: int) -> DataFrame:
    def close(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        size = rows.column("size")[0].as_py()
        nodes = rows.column("leaf").to_pylist()
        root, witnesses = _append(nodes, size, block)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "block": [key[1].as_py()], "size": [-(-size // block)], "root": [root],
                         "keys": pa.array([rows.column("key").to_pylist()], pa.list_(pa.int64())), "leaves": [nodes],
                         "claims": pa.array([rows.column("claim").to_pylist()], pa.list_(pa.binary())), "witnesses": [witnesses]})

    cut = leaves.withColumn("block", F.floor(F.col("pos") / block))
    return cut.groupBy("tree", "block").applyInArrow(close, _LEAF_BLOCK)


def _root_blocks(roots: DataFrame, block: int) -> DataFrame:
    """The same for (tree, pos, size, root): one row per node, with its block's number and root."""
    def close(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        size, n = rows.column("size")[0].as_py(), rows.num_rows
        root, witnesses = _append(rows.column("root").to_pylist(), size, block)
        return pa.table({"tree": rows.column("tree"), "pos": rows.column("pos"), "witness": witnesses, "block": rows.column("block"),
                         "size": [-(-size // block)] * n, "root": [root] * n})

    cut = roots.withColumn("block", F.floor(F.col("pos") / block))
    return cut.groupBy("tree", "block").applyInArrow(close, _NODES)


def _upward(roots: DataFrame, block: int) -> DataFrame:
    """(tree, pos, above, subroot): what extends the witnesses below each node of (tree, pos, size, root), and its tree's root."""
    levels = []
    while (roots.agg(F.max("size")).first()[0] or 0) > 1:
        levels.append(materialize(_root_blocks(roots, block), "merkle-level"))
        roots = levels[-1].select("tree", F.col("block").alias("pos"), "size", "root").distinct()
    top = roots.select("tree", "pos", F.lit(b"").alias("above"), F.col("root").alias("subroot"))
    for level in reversed(levels):
        up = top.select("tree", F.col("pos").alias("block"), "above", "subroot")
        top = null_safe(level.select("tree", "pos", "block", "witness"), up, ["tree", "block"], "inner")
        top = materialize(top.select("tree", "pos", F.concat("witness", "above").alias("above"), "subroot"), "merkle-witnesses")
    return top


_PROVED = "key long, tree string, leaf binary, claim binary, subroot binary, root binary, witness binary"


def prove(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Witnesses of all rows of (tree string, key long, leaf binary, claim binary). A claim is a leaf to be verified in the
    place of the row's own and is handed on (null: none)."""
    leaves = materialize(rows.select("tree", "key", "leaf", "claim").withColumn("tie", F.monotonically_increasing_id()), "leaves")
    # Rows alike in all columns are still told apart, so that a range can end among them.
    ordered = leaves.select("*", F.struct("key", "leaf", "tie").alias("place"))
    blocks = materialize(_leaf_blocks(_numbered(ordered, ["place"]), block), "leaf-blocks")
    within = _upward(blocks.select("tree", F.col("block").alias("pos"), "size", "root"), block)
    subroots = materialize(within.select("tree", "subroot").distinct(), "subroots")
    forest = subroots.select(F.lit(None).cast("string").alias("tree"), F.struct(F.col("tree").alias("of")).alias("place"), F.col("tree").alias("of"), "subroot")
    numbered = materialize(_numbered(forest, ["place"]), "numbered-subroots")
    over = _upward(numbered.select("tree", "pos", "size", F.col("subroot").alias("root")), block)
    tops = null_safe(numbered, over.withColumnRenamed("subroot", "top"), ["tree", "pos"], "inner").select(
        F.col("of").alias("tree"), F.col("above").alias("over"), F.col("top"))
    above = null_safe(within, tops, ["tree"], "inner").select("tree", F.col("pos").alias("block"), F.concat("above", "over").alias("above"), "subroot", F.col("top"))
    extended = null_safe(blocks.select("tree", "block", "keys", "leaves", "claims", "witnesses"), materialize(above, "block-witnesses"), ["tree", "block"], "inner")
    each = extended.select("tree", "subroot", "top", "above", F.explode(F.arrays_zip("keys", "leaves", "claims", "witnesses")).alias("x"))
    return each.select(F.col("x.keys").alias("key"), "tree", F.col("x.leaves").alias("leaf"), F.col("x.claims").alias("claim"), "subroot",
                       F.col("top").alias("root"), F.concat("x.witnesses", "above").alias("witness"))


def verify(proved: DataFrame) -> DataFrame:
    """Rows of ``prove`` with ``proof`` (the digest of all siblings), ``folded`` (the root that the claim, or else the leaf,
    leads to) and ``verified``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            witnesses = batch.column("witness").to_pylist()
            folded = [fold(claim or leaf, w) for leaf, claim, w in zip(batch.column("leaf").to_pylist(), batch.column("claim").to_pylist(), witnesses, strict=True)]
            verified = [a == b for a, b in zip(folded, batch.column("root").to_pylist(), strict=True)]
            proofs = [siblings_digest(w) for w in witnesses]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(proofs, pa.binary()), pa.array(folded, pa.binary()), pa.array(verified, pa.bool_())],
                                             [*batch.schema.names, "proof", "folded", "verified"])

    return proved.mapInArrow(run, _PROVED + ", proof binary, folded binary, verified boolean")

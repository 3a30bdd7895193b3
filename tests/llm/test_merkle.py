"""The manifest against a plain tree, on odd rows, several block sizes and a tree that holds almost everything."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import wide
from tidewatch.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(found, i):
    """Per level, whether the sibling is on the left, and the sibling, or None."""
    out = []
    for nodes in found[:-1]:
        j = i ^ 1
        out.append((j < i, nodes[j] if j < len(nodes) else None))
        i //= 2
    return out


def plain_manifest(rows):
    """(tree, key, leaf, claim) rows -> (key, leaf, subroot, root, proof, folded, verified), sorted."""
    first = lambda v: (v is not None, v)
    trees = {}
    for row in sorted(rows, key=lambda r: (first(r[1]), r[2])):
        trees.setdefault(row[0], []).append(row)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    lower = {t: levels([r[2] for r in trees[t]]) for t in order}
    upper = levels([lower[t][-1][0] for t in order])
    out = []
    for n, tree in enumerate(order):
        for i, (_, key, leaf, claim) in enumerate(trees[tree]):
            way = path(lower[tree], i) + path(upper, n)
            node = claim or leaf
            for left, other in way:
                node = h(node) if other is None else h(other, node) if left else h(node, other)
            out.append((key, leaf, lower[tree][-1][0], upper[-1][0], h(*(o for _, o in way if o)), node, node == upper[-1][0]))
    return sorted(out, key=str)


def manifest(rows, **options):
    found = merkle.verify(merkle.prove(rows, **options))
    got = [(r["key"], *(bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof", "folded")), r["verified"]) for r in found.collect()]
    return sorted(got, key=str)


def frame(spark, rows):
    raw = [(t, k, bytearray.fromhex(leaf), bytearray.fromhex(claim) if claim else None) for t, k, leaf, claim in rows]
    return spark.createDataFrame(raw, "tree string, key long, leaf binary, claim binary")


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 70), st.sampled_from([None, 4, 8]))
def test_frontier(n, block):
    nodes = [bytes.fromhex(h(str(i))) for i in range(n)]
    found = levels([x.hex() for x in nodes])
    frontier = merkle.Frontier()
    for node in nodes:
        frontier.append(node)
    root = frontier.close()
    assert root.hex() == found[-1][0]
    for i, node in enumerate(nodes):
        witness = b"".join(frontier.witnesses[i])
        assert merkle.fold(node, witness) == root
        assert [(k == merkle.LEFT, s.hex() or None) for k, s in merkle.steps(witness)] == [(left and o is not None, o) for left, o in path(found, i)]
    if block:
        roots = [merkle._append(nodes[i:i + block], n, block)[0] for i in range(0, n, block)]
        over = merkle.Frontier()
        for node in roots:
            over.append(node)
        assert over.close() == root


@pytest.mark.parametrize("block", [2, 8, 1024])
def test_trees_of_all_sizes(spark, block):
    rows = [("hot", i, h("a", str(i)), h("x", str(i)) if i % 5 == 0 else None) for i in range(203)]
    rows += [("ä", i, h("b", str(i)), None) for i in range(9)] + [("z", 5, h("c"), None), (None, 7, h("d"), None), ("", 1, h("e"), h("e")), ("", 2, h("f"), None)]
    rows += [("ties", 1, h(str(i % 3)), None) for i in range(7)] + [("ties", None, h("n"), None)] * 2
    want = plain_manifest(rows)
    assert manifest(frame(spark, rows).repartition(5), block=block) == want


def test_one_row_that_holds_the_table(spark):
    """Copies of one row are dealt to several tasks and are leaves each."""
    rows = [("t", 3, h("same"), None)] * 700 + [("t", 4, h("other"), None)]
    copies = frame(spark, rows).repartition(4)
    assert manifest(copies, block=16) == plain_manifest(rows)
    leaves = merkle.materialize(copies.withColumn("tie", F.monotonically_increasing_id()).withColumn("place", F.struct("key", "leaf", "tie")), "copies")
    spread = leaves.repartitionByRange(4, "tree", "place").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1


def test_leaves_and_the_registered_rows(spark, odd_docs, no_docs):
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda r: h("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in fields))
    docs = wide(odd_docs).select("*", merkle.leaf_digest([F.col(c) for c in fields]).alias("leaf"))
    rows = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), "leaf", F.lit(None).cast("binary").alias("claim"))
    want = plain_manifest([(r["lang"], r["doc_id"], leaf(r), None) for r in odd_docs.collect()])
    assert manifest(rows) == want
    assert all(row[-1] for row in want)
    assert merkle.verify(merkle.prove(rows.limit(0))).count() == 0 == no_docs.count()
    alone = rows.where("key = 1")
    assert manifest(alone) == plain_manifest([(r["lang"], r["doc_id"], leaf(r), None) for r in odd_docs.where("doc_id = 1").collect()])

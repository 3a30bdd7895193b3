"""Near-duplicates by SimHash: fingerprints at most ``distance`` bits apart are linked, and groups are the components.

Candidates come from the generalised pigeonhole principle. The bits are divided into parts, correlated bits together;
part i gets a threshold t_i (-1: not probed) such that the t_i + 1 sum to distance + 1. Then two linked fingerprints
differ in at most t_i bits of some probed part i. The thresholds, and the number of parts, are the cheapest by a
dynamic program over estimated candidate counts, which are taken from all fingerprints: the exact number of pairs that
agree in a part, stretched to larger thresholds by the bits' disagreement rates. Every fingerprint stands in the bucket
of its part and probes those at most t_i flips away; what meets in a bucket is compared on all 64 bits.

Only distinct fingerprints take part, so exact copies cost nothing. A bucket of any size is cut into blocks, and pairs
of blocks are compared in tasks of bounded size; such a unit hands on a spanning forest of its links, never all pairs.

Defined cases: a null text is an empty one; a text without words has fingerprint zero and is linked like any other;
repeated rows are returned each; a component without any known key has a null id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewatch.llm.common import materialize, row_blocks
from tidewatch.llm.components import connected_components

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Numbers of parts to choose from, and the largest threshold of a part.
PARTS, MOST = (2, 3, 4), 1
#: Fingerprints of a block, and pairs that are compared at once.
BLOCK, PAIRS = 1024, 1 << 20
#: What comparing a pair costs, as a share of what sending a row costs.
PAIR_COST = 0.003


# Fingerprints

def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and splits at the six ASCII blanks
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(s), SEED) for s in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints; a bit is set if it is set in more than half of the shingles' hashes."""
    hashes = [shingle_hashes(t) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    out, some = np.zeros(len(texts), np.uint64), np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate([np.array(hashes[i], np.uint64) for i in some])
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(np.concatenate([[0], sizes[some][:-1]]))
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > sizes[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint (the 64 bits as a long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches):
            found = fingerprints_of(block.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(found.view(np.int64))], ["key", "fp"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp long")


# Parts and thresholds

@dataclass(frozen=True)
class Layout:
    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have bits i and j both set, over all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, both = total + len(bits), both + (bits.T @ bits)
        sums = np.concatenate([[total], both.ravel()]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "n"])

    rows = nodes.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 1 + 64 x 64 sums
    sums = np.zeros(1 + BITS * BITS)
    for r in rows:
        sums[r["at"]] = r["n"]
    return int(sums[0]), sums[1:].reshape(BITS, BITS)


def group_bits(total: int, both: np.ndarray, count: int) -> tuple[tuple[int, ...], ...]:
    """Parts of nearly equal width; each grows by the bit that correlates most with those it has."""
    mean = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((both / max(total, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for i in range(count):
        width = BITS // count + (i < BITS % count)
        left = sorted(free)
        part = [left[int(corr[np.ix_(left, left)].sum(axis=1).argmax())]]
        free.discard(part[0])
        while len(part) < width:
            left = sorted(free)
            part.append(left[int(corr[np.ix_(left, part)].mean(axis=1).argmax())])
            free.discard(part[-1])
        parts.append(tuple(sorted(part)))
    return tuple(parts)


def part_keys(values: np.ndarray, part: tuple[int, ...]) -> np.ndarray:
    """The part's bits of each fingerprint, packed."""
    out = np.zeros(len(values), np.uint64)
    for k, bit in enumerate(part):
        out |= (values >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
    return out.view(np.int64)


def agreeing_pairs(nodes: DataFrame, layouts: dict[int, tuple[tuple[int, ...], ...]]) -> dict[tuple[int, int], float]:
    """Per (number of parts, part): pairs of fingerprints that agree in it, counted over all of them."""
    named = [(count, i, part) for count, parts in layouts.items() for i, part in enumerate(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for k, (_, _, part) in enumerate(named):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(part_keys(values, part))], ["k", "key"])

    sizes = nodes.select("fp").mapInArrow(run, "k int, key long").groupBy("k", "key").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.groupBy("k").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect()
    found = {r["k"]: r["pairs"] for r in pairs}
    return {(count, i): found.get(k, 0.0) for k, (count, i, _) in enumerate(named)}


def allocate(costs: list[list[float]], need: int) -> tuple[float, tuple[int, ...]]:
    """``costs[i][t + 1]``: cost of threshold t in part i. The cheapest thresholds with sum of (t + 1) equal to ``need``."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for own in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, chosen) in best.items():
            for share, extra in enumerate(own):
                option = (cost + extra, (*chosen, share - 1))
                if used + share <= need and (used + share not in step or option < step[used + share]):
                    step[used + share] = option
        best = step
    return best[need]


def choose_layout(nodes: DataFrame, distance: int = DISTANCE) -> Layout:
    total, both = bit_statistics(nodes)
    layouts = {count: group_bits(total, both, count) for count in PARTS if count * (MOST + 1) > distance}
    agree = agreeing_pairs(nodes, layouts)
    ones = np.diag(both) / max(total, 1)
    differ = 2 * ones * (1 - ones)
    options = []
    for count, parts in layouts.items():
        costs = []
        for i, part in enumerate(parts):
            # Chance of exactly e differing bits, as if bits were independent.
            chance = np.array([1.0])
            for bit in part:
                chance = np.convolve(chance, [1 - differ[bit], differ[bit]])
            reach = chance.cumsum() / max(chance[0], 1e-300)
            rows = np.cumsum([comb(len(part), t) for t in range(MOST + 1)])
            costs.append([0.0, *(total * rows[t] + PAIR_COST * min(agree[count, i] * reach[t], total ** 2 / 2) for t in range(MOST + 1))])
        options.append((*allocate(costs, distance + 1), parts))
    _, thresholds, parts = min(options)
    return Layout(parts, thresholds)


# Links

def bucket_rows(nodes: DataFrame, layout: Layout) -> DataFrame:
    """(part, bucket, own, fp): each fingerprint in its own bucket of every probed part, and in those it probes."""
    probed = [(i, part, t) for i, (part, t) in enumerate(zip(layout.parts, layout.thresholds, strict=True)) if t >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp")
            raw = values.to_numpy().view(np.uint64)
            for i, part, threshold in probed:
                keys = part_keys(raw, part)
                for flips in range(threshold + 1):
                    for bits in combinations(range(len(part)), flips):
                        flipped = keys ^ np.int64(sum(1 << b for b in bits))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), i, np.int32)), pa.array(flipped), pa.array([not flips] * len(raw)), values],
                                                         ["part", "bucket", "own", "fp"])

    return nodes.select("fp").mapInArrow(run, "part int, bucket long, own boolean, fp long")


def forest(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """The smallest index that each index is connected to."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        for side in (left, right):
            np.minimum.at(label, side, low)
            np.minimum.at(label, before[side], low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _links(unit: np.ndarray, own: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within units (sorted), as (fingerprint, root) of a spanning forest of each."""
    starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    ends = np.append(starts[1:], len(unit))
    after = np.repeat(ends, ends - starts) - np.arange(len(unit)) - 1  # rows of the unit that follow each row
    upto = np.cumsum(after)
    pairs_left, pairs_right, begin = [], [], 0
    while begin < len(unit):
        stop = max(int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right")), begin + 1)
        left = np.repeat(np.arange(begin, stop), after[begin:stop])
        first = np.repeat(np.cumsum(after[begin:stop]) - after[begin:stop], after[begin:stop])
        right = left + 1 + np.arange(len(left)) - first
        near = (own[left] | own[right]) & (np.bitwise_count(values[left] ^ values[right]) <= distance)
        pairs_left.append(left[near])
        pairs_right.append(right[near])
        begin = stop
    label = forest(np.concatenate(pairs_left), np.concatenate(pairs_right), len(unit))
    hung = np.flatnonzero(label != np.arange(len(unit)))
    return values[hung], values[label[hung]]


def links(nodes: DataFrame, layout: Layout, distance: int = DISTANCE) -> DataFrame:
    """(u, v): enough links between distinct fingerprints to connect all that are connected."""
    rows = bucket_rows(nodes, layout)
    sizes = rows.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned")).where("n > 1 AND owned")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.join(sizes.select("part", "bucket", blocks.alias("blocks")), ["part", "bucket"])
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    units = dealt.select("part", "bucket", "own", "fp", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "part", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "own", "fp")
    names = ["part", "bucket", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def close(columns: list[np.ndarray]) -> pa.RecordBatch:
            changed = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
            u, v = _links(np.concatenate([[0], np.cumsum(changed)]), columns[4], columns[5].view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*names, "own", "fp")]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            # The last unit may go on in the next batch.
            last = np.flatnonzero(np.any([c != c[-1] for c in columns[:4]], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [c[cut:].copy() for c in columns]
            if cut:
                yield close([c[:cut] for c in columns])
        if held is not None and len(held[0]):
            yield close(held)

    return units.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per input row: key, fingerprint (16 hexadecimal digits), component_id, the smallest key reachable, and
    component, a fingerprint that names the group."""
    return groups(materialize(fingerprints(docs, key, text), "fingerprints"), key, distance)


def groups(prints: DataFrame, key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """``near_duplicates`` from written fingerprints (key, fp)."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("key").alias("least")), "distinct-fingerprints")
    near = links(nodes, choose_layout(nodes, distance), distance)
    roots = connected_components(near)
    rooted = materialize(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = materialize(rooted.join(ids, "root").select("fp", "component_id", "root"), "component-ids")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return prints.join(by_print, "fp").select(F.col("key").alias(key), digits("fp").alias("fingerprint"), "component_id", digits("root").alias("component"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stand for their group: one of each, that with the smallest key. The rows are shuffled once, by
    key, to meet the chosen keys; they are not sorted."""
    near = near_duplicates(docs, key, text, distance)
    near = materialize(near.withColumnRenamed(key, "key"), "near-duplicates")
    times = near.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("key") == F.col("component_id")).alias("stands"))
    chosen = materialize(times.where((F.col("n") == 1) & F.col("stands")).select(F.col("key").alias(key)), "representatives")
    again = materialize(times.where((F.col("n") > 1) | F.col("key").isNull()).select("key"), "repeated-keys")
    plain = docs.join(chosen.hint("shuffle_hash"), key, "left_semi")
    if again.isEmpty():
        return plain
    # A repeated key does not tell which of its rows stands for a group; their fingerprints do.
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.join(again.withColumnRenamed("key", "twice"), F.col("key").eqNullSafe(F.col("twice")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches):
            prints = [format(x, "016x") for x in fingerprints_of(block.column("text").to_pylist()).tolist()]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(prints, pa.string())], [*block.schema.names, "print"])

    printed = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("print", StringType())]))
    standing = near.where(F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key").alias("k"), "fingerprint", "component").distinct()
    found = printed.join(standing, printed["key"].eqNullSafe(standing["k"]) & (printed["print"] == standing["fingerprint"]))
    first = Window.partitionBy("component").orderBy("print", "text")
    return plain.unionByName(found.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*"))

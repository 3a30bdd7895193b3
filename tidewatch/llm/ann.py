"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long bit string (signs of random projections); the index is each tree's strings in sorted
order, so that vectors with a common prefix are neighbours. A query descends every tree to its longest matching prefix
and then ascends all trees at the same pace, one bit at a time, until the prefixes together hold enough candidates.
Candidates are compared exactly, in double precision.

Inner products become angles by one more coordinate that brings all indexed vectors to the largest norm. How many
candidates are enough is fitted: for a bounded sample of queries the true neighbours are found by comparing them with
all vectors, and the smallest share of the vectors that reaches ``recall`` is taken.

The sorted strings are kept in buckets of one tree and one short prefix, cut into chunks of bounded size; a query visits
the buckets below its prefix, in blocks. It visits its own bucket of each tree first; the score of its ``k``-th best
candidate there is a bound that later candidates have to reach, and a pair is handed on only from the first bucket in
which it meets. So neither a prefix that a third of all vectors share nor a far ascent gathers anything in one place.
Queries that find too few are compared with all vectors, chunk by chunk.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and those (of vectors and queries
alike) whose length is not the most common one among the vectors, take no part; equal scores go to the smaller id; equal vectors of different ids are candidates each; rows
of a repeated id are candidates each if their scores differ, and one candidate if they are equal; a query never finds rows
of its own id, and of the vectors of a repeated query id only the smallest, as bytes, is asked; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize

TREES, LENGTH, SEED = 16, 48, 20
#: Wanted recall of the fitted share, and queries it is fitted on.
RECALL, FIT_QUERIES = 0.95, 64
#: Vectors of a chunk and queries of a block.
CHUNK, BLOCK = 2048, 512


@dataclass(frozen=True)
class Forest:
    """Projections of all trees, and the largest norm of the indexed vectors."""

    planes: np.ndarray  # (TREES * LENGTH, dimension + 1)
    norm: float

    def strings(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, TREES) bit strings, the first bit highest."""
        sizes = np.linalg.norm(x, axis=1)
        scaled = x / (np.maximum(sizes, 1e-300)[:, None] if query else max(self.norm, 1e-300))
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(1 - (sizes / max(self.norm, 1e-300)) ** 2, 0))
        bits = (np.concatenate([scaled, rest[:, None]], axis=1) @ self.planes.T > 0).reshape(len(x), TREES, LENGTH)
        weights = (1 << np.arange(LENGTH - 1, -1, -1)).astype(np.int64)
        return bits @ weights


def make_forest(dimension: int, norm: float) -> Forest:
    return Forest(np.random.default_rng(SEED).standard_normal((TREES * LENGTH, dimension + 1)), norm)


def _components(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, x) of the vectors that are whole."""
    values = F.col(embedding).cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), values.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad & F.exists("x", lambda x: x != 0))


def common_length(vectors: DataFrame, key: str, embedding: str) -> int:
    """The most common length of the whole vectors, the smaller one of a tie; 0 without any."""
    sizes = _components(vectors, key, embedding).groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.orderBy(F.desc("n"), "size").first()
    return found["size"] if found else 0


def usable(vectors: DataFrame, key: str, embedding: str, length: int) -> DataFrame:
    """(id, v: components as little-endian doubles) of the whole vectors of one length, written to the shared folder."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy().astype("<f8").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in flat], pa.binary())], ["id", "v"])

    rows = _components(vectors, key, embedding).where(F.size("x") == length)
    return materialize(rows.mapInArrow(pack, "id long, v binary"), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of paired rows; the same components give the same sum wherever they stand."""
    return (queries * vectors).sum(axis=1)


def best_of(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, vector, score) per query among the vectors of a chunk."""
    found: tuple[list, list, list] = ([], [], [])
    rough = q @ v.T
    barred = qid[:, None] == vid[None, :]
    if allowed is not None:
        barred |= ~allowed
    rough[barred] = -np.inf
    if rough.shape[1] > k:
        edge = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
    else:
        edge = np.full(len(q), -np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
    for i in range(len(q)):
        at = np.flatnonzero((rough[i] >= edge[i] - slack[i]) & ~barred[i])
        if len(at):
            score = exact_scores(q[i], v[at])
            order = np.lexsort((vid[at], -score))[:k]
            found[0].append(np.full(len(order), qid[i]))
            found[1].append(vid[at][order])
            found[2].append(score[order])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in found)


_FOUND = "query_id long, vec_id long, score double"


def _found_batch(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int64)), pa.array(found[2].astype(float))],
                                      ["query_id", "vec_id", "score"])


def rank(found: DataFrame, k: int) -> DataFrame:
    """The k best different vectors of each query; every task hands on k per query at most."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(queries: list[tuple[int, bytes]], vectors: DataFrame, k: int) -> DataFrame:
    """A bounded list of queries against all vectors (id, v), in blocks; each task hands on k per query."""
    qid = np.array([i for i, _ in queries], np.int64)
    q = np.frombuffer(b"".join(v for _, v in queries), "<f8").reshape(len(queries), -1) if queries else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                part = batch.slice(begin, CHUNK)
                yield _found_batch(best_of(qid, q, part.column("id").to_numpy(), _matrix(part.column("v")), k))

    return vectors.select("id", "v").mapInArrow(run, _FOUND)


def hashed(vectors: DataFrame, forest: Forest, query: bool) -> DataFrame:
    """(id, v, strings: one per tree)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                strings = forest.strings(_matrix(batch.column("v")), query)
                flat = pa.ListArray.from_arrays(np.arange(0, strings.size + 1, TREES, dtype=np.int32), pa.array(strings.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), flat], ["id", "v", "strings"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v binary, strings array<long>")


def fit_candidates(index: DataFrame, queries: DataFrame, forest: Forest, total: int, k: int) -> int:
    """How many prefix matches over all trees a query needs; fitted on a bounded sample of the queries (id, v)."""
    least = TREES * (k + 1)  # as a vector matches once per tree at most, more than k different ones
    sample = [(r["id"], bytes(r["v"])) for r in queries.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(FIT_QUERIES).collect()]
    if not sample or total * TREES <= least:
        return least
    near = rank(brute_force(sample, index, k), k)
    # Of a repeated id one vector is enough to tell where it is met.
    ids_near = F.broadcast(near.select("vec_id").distinct())
    held = index.select(F.col("id").alias("vec_id"), "v").join(ids_near, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    pairs = near.join(held, "vec_id").select("query_id", "v").collect()  # k for each sampled query at most
    ids = {own: i for i, (own, _) in enumerate(sample)}
    strings = forest.strings(np.frombuffer(b"".join(v for _, v in sample), "<f8").reshape(len(sample), -1), True)
    which = np.array([ids[r["query_id"]] for r in pairs], np.int64)
    true = forest.strings(np.frombuffer(b"".join(bytes(r["v"]) for r in pairs), "<f8").reshape(len(pairs), -1), False)
    deepest = common_prefix(true, strings[which]).max(axis=1)  # depth at which a true neighbour is first met

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(strings), LENGTH + 1), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows = np.array(part.column("strings").flatten()).reshape(part.num_rows, TREES)
                for i, own in enumerate(strings):
                    sums[i] += np.bincount(common_prefix(rows, own[None]).ravel(), minlength=LENGTH + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["at", "n"])

    counts = np.zeros(len(strings) * (LENGTH + 1), np.int64)
    for r in index.select("strings").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    reached = counts.reshape(len(strings), -1)[:, ::-1].cumsum(axis=1)[:, ::-1]  # matches of at least each depth
    for wanted in np.unique(np.geomspace(least, total * TREES, 200).astype(np.int64)):
        depth = (reached >= wanted).sum(axis=1) - 1
        if np.mean(deepest >= depth[which]) >= RECALL:
            return int(max(wanted, least))
    return total * TREES


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of bit strings."""
    return LENGTH - np.frexp((a ^ b).astype(np.float64))[1]


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows of one group after the other, of batches sorted by ``names``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in names]
        edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if batch.num_rows else []
        for begin, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            part = batch.slice(begin, end - begin)
            if part.num_rows and held and any(held[-1].column(c)[0] != part.column(c)[0] for c in names):
                yield pa.Table.from_batches(held)
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


_UNIT = ["tree", "bucket", "chunk", "block"]


def units(index: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """Index rows and query rows (tree, bucket, columns) that have to meet, cut into units of bounded size and sorted by
    unit, index rows first."""
    sizes = index.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("n")).join(
        queries.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("m")), ["tree", "bucket"])
    cuts = sizes.select("tree", "bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id", "string"), F.col(n)).cast("int")
    left = index.join(cuts, ["tree", "bucket"]).select("tree", "bucket", own("chunks").alias("chunk"), every("blocks").alias("block"), F.lit(0).alias("asks"), *columns)
    right = queries.join(cuts, ["tree", "bucket"]).select("tree", "bucket", every("chunks").alias("chunk"), own("blocks").alias("block"), F.lit(1).alias("asks"), *columns)
    return left.unionByName(right).repartition(*_UNIT).sortWithinPartitions(*_UNIT, "asks")


def per_tree(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("id", *more, F.posexplode("strings").alias("tree", "string"))


def query_depths(index: DataFrame, queries: DataFrame, bits: int, wanted: int) -> DataFrame:
    """(id, depth): the deepest level at which all trees together offer ``wanted`` matches."""
    bucket = F.shiftrightunsigned("string", LENGTH - bits).alias("bucket")
    placed = per_tree(queries).select("id", "tree", "string", bucket)
    stored = per_tree(index).select("id", "tree", "string", bucket)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.arange(LENGTH - bits, -1, -1, dtype=np.int64)
        for unit in grouped(batches, _UNIT):
            asks, strings = unit.column("asks").to_numpy() == 1, unit.column("string").to_numpy()
            ordered, own = np.sort(strings[~asks]), strings[asks]
            low = own[:, None] >> shift << shift
            found = np.searchsorted(ordered, low + (np.int64(1) << shift)) - np.searchsorted(ordered, low)
            offsets = np.arange(0, found.size + 1, len(shift), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(unit.column("id").to_numpy()[asks]), pa.ListArray.from_arrays(offsets, pa.array(found.ravel().astype(np.int64)))],
                                             ["id", "n"])

    below = units(stored, placed, ["id", "string"]).mapInArrow(count, "id long, n array<long>").groupBy("id").agg(
        F.array(*[F.sum(F.col("n")[i]) for i in range(LENGTH - bits + 1)]).alias("n"))
    fine = below.select("id", F.posexplode("n").alias("at", "n")).select("id", (F.col("at") + bits).alias("depth"), "n")
    if not bits:
        coarse = fine.limit(0)
    else:
        levels = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("depth")
        prefix = F.expr(f"shiftright(bucket, {bits} - depth)").alias("prefix")
        sizes = stored.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("n")).select("*", levels).groupBy("tree", "depth", prefix).agg(F.sum("n").alias("n"))
        coarse = placed.select("id", "tree", "bucket", levels).select("id", "tree", "depth", prefix).join(sizes, ["tree", "depth", "prefix"]).groupBy("id", "depth").agg(
            F.sum("n").alias("n")).select("id", "depth", "n")
    return fine.unionByName(coarse).where(F.col("n") >= wanted).groupBy("id").agg(F.max("depth").alias("depth"))


def _strings(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), TREES)


def at_home(index: DataFrame, queries: DataFrame, bits: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query's (id, v, strings) own bucket in every tree."""
    bucket = F.shiftrightunsigned("string", LENGTH - bits).alias("bucket")
    stored = per_tree(index, "v").select("id", "v", "tree", "string", bucket)
    asked = per_tree(queries, "v").select("id", "v", "tree", "string", bucket)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in grouped(batches, _UNIT):
            asks, ids, x = unit.column("asks").to_numpy() == 1, unit.column("id").to_numpy(), _matrix(unit.column("v"))
            yield _found_batch(best_of(ids[asks], x[asks], ids[~asks], x[~asks], k))

    return units(stored, asked, ["id", "v", "string"]).mapInArrow(meet, _FOUND)


def candidates(index: DataFrame, queries: DataFrame, bits: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the candidates of every other bucket below the prefix of a query (id, v, strings, depth,
    bound) whose score is at least its bound; the k best of each unit. A query without a bound visits its own
    buckets too. At depth 0 one tree holds all vectors."""
    stored = per_tree(index, "v", "strings").select("id", "v", "strings", "tree", "string", F.shiftrightunsigned("string", LENGTH - bits).alias("bucket"),
                                                    F.lit(0).alias("depth"), F.lit(None).cast("double").alias("bound"))
    spread = F.expr(f"CASE WHEN depth >= {bits} THEN array(shiftrightunsigned(string, {LENGTH - bits})) ELSE "
                    f"sequence(shiftleft(shiftrightunsigned(string, {LENGTH} - depth), {bits} - depth), "
                    f"shiftleft(shiftrightunsigned(string, {LENGTH} - depth) + 1, {bits} - depth) - 1) END")
    asked = per_tree(queries, "v", "strings", "depth", "bound").where("depth > 0 OR tree = 0").select(
        "id", "v", "strings", "tree", "string", "depth", "bound", F.explode(spread).alias("bucket"))
    asked = asked.where(F.col("bound").isNull() | (F.col("bucket") != F.shiftrightunsigned("string", LENGTH - bits)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in grouped(batches, _UNIT):
            asks, tree = unit.column("asks").to_numpy() == 1, unit.column("tree")[0].as_py()
            ids, own, x, every = unit.column("id").to_numpy(), unit.column("string").to_numpy(), _matrix(unit.column("v")), _strings(unit.column("strings"))
            depth = unit.column("depth").to_numpy()[asks]
            bound = unit.column("bound").to_numpy()[asks].astype(float)
            same = (own[asks][:, None] ^ own[~asks][None, :]) >> (LENGTH - depth).astype(np.int64)[:, None] == 0
            bounded = np.flatnonzero(~np.isnan(bound))
            rough = x[asks][bounded] @ x[~asks].T
            least = bound[bounded] - 1e-9 * (1 + np.abs(bound[bounded]))
            row, at = np.nonzero((rough >= least[:, None]) & same[bounded] & (ids[asks][bounded][:, None] != ids[~asks][None, :]))
            # Pairs that met at home, or in an earlier tree, have been handed on there.
            prefix = common_prefix(every[asks][bounded][row], every[~asks][at])
            first = ~((prefix >= bits).any(axis=1) | (prefix[:, :tree] >= depth[bounded][row][:, None]).any(axis=1))
            row, at = bounded[row[first]], at[first]
            score = exact_scores(x[asks][row], x[~asks][at])
            order = np.lexsort((ids[~asks][at], -score, row))
            row, at, score = row[order], at[order], score[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield _found_batch((ids[asks][row[kept]], ids[~asks][at[kept]], score[kept]))
            if len(bounded) < len(bound):
                free = np.isnan(bound)
                yield _found_batch(best_of(ids[asks][free], x[asks][free], ids[~asks], x[~asks], k, same[free]))

    return units(stored, asked, ["id", "v", "strings", "string", "depth", "bound"]).mapInArrow(compare, _FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found among ``vectors`` for every row of ``queries`` (whose ids are
    theirs among the vectors)."""
    length = common_length(vectors, key, embedding)
    index = usable(vectors, key, embedding, length)
    own = materialize(usable(queries, key, embedding, length).groupBy("id").agg(F.min("v").alias("v")), "queries")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.shape[1]]), pa.array([float(np.linalg.norm(x, axis=1).max())])], ["n", "size", "norm"])

    shape = index.select("v").mapInArrow(norms, "n long, size long, norm double").agg(F.sum("n"), F.max("size"), F.max("norm")).first()
    total, dimension, norm = shape[0] or 0, shape[1] or 1, shape[2] or 1.0
    forest = make_forest(dimension, norm)
    index = materialize(hashed(index, forest, False), "forest")
    own = materialize(hashed(own, forest, True), "hashed-queries")
    wanted = min(fit_candidates(index, own, forest, total, k), total * TREES)
    bits = min(max(int(np.ceil(np.log2(max(total, 1) / CHUNK))), 0), LENGTH - 1)
    depths = query_depths(index, own, bits, wanted)
    near = materialize(rank(at_home(index, own, bits, k), k), "at-home")
    bounds = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    asked = own.join(depths, "id", "left").join(bounds, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    asked = materialize(asked, "query-depths")
    found = materialize(rank(near.drop("rank").unionByName(candidates(index, asked, bits, k)), k), "nearest")
    # Where repeated ids left a query short, the root of one tree offers everything.
    short = asked.join(found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").where((F.coalesce("n", F.lit(0)) < k) & (F.col("depth") > 0)).drop("n")
    if not short.isEmpty():
        more = candidates(index, short.withColumns({"depth": F.lit(0), "bound": F.lit(None).cast("double")}), bits, k)
        found = rank(found.drop("rank").unionByName(more), k)
    return found

"""Packing documents into training sequences of a fixed length.

Documents are encoded, an end id is appended, and only documents longer than a sequence are cut, so that all pieces
but the first fill a sequence. What is left is a bin-packing problem whose input is a histogram of at most
``capacity`` lengths, whatever the number of documents. Its configuration linear program (choose how often to use
each way of filling a sequence) is solved by multiplicative weights: lengths that are covered too little gain weight,
a knapsack dynamic program prices the fillings of largest weight, and those are added. The solution is rounded down
again and again on what remains, and the last few pieces are placed best fit first. The plan has one row per
filling; its size does not depend on the data.

Pieces find their place by their rank among the pieces of their length: a running count inside the task that made
them plus the counts of the tasks before, so a length that a third of all documents share needs no task of its own.

Defined cases: a null or empty text is the end id alone; repeated rows and null keys are packed like any other;
a piece that fills a sequence gets one to itself (a negative sequence id); an empty table gives no sequence; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import row_blocks, scratch_dir
from tidewatch.llm.encoding import Words, block_encoder

CAPACITY = 2048
#: Text bytes that a worker encodes together.
ENCODED_BYTES = 2 << 20
#: Rounds of multiplicative weights, fillings added in each, the weight's learning rate, and how far below the best
#: filling's value an added one may be.
ROUNDS, COLUMNS, RATE, SLACK = 120, 300, 6.0, 0.01
#: Times the fractional solution is solved and rounded down on what remains.
ROUNDINGS = 3

Filling = tuple[tuple[int, int], ...]  # (length, times), longest first


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of every room up to ``capacity``, any length as often as it fits, and the length placed first (0: none)."""
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    order = np.argsort(lengths)
    lengths, values = lengths[order], values[order]
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], first[room] = best[room - 1], -1
        if n := upto[room]:
            worth = best[room - lengths[:n]] + values[:n]
            k = int(worth.argmax())
            if worth[k] > best[room]:
                best[room], first[room] = worth[k], lengths[k]
    return best, first


def _trace(first: np.ndarray, room: int) -> dict[int, int]:
    found: dict[int, int] = defaultdict(int)
    while room > 0:
        if first[room] > 0:
            found[int(first[room])] += 1
            room -= int(first[room])
        else:
            room -= 1
    return found


def fractional(counts: dict[int, int], capacity: int) -> dict[Filling, float]:
    """The configuration program's solution by multiplicative weights, scaled so that lengths are covered about once."""
    lengths = np.array(sorted(counts), np.int64)
    wanted = np.array([counts[int(x)] for x in lengths], float)
    index = {int(x): i for i, x in enumerate(lengths)}
    covered, used = np.zeros(len(lengths)), defaultdict(float)
    each = 2.0 / ROUNDS
    for _ in range(ROUNDS):
        # A length's price: what a sequence of perfect fill would charge, raised while it lags behind the others.
        price = lengths / capacity * np.exp(-RATE * (covered - covered.mean()))
        best, first = knapsack(lengths, price, capacity)
        worth = price + best[capacity - lengths]  # of the best filling that holds a given length
        good = np.flatnonzero(worth >= (1 - SLACK) * best[capacity])
        for i in good[np.argsort(covered[good], kind="stable")][:COLUMNS]:
            own = int(lengths[i])
            parts = _trace(first, capacity - own)
            parts[own] += 1
            filling = {x: min(n, counts[x]) for x, n in parts.items()}
            at = np.array([index[x] for x in filling])
            times = np.array(list(filling.values()), float)
            room = covered.mean() + 2 * each - covered[at]
            step = min(float((wanted[at] / times).min()) * each, float((room * wanted[at] / times).max()))
            if step > 0:
                used[tuple(sorted(filling.items(), reverse=True))] += step
                covered[at] += times * step / wanted[at]
    scale = float(np.average(covered, weights=wanted * lengths)) or 1.0
    return {filling: x / scale for filling, x in used.items()}


def best_fit(counts: dict[int, int], capacity: int) -> dict[Filling, int]:
    """Best fit by falling length, on counts: sequences that look alike are handled together."""
    room: dict[int, dict[Filling, int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for free in sorted(f for f in room if f >= length):
            while left and room[free]:
                filling, n = room[free].popitem()
                each = min(free // length, left)
                take = min(n, left // each)
                if take < n:
                    room[free][filling] += n - take
                room[free - each * length][(*filling, (length, each))] += take
                left -= take * each
            if not left:
                break
        each = min(capacity // length, left or 1)
        if left // each:
            room[capacity - each * length][((length, each),)] += left // each
        if left % each:
            room[capacity - left % each * length][((length, left % each),)] += 1
    return _merged((filling, n) for same in room.values() for filling, n in same.items())


def _merged(fillings) -> dict[Filling, int]:
    out: dict[Filling, int] = defaultdict(int)
    for filling, n in fillings:
        if n:
            out[tuple(sorted(filling, reverse=True))] += n
    return dict(out)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[Filling, int]:
    """How often to use each filling, so that every length's pieces have exactly their places."""
    left = {length: n for length, n in counts.items() if n}
    done: dict[Filling, int] = defaultdict(int)
    for _ in range(ROUNDINGS):
        if not left:
            break
        before = sum(left.values())
        solution = fractional(left, capacity)
        # Fullest first: what cannot be rounded is better left to pieces that combine easily.
        for filling, x in sorted(solution.items(), key=lambda fx: (-sum(a * b for a, b in fx[0]), -fx[1], fx[0])):
            times = min(int(x), *(left.get(length, 0) // n for length, n in filling))
            if times > 0:
                done[filling] += times
                for length, n in filling:
                    left[length] -= n * times
        left = {length: n for length, n in left.items() if n}
        if sum(left.values()) > 0.9 * before:
            break
    return _merged([*done.items(), *best_fit(left, capacity).items()])


def places(fillings: dict[Filling, int]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, pieces per sequence, offset of the first), by rank."""
    out, ranks, sequence = defaultdict(list), defaultdict(int), 0
    for filling, times in sorted(fillings.items(), reverse=True):
        offset = 0
        for length, n in filling:
            out[length].append((ranks[length], sequence, n, offset))
            ranks[length] += n * times
            offset += n * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def write_pieces(docs: DataFrame, path: str, vocabulary: str, *, end_id: int, words: bool = False, capacity: int = CAPACITY,
                 key: str = "doc_id", text: str = "text") -> None:
    """Encode, cut and write: doc_id, piece, start, length, ids (little-endian 32-bit), and (part, nth): the piece's
    number among those of its length that its task made."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, made = block_encoder(vocabulary, words), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4")
        for block in row_blocks(batches, limit=ENCODED_BYTES):
            keys, pieces, starts, lengths, nth, ids = [], [], [], [], [], []
            coded, bounds = coder.encode(Words(block.column("text")))
            for row_key, first, after in zip(block.column("key").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                found = np.append(coded[first:after].astype("<u4"), end)
                edges = [0, *range(len(found) % capacity or capacity, len(found) + 1, capacity)] if len(found) > capacity else [0, len(found)]
                for i, (begin, stop) in enumerate(zip(edges, edges[1:])):
                    keys.append(row_key)
                    pieces.append(i)
                    starts.append(begin)
                    lengths.append(stop - begin)
                    nth.append(made[stop - begin])
                    made[stop - begin] += 1
                    ids.append(found[begin:stop].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array([part] * len(keys), pa.int32()), pa.array(nth, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    pieces = rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary, part int, nth long")
    pieces.write.option("compression", "zstd").parquet(path)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (rows of a written table) with sequence_id and offset instead of part and nth."""
    sizes = pieces.where(F.col("length") < capacity).groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # under capacity rows
    where = places(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    ranked = pieces.join(bases, ["part", "length"], "left").select(*kept, "part", "nth", (F.col("base") + F.col("nth")).alias("rank"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, part, nth = (batch.column(c).to_numpy() for c in ("length", "part", "nth"))
            rank = batch.column("rank").fill_null(0).to_numpy()
            sequence, offset = -1 - (part.astype(np.int64) * (1 << 38) + nth), np.zeros(len(length), np.int64)
            for x in np.unique(length[length < capacity]).tolist():
                own, table = np.flatnonzero(length == x), where[x]
                row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                inside = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + inside // row[:, 2]
                offset[own] = row[:, 3] + inside % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    types = dict(pieces.dtypes)
    return ranked.mapInArrow(locate, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, *, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Digest form: doc_id, piece, start, length, ids_crc32, sequence_id, offset. The pieces stay in the shared folder."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "pieces")
    write_pieces(docs, path, vocabulary, end_id=end_id, capacity=capacity)
    pieces = spark.read.parquet(path).withColumn("ids_crc32", F.crc32("ids"))
    return pack(pieces.drop("ids"), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from packed pieces that carry ``ids``: sequence_id, the pieces in order and their ids joined."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.transform("parts", lambda p: p.dropFields("ids")).alias("pieces"),
                          F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["ids"])).alias("ids"))

"""Token-id files: one zstandard frame per document against a shared dictionary, with an offset index per shard.

A token store is a folder with two tables. ``dictionary`` holds the dictionary's bytes and their SHA-256; ``shards``
holds one row per shard: (part, seq) in document order, the number of documents and tokens, and the shard itself. A
shard is self-contained: header, dictionary hash, index (document, offset, frame size, tokens), frames. A reader can
take one short document out of it without touching the others (``Shard.ids``). Shards are written by Spark's own
writer, so a repeated task leaves nothing behind and any file system that Spark knows will do.

Documents are dealt by ranges of their key, which balances them whatever the keys are; only one total per shard is
needed to know where each document starts in the whole sequence.

Defined cases: a null or empty text is the end id alone; documents with equal keys follow in the order of their
texts, nulls first; a null key comes first; an empty table gives a store without shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import distinct_sample, materialize, row_blocks
from tidewatch.llm.encoding import Words, block_encoder, encoder

MAGIC = b"TWTOK1\x00\x00"
_HEAD = np.dtype([("magic", "S8"), ("dictionary", "V32"), ("width", "<u4"), ("documents", "<u4")])
_ENTRY = np.dtype([("key", "<i8"), ("known", "u1"), ("offset", "<u8"), ("size", "<u4"), ("tokens", "<u4")])
#: A shard is closed at so many bytes of frames or documents.
SHARD_BYTES, SHARD_DOCUMENTS = 1 << 20, 4096
#: Text bytes that a worker encodes together.
ENCODED_BYTES = 2 << 20
#: The dictionary is trained on at most so many documents and serialized bytes.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1000, 8 << 20, 64 << 10, 3


def _codec_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class Shard:
    """Reads a shard's index and single documents."""

    def __init__(self, data: bytes, dictionary: bytes):
        head = np.frombuffer(data, _HEAD, 1)[0]
        if bytes(head["magic"]).ljust(8, b"\x00") != MAGIC:
            raise ValueError("not a token shard")
        if head["dictionary"].tobytes() != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.dtype = np.dtype(f"<u{head['width']}")
        self.index = np.frombuffer(data, _ENTRY, int(head["documents"]), _HEAD.itemsize)
        self._frames = memoryview(data)[_HEAD.itemsize + self.index.nbytes:]
        shared = _codec_dictionary(dictionary)
        self._codec = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.index)

    def ids_at(self, i: int) -> np.ndarray:
        entry = self.index[i]
        begin = int(entry["offset"])
        return np.frombuffer(self._codec.decompress(self._frames[begin:begin + int(entry["size"])]), self.dtype)

    def ids(self, key: int) -> np.ndarray:
        """The ids of the first document with this key."""
        found = np.flatnonzero((self.index["key"] == key) & (self.index["known"] == 1))
        if not len(found):
            raise KeyError(key)
        return self.ids_at(int(found[0]))


def build_shard(rows: list[tuple[int | None, int, bytes]], dictionary: bytes, width: int) -> bytes:
    """``rows``: (key, tokens, frame) in order."""
    head, index = np.zeros(1, _HEAD), np.zeros(len(rows), _ENTRY)
    head[0] = (MAGIC, np.void(hashlib.sha256(dictionary).digest()), width, len(rows))
    sizes = [len(frame) for _, _, frame in rows]
    index["key"] = [key or 0 for key, _, _ in rows]
    index["known"] = [key is not None for key, _, _ in rows]
    index["offset"] = np.cumsum([0, *sizes[:-1]]) if rows else []
    index["size"] = sizes
    index["tokens"] = [n for _, n, _ in rows]
    return b"".join([head.tobytes(), index.tobytes(), *(frame for _, _, frame in rows)])


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; too few samples to train on serve as one themselves."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _sample_dictionary(docs: DataFrame, vocabulary: str, words: bool, end_id: int) -> bytes:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, held = [], 0
        coder = encoder(vocabulary, words)
        for batch in batches:
            for text in batch.column("text"):
                if held < SAMPLE_BYTES:
                    samples.append(coder.encode(text.as_py()) + np.array([end_id], coder.dtype).tobytes())
                    held += len(samples[-1])
        yield pa.RecordBatch.from_arrays([pa.array([train_dictionary(samples)], pa.binary())], ["data"])

    found = distinct_sample(docs, SAMPLE_DOCUMENTS).coalesce(1).mapInArrow(train, "data binary").first()
    return bytes(found["data"]) if found else b""


def write(docs: DataFrame, path: str, vocabulary: str, *, end_id: int, words: bool = False, key: str = "doc_id", text: str = "text") -> None:
    """Encode all texts and write a token store. ``vocabulary``: a tokenizers file that every executor has."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    dictionary = _sample_dictionary(rows, vocabulary, words, end_id)
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest())], "data binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = block_encoder(vocabulary, words), TaskContext.get().partitionId(), 0
        shared = _codec_dictionary(dictionary)
        codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared) if shared else zstandard.ZstdCompressor(level=LEVEL)
        end = np.array([end_id], coder.dtype).tobytes()
        open_rows, held = [], 0

        def close() -> pa.RecordBatch:
            tokens = sum(n for _, n, _ in open_rows)
            values = [[part], [seq], [len(open_rows)], [tokens], [build_shard(open_rows, dictionary, coder.dtype.itemsize)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                              ["part", "seq", "documents", "tokens", "shard"])

        for block in row_blocks(batches, limit=ENCODED_BYTES):
            ids, bounds = coder.encode(Words(block.column("text")))
            for row_key, begin, stop in zip(block.column("key").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                raw = ids[begin:stop].tobytes() + end
                frame = codec.compress(raw)
                open_rows.append((row_key, len(raw) // coder.dtype.itemsize, frame))
                held += len(frame)
                if held >= SHARD_BYTES or len(open_rows) >= SHARD_DOCUMENTS:
                    yield close()
                    open_rows, held, seq = [], 0, seq + 1
        if open_rows:
            yield close()

    ordered = rows.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", "text")
    shards = ordered.mapInArrow(encode, "part int, seq int, documents long, tokens long, shard binary")
    shards.write.option("compression", "uncompressed").parquet(f"{path}/shards")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, start): tokens before each shard. Summed within a part, then over one row per part."""
    sizes = spark.read.parquet(f"{path}/shards").select("part", "seq", "tokens")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("total"))
    bases = materialize(parts.select("part", F.coalesce(F.sum("total").over(before(Window.orderBy("part"))), F.lit(0)).alias("base")), "part-starts")
    inside = F.coalesce(F.sum("tokens").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    return materialize(sizes.select("part", "seq", inside.alias("inside")).join(bases, "part")
                       .select("part", "seq", (F.col("base") + F.col("inside")).alias("start")), "shard-starts")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 (over little-endian 32-bit ids) and, if asked, ids."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["data"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column("part"), batch.column("seq"), batch.column("shard"), strict=True):
                shard = Shard(data.as_py(), dictionary)
                tokens = shard.index["tokens"].astype(np.int64)
                found = [shard.ids_at(i).astype("<u4") for i in range(len(shard))]
                columns = {
                    "part": pa.array([part.as_py()] * len(shard), pa.int32()), "seq": pa.array([seq.as_py()] * len(shard), pa.int32()),
                    "doc_id": pa.array(shard.index["key"].astype(np.int64), mask=shard.index["known"] == 0),
                    "inner": pa.array(np.cumsum(tokens) - tokens), "n_tokens": pa.array(tokens),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in found], pa.int64())}
                if ids:
                    offsets = np.concatenate([[0], np.cumsum(tokens)]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(offsets, np.concatenate(found).astype(np.int32))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    rows = spark.read.parquet(f"{path}/shards").select("part", "seq", "shard").mapInArrow(decode, schema)
    return rows.join(shard_starts(spark, path), ["part", "seq"]).select(
        "doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))

"""BPE encoding and decoding that encodes shared passages once.

A text is cut into chunks where a rolling hash of the last 32 bytes hits a pattern, so equal passages give equal
chunks wherever they stand. A worker encodes a chunk the first time it meets it and keeps the ids. Then the joins are
repaired: the text around a join, from the second space before it to the second space after it, is encoded anew by the
library. Its first and its last piece must get the very ids that the chunks on both sides have for them; where they do,
the ids in between replace the chunks' ends. Where a side does not agree, the window has been too small and grows to the
whole text, encoded by the library. The joins of a block of documents are encoded together, each distinct window once.

The chunk store is a bounded part of the worker's memory, kept from task to task. Documents are never shuffled: a
passage costs one encoding per worker that meets it, and no group of copies has to meet in one task.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows and null keys are encoded
like any other; texts of any length are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import row_blocks
from tidewatch.llm.encoding import Encoder, encoder

#: Mean chunk length is 2 ** CHUNK_BITS bytes; chunk text that a worker keeps.
CHUNK_BITS, STORE_BYTES = 9, 48 << 20
#: Windows around joins whose ids a worker keeps.
WINDOWS = 100_000
#: The rolling hash's value of each byte: any fixed spread of 32-bit numbers.
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)
#: Where a piece of a text begins: at a space before a visible character.
_EDGE = re.compile(r" (?=[!-~])")


def cut_points(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of the chunks. A cut depends on the 33 bytes before it alone and never splits a character."""
    raw = np.frombuffer(data, np.uint8)
    rolled = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):  # after each step the hash covers twice as many bytes
        older = rolled[:-step] << np.uint32(step)
        rolled[step:] += older
    hit = (rolled >> np.uint32(32 - bits)) == 0
    hit[1:] &= ~hit[:-1]
    ends = np.flatnonzero(hit) + 1
    if len(ends):
        starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where characters begin
        ends = np.unique(starts[np.searchsorted(starts, ends)])
    return [*ends[ends < len(raw)].tolist(), len(raw)] if len(raw) else []


def _last_edge(text: str, end: int) -> int:
    """The last edge before ``end``, or -1."""
    at = text.rfind(" ", 0, end)
    while at >= 0 and not _EDGE.match(text, at):
        at = text.rfind(" ", 0, at)
    return at


class Chunk(NamedTuple):
    """A chunk between the ends that a join may change. ``first`` and ``last`` are the pieces next to them, which are
    encoded again with the join; their ids open and close ``ids``. A chunk with fewer than two edges is all ``head``."""

    head: str
    first: str = ""
    last: str = ""
    tail: str = ""
    ids: bytes | None = None
    first_ids: bytes = b""
    last_ids: bytes = b""


class Join(NamedTuple):
    """A window of text to encode anew, with the ids that both its sides have to agree with."""

    window: str
    before: bytes
    after: bytes


class ChunkEncoder:
    """Encodes texts chunk by chunk. ``reused`` and ``made`` count chunks and ``reused_bytes`` and ``made_bytes`` their text,
    ``joins`` the windows encoded, ``widened`` the texts in which a window did not agree with its sides."""

    def __init__(self, coder: Encoder, bits: int = CHUNK_BITS, store_bytes: int = STORE_BYTES):
        self.coder, self.bits, self.store_bytes = coder, bits, store_bytes
        self.reused = self.made = self.reused_bytes = self.made_bytes = self.joins = self.widened = 0
        self._store: dict[bytes, Chunk] = {}
        self._windows: dict[str, bytes] = {}
        self._held = 0

    def _chunk(self, data: bytes) -> Chunk:
        known = self._store.get(data)
        if known is not None:
            self.reused += 1
            self.reused_bytes += len(data)
            return known
        self.made += 1
        self.made_bytes += len(data)
        text = data.decode()
        known, opens, closes = Chunk(text), _EDGE.search(text), _last_edge(text, len(text))
        if opens and opens.start() < closes:
            opens = opens.start()
            first, last = text[opens:_EDGE.search(text, opens + 1).start()], text[_last_edge(text, closes):closes]
            known = Chunk(text[:opens], first, last, text[closes:], self.coder.encode(text[opens:closes]), self.coder.encode(first), self.coder.encode(last))
        if self._held > self.store_bytes:
            self._store.clear()
            self._held = 0
        self._store[data] = known
        self._held += 3 * len(data)
        return known

    def _parts(self, text: str) -> list[bytes | Join]:
        """The chunks' ids of a text with a join between each two of them, before the first and after the last."""
        data = text.encode()
        out, begin, join, before, before_ids = [], 0, "", "", b""
        for end in cut_points(data, self.bits):
            chunk = self._chunk(data[begin:end])
            begin = end
            join += chunk.head
            if chunk.ids is not None:
                out += [Join(before + join + chunk.first, before_ids, chunk.first_ids), chunk.ids]
                join, before, before_ids = chunk.tail, chunk.last, chunk.last_ids
        return [*out, Join(before + join, before_ids, b"")]

    def _encode_windows(self, windows: set[str]) -> None:
        if len(self._windows) > WINDOWS:
            self._windows.clear()
        new = [x for x in windows if x not in self._windows]
        self.joins += len(new)
        coded = self.coder.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self._windows.update((x, np.array(c.ids, self.coder.dtype).tobytes()) for x, c in zip(new, coded, strict=True))

    def _repaired(self, text: str, parts: list[bytes | Join]) -> bytes:
        out = []
        for part in parts:
            if isinstance(part, Join):
                ids = self._windows[part.window]
                inner = len(ids) - len(part.after)
                if inner < len(part.before) or not (ids.startswith(part.before) and ids.endswith(part.after)):
                    self.widened += 1
                    return self.coder.full(text)
                part = ids[len(part.before):inner]
            out.append(part)
        return b"".join(out)

    def encode_block(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        texts = [x or "" for x in texts]
        parts = [self._parts(x) for x in texts]
        self._encode_windows({p.window for found in parts for p in found if isinstance(p, Join)})
        return [np.frombuffer(self._repaired(x, p), self.coder.dtype) for x, p in zip(texts, parts, strict=True)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_block([text])[0]


class Decoder:
    """Ids to text as the library's ``decode`` of a vocabulary without a decoder: tokens joined by blanks."""

    def __init__(self, coder: Encoder):
        if coder.tokenizer.decoder is not None:
            raise ValueError("this vocabulary has a decoder of its own")
        size = coder.tokenizer.get_vocab_size(with_added_tokens=True)
        self._tokens = [coder.tokenizer.id_to_token(i) for i in range(size)]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self._tokens.__getitem__, ids.tolist()))


_WORKER: dict[str, tuple[ChunkEncoder, Decoder]] = {}


def _worker(vocabulary: str) -> tuple[ChunkEncoder, Decoder]:
    if vocabulary not in _WORKER:
        coder = encoder(vocabulary, words=True)
        _WORKER[vocabulary] = (ChunkEncoder(coder), Decoder(coder))
    return _WORKER[vocabulary]


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32))


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """key, ids (array<int>) and, with ``decoded``, the text that the ids decode to. ``vocabulary``: a tokenizers file
    that every executor has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, back = _worker(vocabulary)
        for block in row_blocks(batches):
            found = coder.encode_block(block.column("text").to_pylist())
            columns = [block.column("key"), _lists(found)]
            if decoded:
                columns.append(pa.array([back.decode(x) for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "ids", "decoded"] if decoded else ["key", "ids"]
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>" + (", decoded string" if decoded else "")).withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` to rows that carry ids; null ids decode to the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, back = _worker(vocabulary)
        for batch in batches:
            texts = [back.decode(np.array(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded string")

"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a sentencepiece model (B) share bytes.

Both tokenize a space and the text, as pieces of the same bytes. Per batch, two ``merge_asof`` joins keyed by document
give every token's start the other side's token that covers it; both directions together are all overlaps, and places
where tokens of both sides end cut a document into groups.

Work is done in blocks of documents, each written once: what the operator knows of each document, and the block's
distinct id pairs with the number of its documents that link them. Corpus-wide counts are summed over blocks, so a pair
that is in every document travels once per block. Counts come back to the blocks that asked for them. A block is written
as rows of bounded size, so that neither a worker nor Spark holds more than a few of them apart from the shuffle.

Defined cases: a null or empty text, and one whose tokens' bytes differ from a space and the text on either side, has
no tokens (zeros, and no groups); every row counts as a document, repeated rows and keys too; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, release_memory, row_blocks
from tidewatch.llm.encoding import BlockEncoder, TextEncoder, Words, block_encoder, encoder

#: Text bytes of the documents whose pairs are counted together. They are a block.
COUNTED_BYTES = 8 << 20
#: Bytes of a row of the written table, if it holds more than one document, and the bytes a document has besides its pairs.
ROW_BYTES, DOCUMENT_BYTES = 256 << 10, 128
#: Text bytes that are aligned together; aligning takes about a hundred times as much memory.
ALIGNED_BYTES = 512 << 10
#: Entries of each generation of the memos. There are two tokenizers, and an executor has a worker for each of its cores.
MEMO_ENTRIES = 120_000
#: A reader decodes all lists of a row group at once. Rows are large, so their size is looked at from the first one on.
_FILES = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
_SPACE = "▁"


class _Side:
    """One tokenizer's block encoder and the bytes of its tokens."""

    def __init__(self, coder: BlockEncoder, tokens: list[bytes]):
        self.coder = coder
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self._begins = np.cumsum(self.sizes) - self.sizes
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self._bytes[np.repeat(self._begins[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def byte_level_side(path: str) -> _Side:
    single = encoder(path, plain=True)
    letters = {ord(letter): byte for byte, letter in single._letters.items()}
    size = single.tokenizer.get_vocab_size(with_added_tokens=True)
    tokens = [single.tokenizer.id_to_token(i) or "" for i in range(size)]
    return _Side(block_encoder(path, plain=True, entries=MEMO_ENTRIES), [bytes(letters[ord(c)] for c in t) if all(ord(c) in letters for c in t) else t.encode() for t in tokens])


def sentencepiece_side(path: str) -> _Side:
    """Words are encoded by themselves, if no piece of the model reaches across the beginning of a word; otherwise texts
    are encoded whole."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
    dtype = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
    pack = lambda ids: np.array(ids, dtype).tobytes()
    whole = lambda text: pack(model.encode(text[1:], num_threads=1))  # the model adds the first space itself
    words = lambda found: [pack(ids) for ids in model.encode(found, num_threads=1)]
    apart = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
    return _Side(BlockEncoder(words, whole, dtype, MEMO_ENTRIES) if apart else TextEncoder(whole, dtype), tokens)


@dataclass
class Aligned:
    """A block's tokens and links. ``doc`` numbers the texts; ``a`` and ``b`` of links are places in the token arrays."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    links: pd.DataFrame
    cut_a: np.ndarray
    cut_b: np.ndarray


def _kept(side: _Side, words: Words, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, the number of each one's text, and which texts have exactly their own bytes in their tokens."""
    texts = words.texts
    ids, bounds = side.coder.encode(words)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    want = pc.binary_length(spaced).to_numpy().astype(np.int64)
    size = np.bincount(doc, side.sizes[ids], len(texts)).astype(np.int64)
    right = (size == want) & (pc.binary_length(texts).to_numpy() > 0)
    some = right[doc]
    got = side.joined(ids[some])
    chosen = spaced.filter(pa.array(right))
    own = np.frombuffer(b"".join(x.as_buffer() for x in chosen.cast(pa.binary())), np.uint8) if len(chosen) else np.zeros(0, np.uint8)
    differ = np.flatnonzero(got != own)
    if len(differ):
        rows = np.flatnonzero(right)
        right[rows[np.searchsorted(np.cumsum(want[rows]), differ, side="right")]] = False
    return ids, doc, right


def align(texts: pa.Array, side_a: _Side, side_b: _Side) -> Aligned:
    """All overlaps of a block's texts."""
    words = Words(texts, first_spaced=True)
    spaced = pc.binary_join_element_wise("", words.texts, " ")
    ids_a, doc_a, right_a = _kept(side_a, words, spaced)
    ids_b, doc_b, right_b = _kept(side_b, words, spaced)
    right = right_a & right_b
    if not right.all():
        ids_a, doc_a = ids_a[right[doc_a]], doc_a[right[doc_a]]
        ids_b, doc_b = ids_b[right[doc_b]], doc_b[right[doc_b]]
    end_a, end_b = np.cumsum(side_a.sizes[ids_a]), np.cumsum(side_b.sizes[ids_b])
    # Bytes are counted through the block, so the starts of both sides are in order as merge_asof needs them.
    a = pd.DataFrame({"start": end_a - side_a.sizes[ids_a], "doc": doc_a, "a": np.arange(len(ids_a))})
    b = pd.DataFrame({"start": end_b - side_b.sizes[ids_b], "doc": doc_b, "b": np.arange(len(ids_b))})
    covering_b = pd.merge_asof(a, b, on="start", by="doc")
    covering_a = pd.merge_asof(b, a, on="start", by="doc")
    both = a["start"].to_numpy()[covering_a["a"].to_numpy().astype(np.int64)] == b["start"].to_numpy()
    links = pd.concat([covering_b[["a", "b"]], covering_a.loc[~both, ["a", "b"]]]).astype(np.int64)
    ends = lambda x, y: y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
    return Aligned(ids_a, ids_b, doc_a, doc_b, links, ends(end_a, end_b), ends(end_b, end_a))


class _GroupText:
    """Writes groups as text: ids of A and of B with a bar between them, groups with semicolons between them."""

    def __init__(self, size_a: int, size_b: int):
        names_a, names_b = [str(i) for i in range(size_a)], [str(i) for i in range(size_b)]
        self._a = np.array([[f"{x}," for x in names_a], [f"{x}|" for x in names_a]], object)
        self._b = np.array([[f"{x}," for x in names_b], [f"{x};" for x in names_b]], object)

    def texts(self, found: Aligned, documents: int) -> list[str]:
        # A token stands behind all tokens of its side and all of the other side's groups before it.
        group_a, group_b = (np.cumsum(cut) - cut for cut in (found.cut_a, found.cut_b))
        upto_a, upto_b = (np.bincount(g, minlength=int(found.cut_a.sum())).cumsum() for g in (group_a, group_b))
        before_b = np.append(0, upto_b)[group_a]
        out = np.empty(len(found.ids_a) + len(found.ids_b), object)
        out[np.arange(len(group_a)) + before_b] = self._a[found.cut_a.astype(int), found.ids_a]
        out[np.arange(len(group_b)) + upto_a[group_b] if len(group_b) else []] = self._b[found.cut_b.astype(int), found.ids_b]
        sizes = np.bincount(found.doc_a, minlength=documents) + np.bincount(found.doc_b, minlength=documents)
        bounds, parts = np.append(0, np.cumsum(sizes)).tolist(), out.tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip(bounds, bounds[1:])]


_SIDES: dict[tuple[str, str], tuple[_Side, _Side, _GroupText]] = {}


def sides(path_a: str, path_b: str) -> tuple[_Side, _Side, _GroupText]:
    key = (path_a, path_b)
    if key not in _SIDES:
        _SIDES.clear()
        a, b = byte_level_side(path_a), sentencepiece_side(path_b)
        _SIDES[key] = a, b, _GroupText(len(a.sizes), len(b.sizes))
    return _SIDES[key]


_BLOCK_TYPES = [("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
                ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("groups", pa.list_(pa.string())),
                ("kinds", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
                ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))]
_BLOCK_SCHEMA = ("part int, seq int, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
                 "kinds array<int>, places array<int>, times array<int>, pairs array<long>, holders array<long>")


def _cuts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of about ``ROW_BYTES`` (one entry at least), as where they begin and end."""
    edges = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // ROW_BYTES)) + 1
    bounds = [0, *edges.tolist(), len(sizes)]
    return [(x, y) for x, y in zip(bounds, bounds[1:]) if y > x]


class _Counted:
    """The documents whose pairs are counted together. A pair of ids is one number, ``a * size_b + b``."""

    def __init__(self, size_b: int):
        self.size_b, self.bytes, self.documents, self.pairs, self.holders = size_b, 0, [], [], []

    def add(self, block: pa.RecordBatch, side_a: _Side, side_b: _Side, writer: _GroupText) -> None:
        texts, n = block.column("text"), block.num_rows
        found = align(texts, side_a, side_b)
        a, b = found.links["a"].to_numpy(), found.links["b"].to_numpy()
        pair = found.ids_a[a].astype(np.int64) * self.size_b + found.ids_b[b]
        top = len(side_a.sizes) * self.size_b
        codes, times = np.unique(found.doc_a[a] * top + pair, return_counts=True)
        pairs, places, holders = np.unique(codes % top, return_inverse=True, return_counts=True)
        hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in writer.texts(found, n)]
        count = lambda doc, of=None: np.bincount(doc if of is None else doc[of], minlength=n)
        # The keys are copied: a slice would keep the whole Arrow batch.
        self.documents.append((block.column("key").take(pa.array(np.arange(n))), count(found.doc_a), count(found.doc_b), count(found.doc_a, found.cut_a),
                               count(found.doc_a[a]), hashes, count(codes // top), places.astype(np.int32), times.astype(np.int32)))
        self.pairs.append(pairs)
        self.holders.append(holders)
        self.bytes += texts.nbytes

    def rows(self, part: int, seq: int) -> Iterator[pa.RecordBatch]:
        """Rows of documents, whose places are those among all pairs of the block in order, and rows of pairs."""
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        holders = np.zeros(len(pairs), np.int64)
        np.add.at(holders, at, np.concatenate(self.holders))
        for x, y in _cuts(np.full(len(pairs), pairs.itemsize + holders.itemsize)):
            yield _row(part, seq, pairs=pairs[x:y], holders=holders[x:y])
        upto = np.cumsum([len(own) for own in self.pairs]).tolist()
        for i, (keys, *numbers, hashes, kinds, places, times) in enumerate(self.documents):
            self.documents[i] = None
            places = at[upto[i] - len(self.pairs[i]):upto[i]].astype(np.int32)[places]
            ends = np.append(0, np.cumsum(kinds))
            for x, y in _cuts(kinds * (places.itemsize + times.itemsize) + DOCUMENT_BYTES):
                own = slice(ends[x], ends[y])
                of_each = dict(zip(("n_a", "n_b", "n_groups", "n_links"), (v[x:y] for v in numbers), strict=True))
                yield _row(part, seq, doc_ids=keys[x:y], **of_each, groups=hashes[x:y], kinds=kinds[x:y], places=places[own], times=times[own])


def _row(part: int, seq: int, **lists: object) -> pa.RecordBatch:
    values = {"part": part, "seq": seq} | lists
    return pa.RecordBatch.from_arrays([pa.array([values.get(name, [])], t) for name, t in _BLOCK_TYPES], [name for name, _ in _BLOCK_TYPES])


def write_blocks(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", counted_bytes: int = COUNTED_BYTES) -> DataFrame:
    """The written table of blocks, whose rows hold documents and the id pairs they link. ``counted_bytes`` changes cost only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b, writer = sides(path_a, path_b)
        part, seq, held = TaskContext.get().partitionId(), 0, _Counted(len(side_b.sizes))
        for block in row_blocks(batches, limit=ALIGNED_BYTES):
            held.add(block, side_a, side_b, writer)
            if held.bytes >= counted_bytes:
                yield from held.rows(part, seq)
                held, seq = _Counted(len(side_b.sizes)), seq + 1
                release_memory()
        if held.documents:
            yield from held.rows(part, seq)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, _BLOCK_SCHEMA), "aligned", _FILES)


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): the documents that hold each linked id pair, and whether no pair of the same A id has more."""
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("n"))
    counts = materialize(counts, "pair-counts")
    own = F.floor(F.col("pair") / size_b)
    tops = counts.groupBy(own.alias("own")).agg(F.max("n").alias("top"))  # as many rows as A has ids
    return counts.withColumn("own", own).join(F.broadcast(tops), "own").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_documents(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", counted_bytes: int = COUNTED_BYTES) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best (links whose pair no other pair of its A id outnumbers), count_sum
    (the pairs' counts, summed over links) and groups_sha256."""
    blocks = write_blocks(docs, path_a, path_b, key, text, counted_bytes)
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    asked = blocks.select(F.col("part").alias("of_part"), F.col("seq").alias("of_seq"), F.explode("pairs").alias("pair"))
    counted = asked.join(pair_counts(blocks, size_b), "pair").select("of_part", "of_seq", "pair", "n", "best")
    held = blocks.where(F.size("doc_ids") > 0).drop("pairs", "holders")  # rows of documents
    names = held.columns[2:]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        # A block's pairs are numbered in their order.
        order = np.argsort(right.column("pair").to_numpy())
        n, best = right.column("n").to_numpy()[order], right.column("best").to_numpy()[order]
        row = {name: left.column(name).combine_chunks().flatten() for name in names}
        places, times = row["places"].to_numpy(), row["times"].to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(row["doc_ids"])), row["kinds"].to_numpy())
        total = lambda x: _sums(doc, x, len(row["doc_ids"]))
        return pa.table([row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], pa.array(total(times * best[places])),
                         pa.array(total(times * n[places])), row["groups"]], [c.split()[0] for c in _RESULT.split(", ")])

    return held.groupBy("part", "seq").cogroup(counted.groupBy("of_part", "of_seq")).applyInArrow(finish, _RESULT)


def _sums(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """Exact sums of whole numbers by group; groups are in order."""
    upto = np.append(0, np.cumsum(values))
    bounds = np.searchsorted(group, np.arange(groups + 1))
    return upto[bounds[1:]] - upto[bounds[:-1]]

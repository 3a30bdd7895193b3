"""Token files, BPE and packing against the tokenizers library and plain loops."""

import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import bpe, packing, token_files
from tidewatch.llm.common import scratch_dir
from tidewatch.llm.encoding import Encoder
from tests.llm.conftest import odd_texts, wide

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BYTE_LIBRARY, WORD_LIBRARY = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
BYTE_ENCODER, WORD_ENCODER = Encoder(BYTE), Encoder(WORD, words=True)
PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "Bc", "é", "ß", "İ", "中", "'s", "12", "½", "<|endoftext|>", "<|startoftext|>", "<|", "́",
                                   " ", "\x1c", "\x85", "\x00", "😀", ",", ".", "\r\n", "­", "word by word"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_memo_equals_the_library(text):
    assert BYTE_ENCODER.ids(text).tolist() == BYTE_LIBRARY.encode(text, add_special_tokens=False).ids
    assert WORD_ENCODER.ids(text).tolist() == WORD_LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 3, 8])
@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_chunks_equal_the_library(bits, text):
    coder, back = bpe.ChunkEncoder(WORD_ENCODER, bits), bpe.Decoder(WORD_ENCODER)
    want = WORD_LIBRARY.encode(text, add_special_tokens=False).ids
    assert coder.encode(text).tolist() == want
    assert back.decode(np.array(want, int)) == WORD_LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("bits", [1, 3, 8])
@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=4))
def test_chunks_of_a_vocabulary_that_keeps_spaces(bits, texts):
    got = bpe.ChunkEncoder(BYTE_ENCODER, bits).encode_block(texts)
    assert [x.tolist() for x in got] == [BYTE_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_shared_passages_are_encoded_once():
    coder = bpe.ChunkEncoder(WORD_ENCODER, 8)
    passage = " ".join(f"word{i} other{i * 7}" for i in range(600))
    coder.encode("one beginning " + passage)
    made = coder.made
    coder.encode("quite another and longer beginning " + passage + " and an end")
    assert coder.made - made <= 4 and coder.reused >= made - 3


def test_a_window_that_disagrees_grows():
    coder = bpe.ChunkEncoder(WORD_ENCODER, 5)
    text = " ".join(f"word{i} other{i * 7}" for i in range(60))
    want = WORD_LIBRARY.encode(text, add_special_tokens=False).ids
    assert coder.encode(text).tolist() == want and not coder.widened and coder.joins > 5
    data = next(k for k, c in coder._store.items() if c.ids is not None)
    wrong = np.frombuffer(coder._store[data].ids, coder.coder.dtype).copy()
    wrong[0] += 1
    coder._store[data] = coder._store[data]._replace(ids=wrong.tobytes(), first_ids=wrong[:1].tobytes())
    assert coder.encode(text).tolist() == want and coder.widened == 1


def test_bpe_rows(spark, odd_docs, no_docs):
    got = {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe.encode(wide(odd_docs), WORD, decoded=True).collect()}
    want = set()
    for r in odd_docs.collect():
        ids = WORD_LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((r["doc_id"], tuple(ids), WORD_LIBRARY.decode(ids, skip_special_tokens=False)))
    assert got == want
    again = bpe.decode(bpe.encode(odd_docs, WORD), WORD)
    assert {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in again.collect()} == want
    assert bpe.encode(no_docs, WORD).count() == 0


def test_token_files(spark, odd_docs, no_docs):
    path = scratch_dir(spark, "tokens")
    token_files.write(wide(odd_docs).repartition(3), path, BYTE, end_id=2)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], tuple(r["ids"])) for r in token_files.read(spark, path).collect()))
    want, at = [], 0
    for r in sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")):
        ids = [*BYTE_LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((at, r["doc_id"], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), tuple(ids)))
        at += len(ids)
    assert got == want
    empty = scratch_dir(spark, "tokens")
    token_files.write(no_docs, empty, BYTE, end_id=2)
    assert token_files.read(spark, empty).count() == 0


def test_one_document_of_a_shard(spark):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 500, n).astype("<u2") for n in (5, 0, 3000, 1)]
    dictionary = token_files.train_dictionary([d.tobytes() for d in docs] * 40)
    codec = token_files.zstandard.ZstdCompressor(dict_data=token_files.zstandard.ZstdCompressionDict(dictionary))
    data = token_files.build_shard([(k, len(d), codec.compress(d.tobytes())) for k, d in zip((7, None, 9, 9), docs)], dictionary, 2)
    shard = token_files.Shard(data, dictionary)
    assert shard.ids(7).tolist() == docs[0].tolist() and shard.ids(9).tolist() == docs[2].tolist() and shard.ids_at(3).tolist() == docs[3].tolist()
    with pytest.raises(KeyError):
        shard.ids(8)
    with pytest.raises(ValueError, match="dictionary"):
        token_files.Shard(data, dictionary + b"x")


@pytest.mark.parametrize("lengths", [np.random.default_rng(1).integers(1, 2048, 900), np.random.default_rng(2).integers(600, 720, 700), np.full(500, 683),
                                     np.ones(5000, int), np.array([2047]), np.array([], int)])
def test_plan_places_every_length(lengths):
    counts = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
    plan, got = packing.plan(counts), defaultdict(int)
    for filling, times in plan.items():
        assert sum(a * b for a, b in filling) <= 2048
        for a, b in filling:
            got[a] += b * times
    assert dict(got) == counts
    best_fit = sum(packing.best_fit(counts, 2048).values())
    assert sum(plan.values()) <= 1.003 * best_fit + 1


def check_packing(rows, docs, capacity):
    want = {}
    for i, r in enumerate(docs):
        ids = [*BYTE_LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        cuts = [0, *(range(len(ids) % capacity or capacity, len(ids), capacity) if len(ids) > capacity else []), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            key = (r["doc_id"], k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))
            want[key] = want.get(key, 0) + 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(got) == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, odd_docs, no_docs, capacity):
    docs = odd_docs.collect()
    n = check_packing(packing.pack_documents(wide(odd_docs).repartition(3), BYTE, end_id=0, capacity=capacity).collect(), docs, capacity)
    tokens = sum(len(BYTE_LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1 for t in [r["text"] for r in docs])
    assert n <= 1.02 * tokens / capacity + 2
    assert packing.pack_documents(no_docs, BYTE, end_id=0).count() == 0


def test_sequences_join_their_pieces(spark, odd_docs):
    path = scratch_dir(spark, "pieces")
    packing.write_pieces(odd_docs, path, BYTE, end_id=0)
    packed = packing.pack(spark.read.parquet(path))
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) == 4 * sum(p["length"] for p in r["pieces"]) <= 4 * 2048


def test_digests_of_the_query(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in entry.queries()["op4_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = WORD_LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[r["doc_id"]] == (len(ids), sha(" ".join(map(str, ids))), sha(WORD_LIBRARY.decode(ids, skip_special_tokens=False)))
    check_packing(entry.queries()["op6_packing"](spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").collect(), 2048)


def test_fixture_texts_are_odd():
    assert len(odd_texts()) == 10


def test_pieces_with_line_ends_are_encoded_together(monkeypatch):
    coder = Encoder(BYTE)
    found = ["tide\ngauge", "buoy.\n\n", "mole", "a<|endoftext|>b", "quay\tpier\n", "日\nx", "\nfirst", "ñu's\n!"]
    wanted = [coder.tokenizer.encode(" " + x, add_special_tokens=False).ids for x in found]
    alone, single = [], coder._piece
    monkeypatch.setattr(coder, "_piece", lambda piece: alone.append(piece) or single(piece))
    assert [np.frombuffer(ids, coder.dtype).tolist() for ids in coder.spaced_words(found)] == wanted
    assert alone == [" a<|endoftext|>b", " 日\nx", " \nfirst"]

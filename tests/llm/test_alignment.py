"""Alignment of two tokenizers against a loop over all pairs of byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import rows
from tests.llm.conftest import wide
from tidewatch.llm import alignment, queries
from tidewatch.llm.common import documents
from tidewatch.llm.encoding import Encoder, Words, block_encoder

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(BYTE)
LIBRARY.encode_special_tokens = True
SPECIAL = Tokenizer.from_file(BYTE)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECE)
LETTERS = {letter: byte for byte, letter in Encoder(BYTE)._letters.items()}
PARTS = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "Bc", "é", "中", "'s", "12", "½", "<|endoftext|>", "<0x41>", "<s>", "▁", "</s>", "́", "\x1c", "\x85",
                                  "\x00", "😀", ",", "\r\n", "word by word", "unusual"]), max_size=30).map("".join)


def tokens(text):
    """Ids and bytes of both sides; nothing where the bytes are not those of a space and the text."""
    if not text:
        return [], []
    a = [(i, bytes(LETTERS[c] for c in LIBRARY.id_to_token(i))) for i in LIBRARY.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(MODEL.id_to_piece(i)[3:5], 16)]) if MODEL.is_byte(i) else MODEL.id_to_piece(i).replace("▁", " ").encode()) for i in MODEL.encode(text)]
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def spans(found):
    ends = np.cumsum([len(x) for _, x in found]).tolist()
    return [(i, end - len(x), end) for (i, x), end in zip(found, ends)]


def links_and_groups(text):
    a, b = map(spans, tokens(text))
    links = [(i, j) for i, x, y in a for j, v, w in b if x < w and v < y]
    cuts = sorted({y for _, _, y in a} & {w for _, _, w in b})
    groups, begin = [], 0
    for cut in cuts:
        inside = lambda side: ",".join(str(i) for i, x, y in side if begin < y <= cut)  # noqa: B023, E731
        groups.append(f"{inside(a)}|{inside(b)}")
        begin = cut
    return len(a), len(b), links, groups


def brute(texts):
    found = [links_and_groups(t) for t in texts]
    held = Counter(pair for _, _, links, _ in found for pair in set(links))
    top = Counter()
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    return [(a, b, len(groups), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for a, b, links, groups in found]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@settings(max_examples=80, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=4))
def test_links_and_groups_of_a_block(texts):
    side_a, side_b, writer = alignment.sides(BYTE, PIECE)
    got = alignment.align(pa.array(texts), side_a, side_b)
    links = Counter(zip(got.doc_a[got.links["a"]].tolist(), got.ids_a[got.links["a"]].tolist(), got.ids_b[got.links["b"]].tolist()))
    want = [links_and_groups(t) for t in texts]
    assert links == Counter((n, *pair) for n, w in enumerate(want) for pair in w[2])
    assert writer.texts(got, len(texts)) == [";".join(w[3]) for w in want]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(PARTS, st.none()), max_size=5))
def test_block_encoders_equal_the_libraries(texts):
    ids, bounds = block_encoder(BYTE).encode(Words(pa.array(texts, pa.string())))
    assert [ids[x:y].tolist() for x, y in zip(bounds, bounds[1:])] == [SPECIAL.encode(t or "", add_special_tokens=False).ids for t in texts]
    for side, library in zip(alignment.sides(BYTE, PIECE), (lambda t: LIBRARY.encode(t, add_special_tokens=False).ids, lambda t: MODEL.encode(t[1:]))):
        ids, bounds = side.coder.encode(Words(pa.array(texts, pa.string()), first_spaced=True))
        for t, x, y in zip(texts, bounds, bounds[1:]):
            if t:
                assert ids[x:y].tolist() == library(" " + t)


def test_memo_generations():
    plain = Encoder(BYTE)
    coder = alignment.BlockEncoder(plain.spaced_words, plain.encode, plain.dtype, entries=5)
    texts = [" ".join(f"word{i % k}" for i in range(30)) for k in range(1, 12)]
    for text in texts * 2:
        assert coder.encode(Words(pa.array([text])))[0].tolist() == plain.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("counted", [1, 8 << 20])
def test_odd_rows(spark, odd_docs, no_docs, counted):
    docs = odd_docs.where("length(text) < 40000 OR text IS NULL")
    kept = docs.collect()
    want = sorted([(r["doc_id"], *w) for r, w in zip(kept, brute([r["text"] for r in kept]))], key=str)
    got = alignment.align_documents(wide(docs).repartition(3), BYTE, PIECE, counted_bytes=counted).select("doc_id", *NUMBERS).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert alignment.align_documents(no_docs, BYTE, PIECE).count() == 0


def test_rows_of_a_block_are_small(spark):
    """A block is never one row, whatever it holds; a document in more than one row would lose links."""
    texts = [" ".join(f"{a}{i % (7 + n)} {n}{a}" for i, a in enumerate(["shore", "river ", "x½", "calm,"] * 400)) for n in range(200)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts + [None, ""] * 50)], "doc_id long, text string").coalesce(1)
    blocks = alignment.write_blocks(docs, BYTE, PIECE).collect()
    assert len({(r["part"], r["seq"]) for r in blocks}) == 1
    held = [r for r in blocks if r["doc_ids"]]
    # The numbers of a pair take 8 and 16 bytes; one more document may go beyond the bound.
    most = max(k for r in held for k in r["kinds"])
    assert len(held) > 1 and max(len(r["places"]) for r in held) <= (256 << 10) // 8 + most
    assert max(len(r["pairs"]) for r in blocks) <= (256 << 10) // 16 + 1
    pairs = sorted(p for r in blocks for p in r["pairs"])
    holders = {p: n for r in blocks for p, n in zip(r["pairs"], r["holders"], strict=True)}
    assert len(pairs) == len(holders) > 0 and sorted(i for r in held for i in r["doc_ids"]) == list(range(300))
    seen = Counter(pairs[place] for r in held for place in r["places"])
    assert seen == holders and all(sum(r["kinds"]) == len(r["places"]) == len(r["times"]) for r in held)


def test_memos_stay_small():
    """Texts whose words hardly come twice must not fill a worker: there are two of them in 3 GB with their JVM."""
    side_a, side_b, _ = alignment.sides(BYTE, PIECE)
    for n in range(0, 400_000, 20_000):
        words = Words(pa.array([" ".join(f"w{i}" for i in range(n, n + 20_000))]), first_spaced=True)
        for side in (side_a, side_b):
            side.coder.encode(words)
    assert sum(len(memo) for side in (side_a, side_b) for memo in (side.coder._young, side.coder._old)) <= 600_000


def test_the_query_on_all_rows(spark):
    """Every row of the smallest table, as registered, against the loop."""
    sf_dir = "/root/testdata/sf0.001"
    docs = documents(spark, sf_dir).collect()
    want = sorted((r["doc_id"], *w) for r, w in zip(docs, brute([r["text"] for r in docs])))
    got = queries.REG.queries["op13_alignment"](spark, sf_dir)
    assert [(int(r[0]), *r[1:]) for r in sorted(rows(got, "doc_id", *NUMBERS))] == want

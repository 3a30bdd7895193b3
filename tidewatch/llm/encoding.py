"""Byte-level BPE of the ``tokenizers`` library with a memo in front of it.

Pre-tokens never reach across the start of a white-space run of one space and a following visible character, so the
ids of a text are the ids of the pieces between such places, one after the other. Pieces repeat; the memo keeps the
ids of those a worker has met, and the library's BPE model encodes only new words. Anything unusual (special-token
strings, letters outside Latin) goes through the library's full ``encode``.

``BlockEncoder`` does the same for a block of texts at once: the texts are split in Arrow, each distinct word of the
block is looked up once, new words go to the library together, and the ids are gathered in numpy.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: A space that does not stand right before a visible character.
_ODD_SPACE = re.compile(r" (?:\s|$)")
_MARKS = frozenset(".,;:!?")
_LITTLE = sys.byteorder == "little"
_CUT = re.compile(r"(?= \S)")
_PLAIN = re.compile(r"[\t\n\x20-\x7e¡-¬®-ÿ]*")
#: The split patterns of the two vocabularies' pre-tokenizers.
_SPACED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts whose pieces can not be told apart by single spaces; the second also holds those that begin with one.
_ODD = r" (?:[^\p{L}\p{N}\p{P}\p{S}]|$)"
_ODD_OR_BLANK = _ODD + r"|^$|^[^\p{L}\p{N}\p{P}\p{S}]"
#: Pieces that begin with a visible character and hold no other space: a space before each keeps them apart.
_APART = re.compile(r"[!-~¡-¬®-ÿ][\t\n!-~¡-¬®-ÿ]*")
#: Words that go to the library together, and entries of each generation of a block encoder's memo.
_TOGETHER, GENERATION = 500, 600_000
#: Pieces that a memo keeps before it starts again: of words, and of everything else.
MEMO_WORDS, MEMO_REST = 500_000, 50_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: visible Latin-1 characters stand for
    themselves, the other bytes follow from 256 in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memo(dict):
    def __init__(self, make, entries):
        super().__init__()
        self._make, self._entries = make, entries

    def __missing__(self, key):
        value = self._make(key)
        if len(self) >= self._entries:
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encodes texts to little-endian id bytes (``dtype``), as ``encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str, words: bool = False, plain: bool = False):
        """``words``: the vocabulary lower-cases and drops white space, instead of keeping it. ``plain``: the strings of
        special tokens are ordinary text."""
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.words = words
        self.specials = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, self.specials)) or "(?!)")
        self._letters = _byte_letters()
        self._opens = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        space = self._letters[ord(" ")]
        self._opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(space)]] = True
        self._tokens = _Memo(self._token, MEMO_REST)
        self._spaced = _Memo(self._spaced_piece, MEMO_WORDS)
        self._exact = _Memo(self._bare_piece if words else self._piece, MEMO_WORDS if words else MEMO_REST)

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes() if _LITTLE else np.array(ids, self.dtype).tobytes()

    def _token(self, token: str) -> bytes:
        mapped = token.encode().decode("latin-1").translate(self._letters)
        return self._pack([t.id for t in self.model.tokenize(mapped)])

    def full(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if _PLAIN.fullmatch(piece) is None or any(s in piece for s in self.specials):
            return self.full(piece)
        found = _WORDS.findall(piece.lower()) if self.words else _SPACED.findall(piece)
        return b"".join(map(self._tokens.__getitem__, found))

    def _spaced_piece(self, piece: str) -> bytes:
        """A piece with its space before it; letters alone, or letters and one mark, need no pattern."""
        if piece.isalpha() and (piece.isascii() or _PLAIN.fullmatch(piece)):
            return self._token(" " + piece)
        word = piece[:-1]
        if piece[-1:] in _MARKS and word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)):
            return self._spaced[word] + self._tokens[piece[-1]]
        return self._piece(" " + piece)

    def _bare_piece(self, piece: str) -> bytes:
        if piece.isalpha() and (piece.isascii() or _PLAIN.fullmatch(piece)):
            return self._token(piece.lower())
        word = piece[:-1]
        if piece[-1:] in _MARKS and word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)):
            return self._exact[word] + self._tokens[piece[-1]]
        return self._piece(piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.words:
            return b"".join(map(self._exact.__getitem__, text.split(" ")))
        if _ODD_SPACE.search(text):
            return b"".join(map(self._exact.__getitem__, _CUT.split(text)))
        first, *rest = text.split(" ")
        return self._exact[first] + b"".join(map(self._spaced.__getitem__, rest))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)


    def spaced_words(self, found: list[str]) -> list[bytes]:
        """The ids of each of these pieces with its space before it. Plain ones are encoded together; their ids are told
        apart by the tokens that begin with the space."""
        out: list[bytes | None] = [None] * len(found)
        match, special = _APART.fullmatch, self._special.search
        plain = [i for i, x in enumerate(found) if match(x)]
        if special("\n".join(found)):
            plain = [i for i in plain if not special(found[i])]
        runs = [plain[i:i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        texts = [" " + " ".join([found[i] for i in run]) for run in runs]
        for run, coded in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, self.dtype)
            begins = np.flatnonzero(self._opens[ids])
            if len(begins) == len(run):
                raw, edges = ids.tobytes(), (np.append(begins, len(ids)) * self.dtype.itemsize).tolist()
                for i, a, b in zip(run, edges, edges[1:]):
                    out[i] = raw[a:b]
        return [self._piece(" " + x) if ids is None else ids for x, ids in zip(found, out, strict=True)]


class Words:
    """A block of texts (null: empty) cut at single spaces, each distinct piece once. ``first_spaced``: a space goes before
    each text, so that its first piece is like any other. Odd texts, whose pieces can not be told apart, stay whole."""

    def __init__(self, texts: pa.Array, first_spaced: bool = False):
        self.texts, self.first_spaced = pc.fill_null(texts, ""), first_spaced
        odd = pc.match_substring_regex(self.texts, _ODD_OR_BLANK if first_spaced else _ODD)
        split = pc.split_pattern(pc.if_else(odd, "", self.texts), " ")
        self.odd = odd.to_numpy(zero_copy_only=False)
        self.bounds, words = split.offsets.to_numpy(), split.flatten()
        coded = words.dictionary_encode()
        self.slots, self.entries = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # These texts' first pieces are encoded by themselves: an odd text is one piece.
        bare = np.flatnonzero(self.odd) if first_spaced else np.arange(len(self.texts))
        self.bare, self.opening = bare, words.take(pa.array(self.bounds[:-1][bare])).to_numpy(zero_copy_only=False).tolist()


class BlockEncoder:
    """Ids of whole blocks of texts. ``words`` gives the ids of pieces with a space before them, ``whole`` those of a
    text; a text's ids must be those of its pieces between single spaces, the first one without its space."""

    def __init__(self, words: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], dtype: np.dtype, entries: int = GENERATION):
        self._words, self._whole, self.dtype, self._entries = words, whole, dtype, entries
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _lookup(self, found: list[str]) -> list[bytes]:
        """Ids by the memo. It has two generations, so that common words outlive the many that come once."""
        if len(self._young) > self._entries:
            self._young, self._old = {}, self._young
        young, old = self._young, self._old
        out = list(map(young.get, found))
        missing = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            if (ids := old.get(found[i])) is None:
                missing.append(i)
            else:
                out[i] = young[found[i]] = ids
        for i, ids in zip(missing, self._words([found[i] for i in missing]), strict=True):
            out[i] = young[found[i]] = ids
        return out

    def encode(self, block: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, one text after the other, and where each text begins and the last one ends."""
        if not len(block.texts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        slots, begin = block.slots.copy(), " " if block.first_spaced else ""
        # An empty piece stands for nothing: it only opens a text, and what opens one is put in its place below.
        pool = self._lookup([x or "x" for x in block.entries])
        for row, piece in zip(block.bare.tolist(), block.opening, strict=True):
            slots[block.bounds[row]] = len(pool)
            text = begin + block.texts[row].as_py() if block.odd[row] else piece
            pool.append(self._whole(text) if text else b"")
        lengths = np.fromiter(map(len, pool), np.int64, len(pool)) // self.dtype.itemsize
        begins, each = np.cumsum(lengths) - lengths, lengths[slots]
        ends = np.cumsum(each)
        index = np.repeat(begins[slots] - (ends - each), each) + np.arange(ends[-1])
        return np.frombuffer(b"".join(pool), self.dtype)[index], np.append(0, ends)[block.bounds]


class TextEncoder(BlockEncoder):
    """The same, text by text, for vocabularies whose ids depend on more than one word."""

    def __init__(self, whole: Callable[[str], bytes], dtype: np.dtype):
        super().__init__(lambda found: [], whole, dtype)

    def encode(self, block: Words) -> tuple[np.ndarray, np.ndarray]:
        begin = " " if block.first_spaced else ""
        found = [np.frombuffer(self._whole(begin + t) if t else b"", self.dtype) for t in block.texts.to_pylist()]
        return np.concatenate([np.zeros(0, self.dtype), *found]), np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)


_ENCODERS: dict[tuple[str, bool, bool], Encoder] = {}
_BLOCKS: dict[tuple[str, bool, bool, int], BlockEncoder] = {}


def encoder(path: str, words: bool = False, plain: bool = False) -> Encoder:
    """One encoder per worker process and file, so that its memo outlives a task."""
    key = (path, words, plain)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, words, plain)
    return _ENCODERS[key]


def block_encoder(path: str, words: bool = False, plain: bool = False, entries: int = GENERATION) -> BlockEncoder:
    """One block encoder per worker process and file. ``entries``: of each generation of its memo."""
    key = (path, words, plain, entries)
    if key not in _BLOCKS:
        _BLOCKS.clear()
        single = encoder(path, words, plain)
        _BLOCKS[key] = TextEncoder(single.encode, single.dtype) if words else BlockEncoder(single.spaced_words, single.encode, single.dtype, entries)
    return _BLOCKS[key]

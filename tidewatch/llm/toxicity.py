"""A toxicity classifier: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned from the labelled sample, copies counted once: words, and stems (the first bytes of words), that
stand in toxic documents far more often than in others. A document's features are how densely those occur, how many of them only
show after common letter substitutions and inserted marks are undone, how close they stand to a second-person word,
and its rates of capitals, punctuation and marked words. Three quarters of the sample train the trees, one quarter
the calibration.

Defined cases: a null text counts as empty, and an empty text gets the score of its features; null labels are left
out; a document with several labels counts once for each; repeated rows are scored each; without labels of both kinds
the lexicon is empty and all scores are alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.llm.boosting import Isotonic, Trees, fit_isotonic, train_trees
from tidewatch.llm.common import materialize, row_blocks
from tidewatch.llm.quality import feature_rows, labelled_documents
from tidewatch.llm.simhash import shingle_hashes

#: Labelled documents in the sample; entries of the lexicon; how many times likelier an entry must be in a toxic document
#: than in another; and its least evidence (toxic documents times the logarithm of that), which chance does not reach
#: among a million candidates.
SAMPLE, ENTRIES, RATIO, EVIDENCE = 16_000, 600, 5.0, 25.0
STEMS = (4, 5, 6, 7, 8)
_BREAK = bytes(i if 97 <= i <= 122 or i >= 128 or i == 39 else 32 for i in range(256))
_PLAIN = bytes.maketrans(b"0134578@$!", b"oieastbasi")
_JOINTS = b"*.-_+~^`|#%&"
_SECOND = frozenset(w.encode() for w in "you your yours you're u ur ya thou thee du dich dir dein deine ihr euch sie ihnen "
                    "tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os tus su".split())
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
NEAR = 4


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_BREAK).split()


def _entries(text: str | None) -> set[bytes]:
    """What a document offers to the lexicon: its words, and their stems marked with a star."""
    words = set(tokens(text))
    return words | {w[:k] + b"*" for k in STEMS for w in words if len(w) >= k}


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[bytes]
    stems: frozenset[bytes]

    def hits(self, words: list[bytes]) -> list[int]:
        """Positions of words in the lexicon or with a stem in it."""
        own, stems = self.words, self.stems
        if not stems:
            return [i for i, w in enumerate(words) if w in own]
        distinct = set(words)
        suspects = distinct & own
        for k in STEMS:
            suspects.update([w for w in distinct if w[:k] in stems])
        return [i for i, w in enumerate(words) if w in suspects] if suspects else []

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode()
        words = raw.lower().translate(_BREAK).split()
        at = self.hits(words)
        whole = sum(words[i] in self.words for i in at)
        n, size = max(len(words), 1), max(len(raw), 1)
        undone = raw.lower().translate(_PLAIN, _JOINTS).translate(_BREAK).split()
        hidden = max(len(self.hits(undone)) - len(at), 0)
        near = sum(any(w in _SECOND for w in words[max(i - NEAR, 0):i + NEAR + 1]) for i in at)
        marked = len(undone) - len(words)
        upper, digit = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _DIGIT))
        shouts, asks = raw.count(b"!"), raw.count(b"?")
        marks = len(raw) - len(raw.translate(None, b".,;:'\"-")) + shouts + asks
        return [log1p(len(words)), float(len(at)), 100 * len(at) / n, float(whole), 100 * whole / n, float(len({words[i] for i in at})),
                float(hidden), 100 * hidden / n, float(near), 100 * near / n, 100 * sum(map(_SECOND.__contains__, words)) / n,
                upper / size, digit / size, shouts / size, asks / size, marks / size, marked / n]


def _one_of_each(sample: DataFrame) -> DataFrame:
    """The sample with one row for texts that share the smallest shingle hash, as copies and most near copies do: a
    passage that is copied often must not make its words look toxic."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches):
            least = np.array([min(shingle_hashes(t), default=0) for t in block.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([block.column("label"), block.column("text"), pa.array(least.view(np.int64))], ["label", "text", "mark"])

    rows = sample.select("label", "text").mapInArrow(mark, "label int, text string, mark long")
    return rows.groupBy("label", "mark").agg(F.min("text").alias("text"))


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """From a bounded sample (label, text): partial counts per task, summed; at most ``ENTRIES`` entries come back."""
    sample = materialize(_one_of_each(sample), "lexicon-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for block in row_blocks(batches):
            for label, text in zip(block.column("label").to_pylist(), block.column("text").to_pylist(), strict=True):
                found[label == 1].update(_entries(text))
        # An entry without any toxic document is never chosen.
        rows = [(w, n, found[0][w]) for w, n in found[1].items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.int64())], ["entry", "toxic", "other"])

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = totals.get(1, 0), sum(n for label, n in totals.items() if label != 1)
    if not toxic or not other:
        return Lexicon(frozenset(), frozenset())
    counts = sample.coalesce(8).select("label", "text").mapInArrow(count, "entry binary, toxic long, other long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("other") + 0.5) / (other + 1))
    evidence = F.col("toxic") * F.log(ratio)
    chosen = counts.where((ratio >= RATIO) & (evidence >= EVIDENCE)).orderBy(evidence.desc(), "entry").limit(ENTRIES)
    entries = [bytes(r["entry"]) for r in chosen.select("entry").collect()]
    stems = frozenset(e[:-1] for e in entries if e.endswith(b"*"))
    return Lexicon(frozenset(e for e in entries if not e.endswith(b"*")), stems)


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration(self.trees.margin(x)), 0, 1)


def train(docs: DataFrame, labels: DataFrame, learn: Column, bound: int = SAMPLE, key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """A model from the labelled documents for which ``learn`` (a condition on the labels' rows) holds."""
    sample = labelled_documents(docs, labels, "toxic", learn, bound, key, text)
    lexicon = learn_lexicon(sample)
    x, y, bucket = feature_rows(sample, lexicon.features)
    fit = bucket % 1024 // 256 != 3
    trees = train_trees(x[fit], y[fit], trees=60)
    return ToxicityModel(lexicon, trees, fit_isotonic(trees.margin(x[~fit]), y[~fit]))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with a score from 0 to 1: the calibrated probability of being toxic. A column of that
    name is replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches, text):
            x = np.array([model.lexicon.features(v) for v in block.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(model.probability(x))], [*block.schema.names, name])

    rows = docs.drop(name)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))

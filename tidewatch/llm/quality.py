"""A quality classifier: histogram gradient-boosted trees over statistics of the whole document.

The statistics come from the text alone. Trees are trained on a bounded sample of labelled documents and applied in
Arrow batches; documents are neither shuffled nor shortened.

Defined cases: a null text counts as empty, and an empty text gets the score of its statistics; null labels are left
out; a document with several labels counts once for each, a repeated label once; in training, equal texts of one key count
once; repeated rows are scored each; with no labels at all every score is one half; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.llm.boosting import Trees, train_trees
from tidewatch.llm.common import crc_bucket, materialize, row_blocks

#: The model is trained on at most so many labelled documents, copies of a text under one key counted once.
SAMPLE = 12_000
_UPPER, _DIGIT, _SYMBOL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>"
_CLASSES = (_UPPER, _DIGIT, _SYMBOL, b"!", b"?", b".", b",;:", b"@_=/\\{}[]()~^+\"'`", b" \t\r\x0b\x0c", b"\n", bytes(range(128, 256)))


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode()
    size = max(len(data), 1)
    shares = [(len(data) - len(data.translate(None, chars))) / size for chars in _CLASSES]
    words = data.split()
    n = max(len(words), 1)
    distinct = set(words)
    twice = sum(map(eq, words, words[1:]))
    near = sum(map(eq, words, words[2:])) + sum(map(eq, words, words[3:])) + sum(map(eq, words, words[5:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    marked = sum(map(len, distinct))
    return [*shares, log1p(len(words)), len(data) / n, len(distinct) / n, twice / n, near / n, log1p(len(lines)),
            1 - len(set(lines)) / max(len(lines), 1), len(words) / max(len(lines), 1), marked / max(len(distinct), 1),
            sum(map(bytes.isupper, distinct)) / max(len(distinct), 1), sum(map(bytes.istitle, distinct)) / max(len(distinct), 1)]


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A written sample of at most ``bound`` different rows (key, label, text) for which ``learn`` holds, those with the smallest
    hashes of key and text. Labels of keys without a document don't count; of a key that many rows have, each text counts
    once. Keys and hashes of texts meet the labels; only chosen texts travel."""
    wanted = labels.where(learn & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("print", F.xxhash64("text"))
    narrow = rows.where(F.col("key").isNotNull()).select("key", "print").distinct().join(materialize(wanted, "wanted-labels"), "key")
    taken = materialize(narrow.orderBy(F.xxhash64("key", "print"), "key", "print", "label").limit(bound), "taken-labels")
    texts = rows.join(F.broadcast(taken.select("key", "print").distinct()), ["key", "print"], "left_semi").groupBy("key", "print").agg(F.min("text").alias("text"))
    return materialize(texts.join(F.broadcast(taken), ["key", "print"]).select("key", "label", "text"), "labelled")


def feature_rows(sample: DataFrame, features: Callable[[str | None], list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and keys' crc buckets of a bounded sample, in a fixed order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches):
            found = [features(x) for x in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("bucket"), block.column("label"), pa.array(found, pa.list_(pa.float64()))], ["bucket", "label", "x"])

    rows = sample.select(crc_bucket("key", 1 << 31).cast("long").alias("bucket"), "label", "text")
    got = rows.mapInArrow(run, "bucket long, label int, x array<double>").toPandas().sort_values(["bucket", "label"], kind="stable")
    width = len(features(None))
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, width))
    order = np.lexsort([*x.T[::-1], got["label"].to_numpy(), got["bucket"].to_numpy()]) if len(got) else []
    return x[order], got["label"].to_numpy()[order], got["bucket"].to_numpy()[order]


def train(docs: DataFrame, labels: DataFrame, learn: Column, bound: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Trees:
    """Trees from the labelled documents for which ``learn`` (a condition on the labels' rows) holds."""
    x, y, _ = feature_rows(labelled_documents(docs, labels, "quality", learn, bound, key, text), statistics)
    return train_trees(x, y)


def score(docs: DataFrame, model: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with a score from 0 to 1; higher means better. A column of that name is replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches, text):
            x = np.array([statistics(v) for v in block.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(model.probability(x))], [*block.schema.names, name])

    rows = docs.drop(name)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))

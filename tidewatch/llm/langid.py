"""Language identification by a small byte convolutional network, trained and applied in numpy.

A text is cut into windows of a fixed number of bytes that cover all of it. Filters of several widths slide over a
window's byte embeddings, the strongest answer of each filter is kept, and a softmax layer turns those into language
probabilities. A text's probabilities come from the mean of its windows' log-probabilities, weighted by their letters.

To apply it, the embedding is multiplied into the filters once, so that an answer is a sum of table rows: one row for
each pair of neighbouring bytes.

Defined cases: the language of a null text or one without letters is ``und`` with score 0; null languages are not
learned from; repeated rows are predicted each; without any learned language all texts are ``und``; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewatch.llm.common import distinct_sample, row_blocks

WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 12
#: Documents in the sample, and windows that a sampled document gives (spread over it).
SAMPLE, WINDOWS = 3000, 4
EPOCHS, BATCH, RATE = 5, 64, 0.01
UNKNOWN = "und"
#: Windows that are answered together.
CHUNK = 32


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray  # (256, EMBEDDING)
    filters: list[np.ndarray]  # per width: (width, EMBEDDING, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    out_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Per width, the tables that an answer sums up, with the position that indexes them: pairs of bytes, and a
        single byte where the width is odd."""
        found = []
        for width, filters in zip(WIDTHS, self.filters, strict=True):
            single = [self.embedding @ filters[k] for k in range(width)]
            own = [(k, (single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32)) for k in range(0, width - 1, 2)]
            if width % 2:
                own.append((width - 1, single[-1].astype(np.float32)))
            found.append(own)
        return found

    def log_probabilities(self, windows: np.ndarray, tables: list | None = None) -> np.ndarray:
        """(windows, WINDOW) bytes to (windows, languages)."""
        tables = self.tables() if tables is None else tables
        out = np.empty((len(windows), len(self.languages)))
        for begin in range(0, len(windows), CHUNK):
            part = windows[begin:begin + CHUNK].T.astype(np.intp)  # positions first, so that the maximum runs over long rows
            pairs = part[:-1] * 256 + part[1:]
            pooled = []
            for width, own in zip(WIDTHS, tables, strict=True):
                n, answer = len(part) - width + 1, None
                for at, values in own:
                    rows = np.take(values, (pairs if len(values) > 256 else part)[at:at + n], axis=0, mode="clip")
                    answer = rows if answer is None else np.add(answer, rows, out=answer)
                pooled.append(answer.max(axis=0))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
            logits = hidden @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            out[begin:begin + CHUNK] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out


def windows_of(data: bytes) -> np.ndarray:
    """All bytes in rows of ``WINDOW``; the last row is filled with blanks."""
    rows = max(-(-len(data) // WINDOW), 1)
    return np.frombuffer(data.ljust(rows * WINDOW), np.uint8).reshape(rows, WINDOW)


def train_network(windows: np.ndarray, target: np.ndarray, languages: list[str], seed: int = 7) -> ByteNetwork:
    """Cross-entropy by Adam on windows of bytes."""
    rng = np.random.default_rng(seed)
    total = len(WIDTHS) * FILTERS
    model = ByteNetwork(languages, rng.normal(0, 0.5, (256, EMBEDDING)), [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS],
                        np.zeros(total), rng.normal(0, (2 / total) ** 0.5, (total, len(languages))), np.zeros(len(languages)))
    values = [model.embedding, *model.filters, model.bias, model.out, model.out_bias]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(EPOCHS if len(windows) else 0):
        for rows in np.array_split(rng.permutation(len(windows)), max(len(windows) // BATCH, 1)):
            x = windows[rows].astype(np.int64)
            e = model.embedding[x]
            line, kernel = np.arange(len(rows))[:, None], np.arange(FILTERS)[None, :]
            pooled, winners = [], []
            for width, filters in zip(WIDTHS, model.filters, strict=True):
                n = x.shape[1] - width + 1
                answer = sum(e[:, k:k + n] @ filters[k] for k in range(width))
                winners.append(answer.argmax(axis=1))
                pooled.append(answer[line, winners[-1], kernel])
            before = np.concatenate(pooled, axis=1) + model.bias
            hidden = np.maximum(before, 0)
            logits = hidden @ model.out + model.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), target[rows]] -= 1
            p /= len(rows)
            d_hidden = (p @ model.out.T) * (before > 0)
            d_embedding, d_filters = np.zeros_like(model.embedding), []
            for i, (width, filters) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                d = d_hidden[:, i * FILTERS:(i + 1) * FILTERS]
                grad = np.zeros_like(filters)
                for k in range(width):
                    won = x[line, winners[i] + k]  # the bytes that the strongest answers saw
                    grad[k] = np.einsum("bfe,bf->ef", model.embedding[won], d)
                    np.add.at(d_embedding, won, d[:, :, None] * filters[k].T[None])
                d_filters.append(grad)
            grads = [d_embedding, *d_filters, d_hidden.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return model


def train(docs: DataFrame, learn: Column, bound: int = SAMPLE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteNetwork:
    """A network from the documents for which ``learn`` holds and the language is known; at most ``bound`` of them,
    rows that repeat key, language and text counted once, and a few windows of each, spread over the text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches):
            langs, found = [], []
            for own, value in zip(block.column("lang").to_pylist(), block.column("text").to_pylist(), strict=True):
                rows = windows_of(value.encode())
                for i in sorted(set(np.linspace(0, len(rows) - 1, WINDOWS).astype(int).tolist())):
                    langs.append(own)
                    found.append(rows[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "bytes"])

    known = docs.where(learn & F.col(lang).isNotNull()).select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))
    sample = distinct_sample(known.where(F.col("text").rlike(r"\p{L}")), bound)
    rows = sorted((r["lang"], bytes(r["bytes"])) for r in sample.select("lang", "text").mapInArrow(cut, "lang string, bytes binary").collect())
    languages = sorted({lang for lang, _ in rows})
    windows = np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(-1, WINDOW)
    return train_network(windows, np.array([languages.index(lang) for lang, _ in rows], np.int64), languages)


def predict(docs: DataFrame, model: ByteNetwork, text: str = "text") -> DataFrame:
    """The rows with lang_pred and score, its probability; columns of these names are replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, letter = model.tables(), np.zeros(256, np.float64)
        letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
        for block in row_blocks(batches, text):
            data = [(x or "").encode() for x in block.column(text).to_pylist()]
            cuts = [windows_of(x) for x in data]
            first = np.cumsum([0, *map(len, cuts)])[:-1]
            windows = np.concatenate(cuts)
            weight = letter[windows].sum(axis=1) + 1e-3
            sums = np.add.reduceat(model.log_probabilities(windows, tables) * weight[:, None], first, axis=0)
            mean = sums / np.add.reduceat(weight, first)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            known = block.column(len(columns)).to_pylist()
            names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores = np.where(known, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(names, pa.string()), pa.array(scores)],
                                             [*columns, "lang_pred", "score"])

    rows = docs.drop("lang_pred", "score")
    columns = rows.columns
    if not model.languages:
        return rows.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    marked = rows.select("*", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_has_letters"))
    return marked.mapInArrow(run, StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))

"""Language identification by a small convolutional network over bytes.

Filters of several widths slide over fixed windows of a text's bytes, the
maximum of each filter over the window is kept, and a softmax layer turns these
into language probabilities. As input bytes are one-hot, a filter is a sum of
table look-ups. The network is trained in numpy with Adam on a bounded sample of
labelled rows, and applied to all windows of every text; a document's
probabilities are the means over its windows, weighted by their bytes.

The weights (under 200 kB) go to every task; texts are not shuffled. The sample
is chosen by hash on ids alone and has at most ``SAMPLE_DOCS`` rows a language,
``SAMPLE_ALL`` in all (twice that, if ids repeat), and ``SAMPLE_WINDOWS`` windows of each, spread
evenly from the first to the last of its whole text; short windows are learned from too.

Defined results: ``und`` and score 0 where the text is missing, empty or has no
letter, or where no labelled row exists. Rows without ``doc_id`` are not held
out and never learned from. Repeated rows get the same prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenara.llm.common import slices, text_buffer

SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_WINDOWS = 250, 20_000, 8
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EPOCHS, BATCH, RATE = 12, 64, 0.01
AT_ONCE = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all rows padded by blanks, each window's row, and its bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = np.full(first[-1] * WINDOW, 32, np.uint8)
    for i in np.flatnonzero(sizes):
        flat[first[i] * WINDOW : first[i] * WINDOW + sizes[i]] = data[offsets[i] : offsets[i + 1]]
    row = np.repeat(np.arange(len(sizes)), counts)
    used = np.minimum(WINDOW, sizes[row] - (np.arange(first[-1]) - first[row]) * WINDOW)
    return LOWER[flat].reshape(-1, WINDOW), row, used


class ByteNetwork:
    """Multi-width filters, max pooling and softmax over one-hot bytes."""

    def __init__(self, classes: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.weights = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.weights.append(rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32))
        self.weights.append(np.zeros(classes, np.float32))

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        best, at = [], []
        for table in self.weights[: len(WIDTHS)]:
            n = WINDOW - len(table) + 1
            out = np.take(table[0], x[:, :n], axis=0)
            for j in range(1, len(table)):
                out += np.take(table[j], x[:, j : j + n], axis=0)
            best.append(out.max(axis=1))
            if places:
                at.append(out.argmax(axis=1))
        return np.maximum(np.concatenate(best, axis=1), 0), at

    def softmax(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.weights[-2] + self.weights[-1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        parts = [self.softmax(self.pooled(x[i : i + AT_ONCE])[0]) for i in range(0, len(x), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.weights[-1])), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        hidden, at = self.pooled(x, places=True)
        error = self.softmax(hidden)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ self.weights[-2].T) * (hidden > 0)
        out, filters, rows = [], np.arange(FILTERS), np.arange(len(x))[:, None]
        for k, width in enumerate(WIDTHS):
            part, grad = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(self.weights[k])
            for j in range(width):
                np.add.at(grad[j], (x[rows, at[k] + j], filters[None, :]), part)
            out.append(grad)
        return [*out, hidden.T @ error, error.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                step += 1
                for w, g, m, v in zip(self.weights, self.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def held_out(docs: DataFrame) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    return docs.withColumn("held_out", F.coalesce(remainder == 0, F.lit(False)))


def spread_windows(text: str) -> Column:
    """At most ``SAMPLE_WINDOWS`` of the text's byte windows, from all of its length."""
    data = F.col(text).cast("binary")
    count = F.ceil(F.octet_length(text) / WINDOW)
    taken = F.least(count, F.lit(SAMPLE_WINDOWS))
    at = lambda i: F.floor(i * (count - 1) / F.greatest(taken - 1, F.lit(1))) * WINDOW
    windows = F.transform(F.sequence(F.lit(0), taken.cast("int") - 1), lambda i: F.substring(data, at(i).cast("int") + 1, F.lit(WINDOW)))
    return F.when(count > 0, windows).otherwise(F.array().cast("array<binary>"))


def training_sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """Bounded list of (lang, window), the documents chosen by a hash of the id within each language."""
    known = held_out(docs.select("doc_id", "lang")).where(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    ranked = known.withColumn("h", F.xxhash64("doc_id")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    chosen = ranked.where(F.col("r") <= SAMPLE_DOCS).orderBy("r", "lang").limit(SAMPLE_ALL).select("doc_id").distinct()
    texts = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # at most SAMPLE_ALL ids: a bounded build side
    got = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", spread_windows("text").alias("windows"))
    got = got.distinct().orderBy("doc_id", "lang", "windows").limit(2 * SAMPLE_ALL)
    return [(r["lang"], bytes(w)) for r in got.collect() for w in r["windows"]]


def train(sample: list[tuple[str, bytes]]) -> tuple[list[str], ByteNetwork | None]:
    names = sorted({lang for lang, _ in sample})
    if not names:
        return [], None
    data = np.frombuffer(b"".join(window for _, window in sample), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(window) for _, window in sample])])
    x, row, _ = windows_of(data, offsets)
    y = np.array([names.index(lang) for lang, _ in sample])[row]
    network = ByteNetwork(len(names))
    network.fit(x, y)
    return names, network


def identify(docs: DataFrame, names: list[str], network: ByteNetwork | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for every row."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            n = batch.num_rows
            mean = np.zeros((n, max(1, len(names))))
            if network is not None:
                for a, b in slices(offsets, 1 << 20):
                    x, row, used = windows_of(data, offsets[a : b + 1])
                    for i in range(0, len(x), 4096):
                        np.add.at(mean, row[i : i + 4096] + a, network.probabilities(x[i : i + 4096]) * used[i : i + 4096, None])
                mean /= np.maximum(1, np.diff(offsets))[:, None]
            known = np.array(batch.column("letters").to_pylist(), bool) & (network is not None)
            best = mean.argmax(axis=1)
            pred = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
            score = np.where(known, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters")
    return held_out(docs.select("doc_id", "text")).select("doc_id", "text", "held_out", letters).mapInArrow(run, schema)

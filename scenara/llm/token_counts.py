"""Token counts from pre-token frequencies.

Texts are cut into pre-tokens, whose encodings do not depend on what stands
around them. Each distinct pre-token of the corpus is encoded once, its number of
pieces is joined to the documents' pre-token frequencies, and a document's count
is the weighted sum. Ids of documents are never made.

Frequencies are kept in blocks of documents: a block holds its distinct
pre-tokens once and a sparse matrix of documents by pre-tokens (sorted cells as
compressed 16-bit steps). A block is closed at ``BLOCK_BYTES`` of text or ``BLOCK_TOKENS``
distinct pre-tokens, so its size is bounded however many documents there are;
only the lists of distinct pre-tokens are shuffled by content, and a very
frequent pre-token has one row for a block, not one for a document.

Defined results: a missing text is the empty text with no tokens; rows that
repeat are counted one by one; a missing ``doc_id`` stays missing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenara.llm.common import stored
from scenara.llm.tokens import library, pre_tokens

BLOCK_BYTES = 24 << 20
BLOCK_TOKENS = 500_000
LONG_STEP = 65535

BLOCKS = "block long, doc_ids array<long>, sizes array<long>, tokens array<string>, steps binary, long_steps binary, counts binary"
BLOCK_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]


class Block:
    """Documents, their distinct pre-tokens and the cells of the matrix."""

    def __init__(self) -> None:
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.index: dict[str, int] = {}
        self.cells: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        found = Counter(pre_tokens(text))
        at = np.fromiter((self.index.setdefault(t, len(self.index)) for t in found), np.int64, len(found))
        times = np.fromiter(found.values(), np.int64, len(found))
        order = np.argsort(at)
        self.cells.append(at[order])
        self.times.append(times[order])
        size = len(text.encode())
        self.doc_ids.append(doc_id)
        self.sizes.append(size)
        self.bytes += size

    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or len(self.index) >= BLOCK_TOKENS

    def batch(self, number: int) -> pa.RecordBatch:
        width = len(self.index)
        flat = np.concatenate([c + i * width for i, c in enumerate(self.cells)])
        steps = np.diff(flat, prepend=0)
        far = steps >= LONG_STEP
        small = np.where(far, LONG_STEP, steps).astype(np.uint16)
        times = np.concatenate(self.times)
        many = np.flatnonzero(times > 1)
        counts = np.concatenate([np.diff(many, prepend=0), times[many]]).astype(np.uint32)
        row = [number, self.doc_ids, self.sizes, list(self.index), *(zstandard.compress(x.tobytes()) for x in (small, steps[far], counts))]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, BLOCK_KINDS, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])


def sums(row: dict, pieces: np.ndarray) -> np.ndarray:
    """Tokens of each document of a block, given the pieces of its pre-tokens."""
    read = lambda name, kind: np.frombuffer(zstandard.decompress(row[name]), kind).astype(np.int64)
    steps = read("steps", np.uint16)
    steps[steps == LONG_STEP] = read("long_steps", np.int64)
    flat = np.cumsum(steps)
    width = max(1, len(pieces))
    counts = read("counts", np.uint32)
    many, times = np.cumsum(counts[: len(counts) // 2]), counts[len(counts) // 2 :]
    weight = pieces[flat % width] if len(flat) else np.zeros(0, np.int64)
    weight[many] *= times
    return np.bincount(flat // width, weight, minlength=len(row["doc_ids"])).astype(np.int64)


def frequency_blocks(docs: DataFrame) -> DataFrame:
    """Per-document pre-token frequencies, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc_id, text.as_py() or "")
                if block.full():
                    yield block.batch(number)
                    number, block = number + 1, Block()
        if block.doc_ids:
            yield block.batch(number)

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


def piece_counts(entries: DataFrame, path: str | None = None) -> DataFrame:
    """``block`` and ``packed`` (place and number of pieces) for entries of block, place and token.

    Entries meet by token in sorted order, and each token is encoded once by the
    library: a merge of the distinct pre-tokens' counts with their places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library(path)
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column("token").to_pylist()
            known = {t: n for t, n in known.items() if t == texts[0]}  # a token may run on into this batch
            new = [t for t in dict.fromkeys(texts) if t not in known]
            for i in range(0, len(new), 5000):
                part = new[i : i + 5000]
                known.update(zip(part, map(len, tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
            n = np.fromiter((known[t] for t in texts), np.int64, len(texts))
            packed = (batch.column("at").to_numpy().astype(np.int64) << 32) + n
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed)], ["block", "packed"])

    return entries.repartition("token").sortWithinPartitions("token").mapInArrow(run, "block long, packed long")


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` of every row."""
    blocks = stored(frequency_blocks(docs), "frequencies")
    pieces = piece_counts(blocks.select("block", F.posexplode("tokens").alias("at", "token")), path)
    by_block = pieces.groupBy("block").agg(F.collect_list("packed").alias("packed"))
    joined = blocks.drop("tokens").join(by_block, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("doc_ids", "sizes", "steps", "long_steps", "counts")}
                values = batch.column("packed")[i].values
                packed = np.sort(values.to_numpy(zero_copy_only=False)) if values is not None else np.zeros(0, np.int64)
                n = sums(row, packed & (2**32 - 1))
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")

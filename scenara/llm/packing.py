"""Packing token sequences by minimum bin slack.

Documents are encoded, closed by an end id and, where longer than a sequence,
cut so that only the first piece may be short. For each sequence the fullest
combination of available lengths that holds the longest one left is found by a
subset-sum over bitsets, and removed. Only lengths matter to this, so it works
on their histogram, which has at most ``capacity`` rows at any corpus size; a
combination is taken as often as its lengths last. The resulting runs (a few
thousand at most) say which ranks of a length go where; pieces find their place
by their rank among the pieces of their length, which salted counts number
without gathering a length in one task.

Defined results: a missing text is the empty text and packs as its end id;
repeated rows are packed one by one; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenara.llm.common import salted_rank, stored
from scenara.llm.tokens import RankEncoder

CAPACITY = 1024
END_ID = 2
SLACKS = (0, 1, 2, 4, 8, 16, 32)
ROWS_A_SALT = 500_000

NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row for each piece of each document, without its ids."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RankEncoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), END_ID).astype("<u4")
                data, n = memoryview(ids).cast("B"), len(ids)
                start, end = 0, (n - 1) % capacity + 1
                piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(data[4 * start : 4 * end])))
                    piece, start, end = piece + 1, end, end + capacity
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], capacity: int, slack: int = 0) -> dict[int, int]:
    """Lengths and multiplicities of the fullest bin that holds the longest length.

    Lengths join from long to short until a bin within ``slack`` of full exists.
    """
    longest = max(counts)
    rest, taken = capacity - longest, {longest: 1}
    reach, whole, steps = 1, (2 << rest) - 1, []
    for length in sorted(counts, reverse=True):
        if reach >> max(0, rest - slack):
            break
        left = min(counts[length] - (length == longest), rest // length)
        times = 1
        while left > 0:
            times = min(times, left)
            grown = (reach | reach << length * times) & whole
            if grown != reach:
                steps.append((length, times, reach))
                reach = grown
            left, times = left - times, times * 2
    fill = reach.bit_length() - 1
    for length, times, before in reversed(steps):
        if not before >> fill & 1:
            fill -= length * times
            taken[length] = taken.get(length, 0) + times
    return taken


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY, slacks: tuple[int, ...] = SLACKS) -> list[tuple[dict[int, int], int]]:
    """Combinations in the order taken, and how many sequences each fills.

    Accepting a little slack saves short pieces for later bins; the tolerance
    with the fewest sequences wins, the smallest of equals.
    """
    plans = [pack_within(histogram, capacity, slack) for slack in slacks]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def pack_within(histogram: dict[int, int], capacity: int, slack: int) -> list[tuple[dict[int, int], int]]:
    counts, plan = {k: n for k, n in histogram.items() if n}, []
    while counts:
        bin_ = fullest(counts, capacity, slack)
        times = min(counts[k] // n for k, n in bin_.items())
        plan.append((bin_, times))
        for k, n in bin_.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return plan


class Places:
    """Sequence and offset of the r-th piece of a length."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]) -> None:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for bin_, times in plan:
            offset = 0
            for length in sorted(bin_, reverse=True):
                first = used.get(length, 0)
                runs.setdefault(length, []).append((first, sequence, bin_[length], offset))
                used[length] = first + bin_[length] * times
                offset += length * bin_[length]
            sequence += times
        self.sequences = sequence
        self.runs = {k: np.array(v, np.int64) for k, v in runs.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            here = np.flatnonzero(lengths == length)
            runs = self.runs[int(length)]
            run = runs[np.searchsorted(runs[:, 0], ranks[here], "right") - 1]
            past = ranks[here] - run[:, 0]
            sequence[here] = run[:, 1] + past // run[:, 2]
            offset[here] = run[:, 3] + past % run[:, 2] * length
        return sequence, offset


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``."""
    pieces = stored(pieces_of(docs, capacity, path), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(pack_lengths(histogram, capacity))
    salts = max(8, sum(histogram.values()) // ROWS_A_SALT)
    ranked = salted_rank(pieces, ["length"], [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")], salts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [*(batch.column(c) for c in NAMES), *(pa.array(x, pa.int64()) for x in found)]
            yield pa.RecordBatch.from_arrays(columns, [*NAMES, "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")

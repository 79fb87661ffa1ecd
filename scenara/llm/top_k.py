"""Exact top-k inner products by a uniform threshold in three phases.

The coordinates of a vector are dealt to ``SLICES`` lists; an item's score is
the sum of its partial scores. First, the lists of one block in ``SEED`` give their best
items for a query and these are scored: the k-th best of them is a cutoff that no
member of the true top k can miss, whichever blocks it came from. Second, an item
that reaches the cutoff has a partial score of at least cutoff / slices in some
list; over all blocks, only such items are collected. Third, these are scored
exactly, and the k best of each block that reach the cutoff are ranked. A pair is so
scored once, and twice in the seed blocks only; a loose cutoff costs time, not rows.

Vectors are packed into blocks bounded in rows and bytes, in the narrowest type that holds
them. Query blocks and candidate blocks meet in the cells of a grid: a query block is sent
once for each column, a candidate block once for each row. A cell gets ``QUERY_BYTES`` and
``CANDIDATE_BYTES`` of blocks, less where there are too few cells for the cores; its blocks
are cogrouped, so that no block is ever broadcast, whatever its files' size. With Q and
N bytes of blocks, Q * N * (1 / QUERY_BYTES + 1 / CANDIDATE_BYTES) are shuffled.
Components become floor(256 * x). Blocks whose scores stay below 2**53 are multiplied as doubles,
which is exact for them; blocks of larger components as 64-bit integers. Scores
that might not fit a long stop the query.

Defined results: vectors that are missing, empty or hold a missing or
non-finite component take no part; vectors of different length are not compared.
A query's own id is never its candidate. Repeated candidate rows count one by
one, repeated query rows (equal id and vector) are one query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenara.llm.common import stored

SLICES = 4
BLOCK, BLOCK_BYTES = 2048, 4 << 20
SEED = 16
CELL = 4
QUERY_BYTES, CANDIDATE_BYTES = 32 << 20, 64 << 20
CELLS_PER_CORE = 4
SCALE = 256

BLOCKS = "block long, dim int, ids array<long>, width int, cells binary"
HITS = "query_id long, query_key long, vec_id long, score long"


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """``id`` and quantised vector ``q`` of the rows that take part."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False)))
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    return kept.select("id", F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("q"))


def narrowed(cells: np.ndarray) -> np.ndarray:
    """Whole numbers in two, four or eight bytes each; the latter stay doubles."""
    largest = np.abs(cells).max(initial=0)
    return cells.astype(np.int16 if largest < 2**15 else np.int32 if largest < 2**31 else np.float64)


def unpacked(cells: bytes, width: int, dim: int) -> np.ndarray:
    """A block of ``narrowed`` as doubles, a row for each vector."""
    return np.frombuffer(cells, {2: np.int16, 4: np.int32, 8: np.float64}[width]).astype(np.float64).reshape(-1, dim)


def blocks_of(vectors: DataFrame) -> DataFrame:
    """Vectors of one length packed into blocks of at most ``BLOCK`` rows and ``BLOCK_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, lists = batch.column("id"), batch.column("q")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            start = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                most = max(1, min(BLOCK, BLOCK_BYTES // (8 * int(dim))))
                for i in range(0, len(rows), most):
                    part = rows[i : i + most]
                    cells = narrowed(flat[(start[part][:, None] + np.arange(dim)[None, :])])
                    columns = [pa.array([number]), pa.array([dim], pa.int32()), pa.array([ids.take(pa.array(part)).to_pylist()], pa.list_(pa.int64())), pa.array([cells.itemsize], pa.int32()), pa.array([cells.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "dim", "ids", "width", "cells"])
                    number += 1

    return vectors.select("id", "q").mapInArrow(run, BLOCKS)


def integral(queries: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks in a type whose products and sums are exact."""
    largest = lambda cells: int(np.abs(cells).max(initial=0))
    bound = queries.shape[1] * largest(queries) * largest(items)
    if bound < 2**53:
        return queries, items
    if bound >= 2**63:
        raise OverflowError("scores of these components may not fit a long")
    return queries.astype(np.int64), items.astype(np.int64)


def partial_scores(queries: np.ndarray, items: np.ndarray) -> list[np.ndarray]:
    """One matrix for each slice of the coordinates; their sum is the score."""
    return [queries[:, part] @ items[:, part].T for part in np.array_split(np.arange(queries.shape[1]), min(SLICES, queries.shape[1]))]


def first_lists(queries: np.ndarray, items: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, item row and score of the best items of every list."""
    parts = partial_scores(queries, items)
    total = sum(parts)
    best = min(k + 1, items.shape[0])
    found = np.zeros(total.shape, bool)
    for part in parts:
        top = np.argpartition(-part, best - 1, axis=1)[:, :best]
        np.put_along_axis(found, top, True, axis=1)
    found &= ~own
    q, c = np.nonzero(found)
    return q, c, total[q, c]


def above_cutoff(queries: np.ndarray, items: np.ndarray, own: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items with a partial score at the uniform threshold, scored exactly."""
    parts = partial_scores(queries, items)
    reach = np.zeros(parts[0].shape, bool)
    for part in parts:
        reach |= part >= (cutoff // len(parts))[:, None]
    reach &= ~own
    q, c = np.nonzero(reach)
    score = np.einsum("ij,ij->i", queries[q], items[c]) if len(parts[0]) * len(q) < 2**22 else sum(p[q, c] for p in parts)
    keep = score >= cutoff[q]
    return q[keep], c[keep], score[keep]


def best_hits(hits: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each query: query row, item id and score."""
    q, c, score = hits
    order = np.lexsort((c, -score, q))
    rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    return [x[order][rank < k] for x in hits]


def grid(queries: tuple[int, int], candidates: tuple[int, int], cores: int) -> tuple[int, int]:
    """Rows and columns for two sides of so many blocks and bytes.

    The bytes decide; below ``CELLS_PER_CORE`` cells a core, columns are added,
    as far as there are ``CELL`` candidate blocks for each.
    """
    rows = max(1, -(-queries[1] // QUERY_BYTES))
    columns = max(1, -(-candidates[1] // CANDIDATE_BYTES))
    return rows, max(columns, min(-(-CELLS_PER_CORE * cores // rows), -(-candidates[0] // CELL)))


def scored_pairs(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query in each cell where ``left``'s and ``right``'s blocks of one
    length meet, of one phase; a column ``cutoff`` selects the later ones."""
    late = "cutoff" in left.columns
    amount = lambda side, name: side.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(name)), F.lit(0))).first()
    rows, columns = grid(amount(left, "q_cells"), amount(right, "cells"), left.sparkSession.sparkContext.defaultParallelism)
    place = lambda name, n: F.pmod(F.hash(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["row", "column", "dim"]
    # a number of partitions that is named stays: small cells are not merged into few tasks
    sent = left.withColumn("row", place("q_block", rows)).withColumn("column", every(columns)).repartition(rows * columns, *cell)
    met = right.withColumn("column", place("block", columns)).withColumn("row", every(rows)).repartition(rows * columns, *cell)

    def run(asked: pa.Table, offered: pa.Table) -> pa.Table:
        out = []
        for query in (x for batch in asked.to_batches() for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
            ids, keys = np.array(query["q_ids"], np.int64), np.array(query["q_keys"], np.int64)
            queries = unpacked(query["q_cells"], query["q_width"], query["dim"])
            best = [np.zeros(0, np.int64)] * 3
            for item in (x for batch in offered.to_batches() for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                items = np.array(item["ids"], np.int64)
                a, b = integral(queries, unpacked(item["cells"], item["width"], item["dim"]))
                own = ids[:, None] == items[None, :]
                q, c, score = above_cutoff(a, b, own, np.array(query["cutoff"], np.int64)) if late else first_lists(a, b, own, k)
                # no more than k of a cell can be among the k best of all
                found = best_hits([q, items[c], score.astype(np.int64)], k)
                best = best_hits([np.concatenate(x) for x in zip(best, found, strict=True)], k)
            q, c, score = best
            out.append(pa.table([ids[q], keys[q], c, score], [p.split()[0] for p in HITS.split(", ")]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 4, [p.split()[0] for p in HITS.split(", ")])

    return sent.groupBy(*cell).cogroup(met.groupBy(*cell)).applyInArrow(run, HITS)


def top_k(rows: DataFrame, is_query: Column, vector: str = "vector", k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best of each query.

    ``rows`` has ``id`` and ``vector``; ``is_query`` marks the rows that search.
    """
    vectors = usable(rows, vector)
    candidates = stored(blocks_of(vectors), "candidates")
    asked = vectors.where(is_query).withColumn("key", F.xxhash64("id", "q")).dropDuplicates(["id", "q"])
    packed = blocks_of(asked).withColumn("q_keys", F.lit(None).cast("array<long>"))
    # keys follow from ids and cells; queries of one id and another vector stay apart
    packed = stored(packed.drop("q_keys").select(F.col("block").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.transform("ids", lambda x, i: F.xxhash64(F.lit(0), x, F.col("block"), i)).alias("q_keys"), F.col("width").alias("q_width"), F.col("cells").alias("q_cells")), "queries")
    numbers = candidates.select("block", "dim")
    # every length has a seed block
    least = numbers.groupBy("dim").agg(F.min("block").alias("least"))
    seed = (F.pmod(F.xxhash64("block"), F.lit(SEED)) == 0) | (F.col("block") == F.col("least"))
    seeds = numbers.join(least, "dim").where(seed).select("block")

    # a semi join and an outer one can broadcast their right side only, by its size, never the blocks
    first = scored_pairs(packed, candidates.join(seeds, "block", "left_semi"), k)
    by_query = Window.partitionBy("query_key").orderBy(F.col("score").desc(), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    cut = kth.groupBy("query_key").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("low"))
    lowest = F.lit(-(2**63) + 1)
    each = packed.select("q_block", F.posexplode("q_keys").alias("at", "query_key")).join(cut, "query_key", "left")
    cutoffs = each.groupBy("q_block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("low", lowest).alias("low")))), lambda s: s["low"]).alias("cutoff"))
    later = stored(packed.join(cutoffs, "q_block", "left"), "cutoffs")
    second = scored_pairs(later, candidates, k)
    ranked = second.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""k-means with exact integer results, by Shallot search.

Every vector remembers its nearest and second-nearest centroid, an upper bound on
the distance to the first and a lower bound on that to all others. When centroids
move, the bounds move with them. A vector whose upper bound stays below its lower
one, or below half the way from its centroid to that one's nearest neighbour, keeps
its centroid unseen. For the others:

1. the distances to both remembered centroids are computed; the search starts from
   the closer one;
2. the centroids are scanned in the order of their distance from that one. By the
   triangle inequality only those within the distance to it plus the second-smallest
   distance so far can matter: this ball shrinks while the scan goes on and ends it;
3. survivors are compared in whole numbers (squared distances), ties to the smaller
   number. Bounds are floating-point, widened by ``SLACK``, and only ever skip work.

Vectors lie in blocks of rows with their bounds, so that a round reads and writes a
table once and shuffles nothing but sums: each block carries the sums of its
clusters, which are read without the vectors and added up by cluster and component.
Only ``k`` times the number of components numbers reach the driver, whatever the
number of vectors or the size of a cluster. A round's table is written to the
shared folder, and its predecessor is removed then; a lost executor costs a reread.

Defined results: vectors that are null, hold a null or a non-finite component, or have
another number of components take no part. Repeated ids are vectors of their own; a
missing id stands as the empty text in the hash. Fewer vectors than ``k`` give that
many centroids, none give no rows. Components so large that a squared distance might
not fit a long stop the query.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenara.llm.common import removed, stored_at

SCALE = 1024
BLOCK = 4096
SLACK = 1e-9

BLOCKS = (
    "ids array<long>, vectors binary, nearest binary, second binary, upper binary, lower binary, distances binary,"
    " sums array<struct<cluster:int,n:long,inertia:long,total:array<long>>>"
)


def largest_component(dims: int) -> int:
    """Components below it give squared distances that fit a long."""
    return math.isqrt((2**63 - 1) // dims) // 2


def whole_numbers(flat: np.ndarray, dims: int) -> np.ndarray:
    """floor(SCALE * x) of rows of components."""
    scaled = np.floor(SCALE * flat.astype(np.float64)).reshape(-1, dims)
    if scaled.size and np.abs(scaled).max() >= largest_component(dims):
        raise ValueError(f"a component reaches {largest_component(dims)} after scaling; distances might not fit a long")
    return scaled.astype(np.int64)


def kept_vectors(rows: DataFrame, id_column: str, vector_column: str, dims: int) -> DataFrame:
    """``id`` and ``vector`` of the vectors that take part."""
    given = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return given.where((F.size("vector") == dims) & F.forall("vector", finite))


def first_centroids(vectors: DataFrame, k: int, dims: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids, equal hashes by their components."""
    name = F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit("")))
    chosen = vectors.select(F.sha2(name.cast("binary"), 256).alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    return whole_numbers(np.array([r["vector"] for r in chosen], np.float64).reshape(-1), dims)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in whole numbers."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Centroids with the distances between them and, for each, the others by distance."""

    def __init__(self, at: np.ndarray, moved: np.ndarray | None = None) -> None:
        self.at, k = at, len(at)
        apart = np.sqrt(np.stack([squared(at, np.broadcast_to(c, at.shape)) for c in at]).astype(np.float64)) if k else np.zeros((0, 0))
        others = np.array([[j for j in range(k) if j != i] for i in range(k)], np.int64).reshape(k, max(0, k - 1))
        order = np.argsort(np.take_along_axis(apart, others, 1), axis=1, kind="stable") if k > 1 else others
        self.near = np.take_along_axis(others, order, 1)
        self.reach = np.take_along_axis(apart, self.near, 1) * (1 - SLACK)
        self.half = self.reach[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        # how far each has moved, and the farthest move among its others
        self.own = np.zeros(k) if moved is None else moved * (1 + SLACK)
        self.rest = np.array([max((self.own[j] for j in range(k) if j != i), default=0.0) for i in range(k)])


def shallot(x: np.ndarray, a: np.ndarray, b: np.ndarray, c: Centroids) -> tuple[np.ndarray, ...]:
    """Nearest and second-nearest centroid of rows and both squared distances.

    ``a`` and ``b`` are two different centroids to start from.
    """
    da, db = squared(x, c.at[a]), squared(x, c.at[b])
    swap = (db < da) | ((db == da) & (b < a))
    a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
    start, seen, way = a.copy(), b.copy(), np.sqrt(da) * (1 + SLACK)
    rows = np.arange(len(x))
    for t in range(c.near.shape[1]):
        ball = way[rows] + np.sqrt(db[rows]) * (1 + SLACK)
        rows = rows[c.reach[start[rows], t] <= ball]
        if not len(rows):
            break
        j = c.near[start[rows], t]
        new = j != seen[rows]
        r, j = rows[new], j[new]
        d = squared(x[r], c.at[j])
        first = (d < da[r]) | ((d == da[r]) & (j < a[r]))
        second = ~first & (d < db[r])
        f, s = r[first], r[second]
        b[f], db[f], a[f], da[f] = a[f], da[f], j[first], d[first]
        b[s], db[s] = j[second], d[second]
    return a, b, da, db


def assigned(x: np.ndarray, state: dict[str, np.ndarray], c: Centroids) -> dict[str, np.ndarray]:
    """``state`` (nearest, second, upper, lower) of a block after its centroids moved."""
    if len(c.at) == 1:
        return state
    near, second = state["nearest"].copy(), state["second"].copy()
    upper, lower = state["upper"] + c.own[near], state["lower"] - c.rest[near]
    open_ = np.flatnonzero(upper >= np.maximum(lower, c.half[near]))
    # the first bound is made exact before any other centroid is looked at
    exact = np.sqrt(squared(x[open_], c.at[near[open_]])) * (1 + SLACK)
    upper[open_] = exact
    open_ = open_[exact >= np.maximum(lower[open_], c.half[near[open_]])]
    a, b, da, db = shallot(x[open_], near[open_], second[open_], c)
    near[open_], second[open_] = a, b
    upper[open_], lower[open_] = np.sqrt(da) * (1 + SLACK), np.sqrt(db) * (1 - SLACK)
    return {"nearest": near, "second": second, "upper": upper, "lower": lower}


def block_of(ids: pa.Array, x: np.ndarray, state: dict[str, np.ndarray], c: Centroids, last: bool) -> dict:
    """A row of ``BLOCKS``; distances only where they are wanted."""
    near = state["nearest"]
    order = np.argsort(near, kind="stable")
    clusters, firsts, sizes = np.unique(near[order], return_index=True, return_counts=True)
    totals = np.add.reduceat(x[order], firsts, axis=0)
    d = squared(x, c.at[near]) if last else np.zeros(0, np.int64)
    # added up as Python numbers, which do not overflow
    inertia = [sum(d[near == i].tolist()) for i in clusters] if last else [0] * len(clusters)
    columns = zip(clusters.tolist(), sizes.tolist(), inertia, totals.tolist(), strict=True)
    return {
        "ids": ids.to_pylist(),
        "vectors": x.astype(np.int32).tobytes(),
        "nearest": near.astype(np.int32).tobytes(),
        "second": state["second"].astype(np.int32).tobytes(),
        "upper": state["upper"].tobytes(),
        "lower": state["lower"].tobytes(),
        "distances": d.tobytes(),
        "sums": [{"cluster": i, "n": n, "inertia": t, "total": s} for i, n, t, s in columns],
    }


KIND = pa.schema(
    [("ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("vectors", "nearest", "second", "upper", "lower", "distances")]]
    + [("sums", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("total", pa.list_(pa.int64()))])))]
)


def first_round(vectors: DataFrame, c: Centroids, dims: int, last: bool) -> DataFrame:
    """Blocks of vectors, each searched from the centroids 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            x = whole_numbers(flat, dims)
            for i in range(0, len(x), BLOCK):
                part = x[i : i + BLOCK]
                n = len(part)
                state = {"nearest": np.zeros(n, np.int64), "second": np.ones(n, np.int64), "upper": np.full(n, np.inf), "lower": np.full(n, -np.inf)}
                yield pa.RecordBatch.from_pylist([block_of(batch.column("id")[i : i + n], part, assigned(part, state, c), c, last)], KIND)

    return vectors.mapInArrow(run, BLOCKS)


def state_of(row: dict, dims: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    x = np.frombuffer(row["vectors"], np.int32).reshape(-1, dims).astype(np.int64)
    whole = {n: np.frombuffer(row[n], np.int32).astype(np.int64) for n in ("nearest", "second")}
    return x, whole | {n: np.frombuffer(row[n], np.float64) for n in ("upper", "lower")}


def next_round(blocks: DataFrame, c: Centroids, dims: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("vectors", "nearest", "second", "upper", "lower")}
                x, state = state_of(row, dims)
                ids = batch.column("ids")[i].values
                yield pa.RecordBatch.from_pylist([block_of(ids, x, assigned(x, state, c), c, last)], KIND)

    return blocks.drop("distances", "sums").mapInArrow(run, BLOCKS)


def moved(blocks: DataFrame, at: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; empty ones stay."""
    parts = blocks.select(F.inline("sums")).select("cluster", "n", F.posexplode("total").alias("component", "total"))
    sums = parts.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = at.copy()
    for r in sums.collect():
        out[r["cluster"], r["component"]] = r["total"] // r["n"]
    return out


def cluster(
    rows: DataFrame, id_column: str, vector_column: str, k: int, dims: int, rounds: int, prefix: str = "3:"
) -> DataFrame:
    """``id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    ``rounds`` times vectors go to their nearest centroids and these to the means;
    then vectors are assigned once more. Rounds that move nothing end it early,
    as the later ones would move nothing either.
    """
    spark = rows.sparkSession
    vectors = kept_vectors(rows, id_column, vector_column, dims)
    at = first_centroids(vectors, k, dims, prefix)
    if not len(at):
        schema = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    blocks, path = stored_at(first_round(vectors, Centroids(at), dims, rounds == 0), "clusters-0")
    for i in range(rounds):
        new = moved(blocks, at)
        last = i == rounds - 1 or bool((new == at).all())
        c = Centroids(new, np.sqrt(squared(new, at).astype(np.float64)))
        following, next_path = stored_at(next_round(blocks, c, dims, last), f"clusters-{i + 1}")
        removed(spark, path)
        blocks, path, at = following, next_path, new
        if last:
            break
    by_cluster = blocks.select(F.inline("sums")).groupBy("cluster").agg(F.sum("inertia").alias("inertia")).collect()
    inertia = {r["cluster"]: r["inertia"] for r in by_cluster}
    total = sum(inertia.values())
    if total >= 2**63:
        raise ValueError("the sum of all distances does not fit a long")
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                near = np.frombuffer(batch.column("nearest")[i].as_py(), np.int32)
                d = np.frombuffer(batch.column("distances")[i].as_py(), np.int64)
                named = near.tolist()
                columns = [
                    batch.column("ids")[i].values, pa.array(near), pa.array(d), pa.array([inertia[j] for j in named], pa.int64()),
                    pa.array(np.full(len(near), total)), pa.array([hashes[j] for j in named]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    out = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return blocks.select("ids", "nearest", "distances").mapInArrow(run, out)

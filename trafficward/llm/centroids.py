"""Centroid clustering of integer vectors: distances are sums of looked-up squared differences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import stored


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale · x) of each component, for vectors of exactly `dimensions` finite ones.

    Null vectors, other lengths, and vectors with a null, NaN or infinite component are left out;
    repeated rows and null ids stay. Components so large that a squared distance would pass 64
    bits raise an error. An empty table gives an empty one; other columns are ignored.
    """
    largest = int((2**62 / dimensions) ** 0.5 / 2)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("v")), dimensions), False))
            x = _matrix(whole.column("v"), dimensions).astype(np.float64)  # a null component becomes NaN
            finite = np.isfinite(x).all(axis=1)
            units = np.floor(x[finite] * scale)
            if units.size and np.abs(units).max() > largest:
                raise ValueError(f"a component passes {largest} units: squared distances would not fit 64 bits")
            flat = pa.array(units.astype(np.int32).ravel())
            ends = pa.array(np.arange(len(units) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays(
                [whole.column("vec_id").filter(pa.array(finite)), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "v"]
            )

    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return rows.mapInArrow(scaled, "vec_id long, v array<int>")


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The `k` vectors with the smallest sha256 of `seed:vec_id`, in that order (fewer if there are fewer).

    A null id hashes as an empty one; equal hashes are ordered by the vector.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(name, 256), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (n, k), from one table per dimension: occurring values by centroids.

    A block of vectors holds few distinct integers in a dimension, so each squared difference is
    computed once for a value and gathered for every vector that has it.
    """
    found = np.zeros((len(vectors), len(centroids)), np.int64)
    for d in range(vectors.shape[1]):
        values, code = np.unique(vectors[:, d], return_inverse=True)
        table = (values.astype(np.int64)[:, None] - centroids[None, :, d]) ** 2
        found += table[code]
    return found


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance to it."""
    found = distances(vectors, centroids)
    best = found.argmin(axis=1)
    return best, found[np.arange(len(found)), best]


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """For each non-empty cluster: rows, summed distance, and the sum of each component.

    A task hands on one row per cluster whatever it read; what reaches the driver is
    clusters × (dimensions + 2) numbers, a size fixed by the parameters.
    """
    k, dimensions = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dimensions + 2), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), dimensions)
            best, distance = nearest(v, centroids)
            order = np.argsort(best, kind="stable")
            present, at = np.unique(best[order], return_index=True)
            if len(present):
                total[present, 0] += np.diff(np.append(at, len(order)))
                total[present, 1] += np.add.reduceat(distance[order], at)
                total[present, 2:] += np.add.reduceat(v[order].astype(np.int64), at, axis=0)
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    rows = vectors.mapInArrow(partial, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "part"))
    found: dict[int, list[int]] = {}
    for r in rows.groupBy("cluster", "at").agg(F.sum("part").alias("total")).collect():
        found.setdefault(r["cluster"], [0] * (dimensions + 2))[r["at"]] = r["total"]
    return found


def fit_centroids(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """Centroids (k, dimensions) after `rounds` of assigning every vector and taking exact floored means.

    An empty cluster keeps its centroid. Each round is one pass over `vectors`, best a stored table.
    """
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for cluster, (count, _, *sums) in cluster_sums(vectors, centroids).items():
            centroids[cluster] = [s // count for s in sums]
    return centroids


def clustered(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each whole vector.

    `integer_vectors` says which vectors are whole and how their components become integers,
    `fit_centroids` how the centroids are found. `cluster_inertia` and `inertia` are the squared
    distances summed over the cluster and over all; the digest is that of the centroid's components
    as decimal integers joined by commas. With fewer than `k` vectors there are as many centroids.
    An empty table, or one without a whole vector, gives an empty one.
    """
    vectors = stored(integer_vectors(df, key, vector, dimensions, scale), "integer-vectors")
    centroids = fit_centroids(vectors, k, rounds, seed)
    sums = cluster_sums(vectors, centroids) if len(centroids) else {}
    spread = np.array([sums[c][1] if c in sums else 0 for c in range(len(centroids))], np.int64)
    inertia = int(spread.sum())
    digests = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best, distance = nearest(_matrix(batch.column("v"), dimensions), centroids)
            columns = [
                batch.column("vec_id"),
                pa.array(best, pa.int32()),
                pa.array(distance),
                pa.array(spread[best]),
                pa.array(np.full(len(best), inertia)),
                pa.array(digests[best]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.mapInArrow(
        assign, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    )

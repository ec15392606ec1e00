"""Clustering of vectors round centroids in whole numbers, screened by the norms of blocks.

Vectors are turned into integers and stored with norms of their segments of
``BLOCK`` components: of each segment's part along the diagonal (with its sign) and
of what is left, at a right angle to it.  By Cauchy and Schwarz the distance of two
vectors is at least that of these compressed ones, so a centroid whose bound is
above the least distance found so far can't be the nearest; only the others get
an exact integer distance.

Scale: a round reads the stored vectors once, sums in each task (a row for each
centroid and task leaves it) and shuffles those sums alone.  What goes to the
driver and into the tasks' closures is centroids x dimensions numbers, whatever
the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise

#: Components in a segment.
BLOCK = 2
#: Whole components are at most this large: distances of 64 such components fit a long.
LARGEST = 2**27
#: By which share of themselves norms and bounds may be off; far more than doubles round.
SLACK = 1e-12


def whole_components(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component x, as doubles are multiplied."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x).cast("int"))


def usable(vector: Column, dims: int, scale: float) -> Column:
    """Has a vector ``dims`` components, none null, non-finite or beyond LARGEST once scaled?"""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x) <= LARGEST)
    return F.coalesce((F.size(vector) == dims) & F.forall(vector.cast("array<double>"), fits), F.lit(False))


def segment_norms(vectors: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """(n, 2 x segments): signed norms of the segments' parts along the diagonal, then the norms of the rest; the last segment may be shorter."""
    starts = np.arange(0, vectors.shape[1], block)
    size = np.diff(np.r_[starts, vectors.shape[1]])
    sums = np.add.reduceat(vectors.astype(np.int64), starts, axis=1)
    rest = size * np.add.reduceat(vectors.astype(np.int64) ** 2, starts, axis=1) - sums**2  # exact, so never negative
    return np.hstack([sums / np.sqrt(size), np.sqrt(rest / size)])


def lower_bounds(norms: np.ndarray, others: np.ndarray) -> np.ndarray:
    """(n, m): no squared distance of vectors with these segment norms is less."""
    size, bounds = np.abs(norms), np.empty((len(norms), len(others)))
    for k, other in enumerate(others):  # a centroid at a time, for less memory
        gap = np.abs(norms - other) - SLACK * (size + np.abs(other))
        bounds[:, k] = (np.maximum(gap, 0) ** 2).sum(axis=1) * (1 - SLACK)
    return bounds


def nearest_centroids(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector the nearest centroid (of ties the first), the squared distance, and how many centroids got an exact distance."""
    bounds = lower_bounds(norms, segment_norms(centroids))
    exact = lambda rows, c: ((vectors[rows] - c) ** 2).sum(axis=1)
    first = bounds.argmin(axis=1)
    nearest = first.copy()
    best, tried = exact(slice(None), centroids[nearest]), np.ones(len(vectors), np.int32)
    for k, centroid in enumerate(centroids):
        rows = np.flatnonzero((bounds[:, k] <= best) & (first != k))
        if len(rows):
            found = exact(rows, centroid)
            tried[rows] += 1
            closer = (found < best[rows]) | (found == best[rows]) & (k < nearest[rows])
            rows = rows[closer]
            nearest[rows], best[rows] = k, found[closer]
    return nearest, best, tried


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def _compress(dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norms = segment_norms(_matrix(b.column("vector"), dims, np.int64))
            offsets = pa.array(np.arange(0, norms.size + 1, norms.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.ListArray.from_arrays(offsets, pa.array(norms.ravel()))], ["id", "vector", "norms"])

    return run


def _read(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(batch.column("vector"), dims, np.int64), _matrix(batch.column("norms"), 2 * -(-dims // BLOCK), np.float64)


def _sums(centroids: np.ndarray) -> Callable:
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            vectors, norms = _read(b, dims)
            nearest, _, _ = nearest_centroids(vectors, norms, centroids)
            counts += np.bincount(nearest, minlength=k)
            np.add.at(sums, nearest, vectors)
        rows = [{"cluster": c, "n": int(counts[c]), "sums": sums[c].tolist()} for c in range(k) if counts[c]]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    return run


def _assign(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nearest, best, tried = nearest_centroids(*_read(b, centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(nearest.astype(np.int32)), pa.array(best), pa.array(tried)], ["id", "cluster", "distance", "n_exact"])

    return run


def moved_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of their vectors; those without any stay."""
    part = vectors.select("vector", "norms").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    sums = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    moved = centroids.copy()
    for row in part.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # a row for each centroid
        moved[row["cluster"]] = [int(row[f"s{i}"]) // int(row["n"]) for i in range(centroids.shape[1])]
    return moved


def centroid_digest(centroid: np.ndarray) -> str:
    """Lowercase hex SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: float = 64, clusters: int = 16, rounds: int = 3, salt: str = "1") -> DataFrame:
    """One row per vector kept: id, cluster, distance (squared), n_exact, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components without null, NaN or infinite
    ones; components beyond LARGEST in whole numbers, whose distances a long can't
    hold, count as non-finite.  Centroids start as the kept vectors whose SHA-256
    of ``salt:id`` is least (a null id as empty text; equal ids by their
    components); fewer vectors make fewer centroids.  Ties go to the smaller
    number.  ``n_exact`` is the number of centroids whose exact distance was taken.
    Repeated rows count as often as they occur; other columns are ignored; no
    vectors, no rows.  An inertia beyond a long is null.
    """
    vector, key = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    kept = df.filter(usable(vector, dims, scale)).select(key.alias("id"), whole_components(vector, scale).alias("vector"))
    vectors = materialise(kept.mapInArrow(_compress(dims), f"id {kept.schema['id'].dataType.simpleString()}, vector array<int>, norms array<double>"), "vectors")
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.select(order.alias("order"), "vector").orderBy("order", "vector").limit(clusters).collect()
    kind = vectors.schema["id"].dataType.simpleString()
    assigned = f"id {kind}, cluster int, distance long, n_exact int"
    if not first:
        columns = f"{assigned}, cluster_inertia long, inertia long, centroid_sha256 string"
        return df.sparkSession.createDataFrame([], columns)
    centroids = np.array([row["vector"] for row in first], np.int64)
    for _ in range(rounds):
        centroids = moved_centroids(vectors, centroids)
    found = materialise(vectors.select("id", "vector", "norms").mapInArrow(_assign(centroids), assigned), "assigned")
    discard(vectors)
    inertia = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    fit = lambda x: x if x < 2**63 else None
    rows = [(c, fit(total), fit(sum(inertia.values())), centroid_digest(centroids[c])) for c, total in inertia.items()]
    sums = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sums), "cluster").select("id", "cluster", "distance", "n_exact", "cluster_inertia", "inertia", "centroid_sha256")

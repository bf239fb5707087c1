"""Nearest centroids by annulus search, and Lloyd rounds over them in exact integer arithmetic.

Centroids are sorted by norm. A vector's distance to the centroid whose norm is nearest to its own is an upper bound of the
distance to its nearest centroid, and by the triangle inequality a centroid within that bound has a norm that differs from the
vector's by no more. Two binary searches give the annulus of those norms; its centroids, ties at the rim included (the bounds
are widened by more than the rounding of the norms), are compared exactly, in integers.

Each round is one scan: a task sums its vectors by cluster, so that a row for each cluster and task is shuffled, however the
vectors are spread. Only the centroids are sent to the tasks: k * dims numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond this don't have exact squared distances in 64 bits.
LARGEST = 1 << 27
#: Numbers that are sent to every task at most: centroids times components.
MOST_SENT = 1 << 25


class Centroids:
    """Centroids (integers, [k, dims]) in the order of their norms; a centroid's number is its place in `vectors`."""

    def __init__(self, vectors: np.ndarray):
        norms = np.sqrt((vectors * vectors).sum(1).astype(float))
        self.order = np.argsort(norms, kind="stable")
        self.vectors, self.norms = vectors[self.order], norms[self.order]
        self.compared = 0

    def _squared(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        apart = x - self.vectors[at]
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each vector, the smaller one of ties, and the squared distance."""
        norms = np.sqrt(np.einsum("ij,ij->i", x, x).astype(float))
        after = np.clip(np.searchsorted(self.norms, norms), 1, max(1, len(self.norms) - 1))
        start = np.minimum(np.where(norms - self.norms[after - 1] <= self.norms[np.minimum(after, len(self.norms) - 1)] - norms, after - 1, after), len(self.norms) - 1)
        bound = np.sqrt(self._squared(x, start).astype(float))
        bound += 1e-9 * (1 + norms + bound)
        low, high = np.searchsorted(self.norms, norms - bound, "left"), np.searchsorted(self.norms, norms + bound, "right")
        best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.norms))
        rows = np.arange(len(x))
        while len(rows := rows[low[rows] < high[rows]]):
            squared, own = self._squared(x[rows], low[rows]), self.order[low[rows]]
            closer = (squared < best[rows]) | ((squared == best[rows]) & (own < number[rows]))
            best[rows[closer]], number[rows[closer]] = squared[closer], own[closer]
            self.compared += len(rows)
            low[rows] += 1
        return number, best


def _vectors(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * component) of lists that have `dims` components each."""
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(-1, dims)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST / scale:g} have no exact squared distances in 64 bits")
    return x.astype(np.int64)


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id, embedding of the rows with exactly `dims` components, none of them null or not finite."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter((F.size("embedding") == dims) & good)


def _in_parts(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            yield part.column(0), _vectors(part.column(1), dims, scale)


def _sums(rows: DataFrame, centroids: np.ndarray, scale: int) -> dict[int, tuple[int, int, list[int]]]:
    """cluster: (vectors, sum of squared distances, sums of the components), exactly; one row for each cluster."""
    k, dims = centroids.shape
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Centroids(sent.value)
        counts, spent, sums = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        for _, x in _in_parts(batches, dims, scale):
            cluster, squared = own.nearest(x)
            counts += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, x)
            for c in np.unique(cluster).tolist():
                spent[c] += sum(squared[cluster == c].tolist())  # may pass 64 bits
        found = np.flatnonzero(counts)
        arrays = [pa.array(found), pa.array(counts[found]), pa.array([str(spent[c]) for c in found.tolist()], pa.string()), pa.array(list(sums[found]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["cluster", "n", "spent", "sums"])

    parts = rows.mapInArrow(add, "cluster long, n long, spent string, sums array<long>")
    whole = lambda x: F.sum(x.cast("decimal(38,0)"))
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), whole(F.col("spent")).alias("spent"), *[whole(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(dims)]).collect()
    return {r["cluster"]: (r["n"], int(r["spent"]), [int(r[f"s{d}"]) for d in range(dims)]) for r in found}


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """One row per kept vector (vec_id, embedding, ...): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Rows whose embedding is null or empty, has not exactly `dims` components, or has a null or non-finite one are left out. A
    component x counts as the integer floor(scale * x); beyond LARGEST it is an error, as distances would pass 64 bits.
    Centroids start as the k vectors with the smallest sha256 of "<seed>:<vec_id>" (a null id is written as nothing; of rows
    with equal ids the smaller vector comes first), fewer if there are fewer. Ties go to the centroid with the smaller number,
    empty clusters keep their centroid. Repeated rows are vectors of their own; other columns are ignored. An empty table gives
    no rows.
    """
    if k * dims > MOST_SENT:
        raise ValueError(f"{k} centroids of {dims} components are more than a task is sent")
    rows = kept(vectors, dims)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.orderBy(named, F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))).limit(k).toArrow()
    if not first.num_rows:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = _vectors(first.column("embedding").combine_chunks(), dims, scale)
    for _ in range(rounds):
        for c, (n, _spent, sums) in _sums(rows, centroids, scale).items():
            centroids[c] = [x // n for x in sums]
    spent = {c: s for c, (_, s, _sums_) in _sums(rows, centroids, scale).items()}
    return rows.mapInArrow(_labeller(vectors, centroids, spent, dims, scale), "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def _labeller(vectors: DataFrame, centroids: np.ndarray, spent: dict[int, int], dims: int, scale: int) -> Callable:
    """What gives each vector its cluster and what is known of it."""
    own_spent = np.array([spent.get(c, 0) for c in range(len(centroids))], np.int64)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sent = vectors.sparkSession.sparkContext.broadcast((centroids, own_spent, sum(spent.values()), names))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_centroids, inertias, inertia, digests = sent.value
        own, digests = Centroids(own_centroids), pa.array(digests)
        for ids, x in _in_parts(batches, dims, scale):
            cluster, squared = own.nearest(x)
            arrays = [ids, pa.array(cluster.astype(np.int32)), pa.array(squared), pa.array(inertias[cluster]), pa.array(np.full(len(x), inertia, np.int64)), digests.take(pa.array(cluster))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return label

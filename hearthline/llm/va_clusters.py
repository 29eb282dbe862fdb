"""Centroid clustering over a VA-file.

A vector is kept as whole numbers and, beside them, as a few bits per dimension: the
cell of an even grid between the least and the greatest component of that dimension.
Tables of the least and the greatest squared distance from each centroid to each cell
are added up along the cells of a vector; this gives an interval per centroid. Only
centroids whose interval begins no later than the earliest end are open, and only where
more than one is open are full vectors fetched and distances computed. Assignments are
those of a full comparison.

Cells lie in one byte per two dimensions, so a table has 256 entries. Each task adds up
its vectors per centroid; sums and counts, centroids times dimensions of them whatever
the number of vectors, meet in one aggregation and go to the driver. Two tables are
stored per run: the grid with the vectors, and the final assignment.

Vectors that are null, have another number of components, or a null or non-finite one
are left out. A null id is kept and clustered, but never a first centroid. Repeated rows
count as often as they come; equal ids as first centroids are ordered by components.
Fewer vectors than centroids give fewer centroids, no vectors no rows. Further columns
are ignored. A component x becomes floor(256 * x) and must then be within 2**26, so that
all sums stay exact in 64 bits; one beyond ends the job with an error.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.session import cut_lineage

CENTROIDS = 40
DIMENSIONS = 64
ROUNDS = 5
#: Bits of a cell; two cells share a byte.
BITS = 4
SCALE = 256
REACH = 1 << 26
#: Vectors handled at once in a task, and pairs of vector and centroid compared at once.
ROWS, PAIRS = 2048, 16384

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v): kept vectors as whole numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where((F.size("embedding") == dimensions) & finite)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def first_centroids(whole: DataFrame, n: int = CENTROIDS, seed: str = "2") -> np.ndarray:
    """The ``n`` vectors with the smallest hash of their id."""
    named = whole.where(F.col("vec_id").isNotNull())
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in named.select(key.alias("key"), "v").orderBy("key", "v").limit(n).collect()], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def grid(whole: DataFrame) -> np.ndarray | None:
    """Least and greatest component per dimension, or None without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(v.shape[1])), pa.array(v.min(axis=0)), pa.array(v.max(axis=0))], ["dim", "low", "high"])

    ends = whole.select("v").mapInArrow(run, "dim bigint, low bigint, high bigint").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = np.array([(r.low, r.high) for r in ends.orderBy("dim").collect()], np.int64).reshape(-1, 2).T
    if not found.size:
        return None
    if max(-int(found.min()), int(found.max())) > REACH:
        raise ValueError(f"a component lies beyond {REACH}")
    return found


def coded(whole: DataFrame, ends: np.ndarray) -> DataFrame:
    """The vectors with their cells, two to a byte."""
    span = ends[1] - ends[0] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = (_matrix(batch.column("v")) - ends[0]) * (1 << BITS) // span
                if cells.shape[1] % 2:
                    cells = np.pad(cells, ((0, 0), (0, 1)))
                packed = (cells[:, ::2] << BITS | cells[:, 1::2]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array([row.tobytes() for row in packed], pa.binary()), batch.column("v")], ["vec_id", "cells", "v"])

    return whole.mapInArrow(run, f"vec_id {whole.schema['vec_id'].dataType.simpleString()}, cells binary, v array<bigint>")


def tables(centroids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance by pair of dimensions, centroid and byte."""
    span = ends[1] - ends[0] + 1
    cut = ends[0] + -(-np.arange((1 << BITS) + 1)[:, None] * span // (1 << BITS))  # first value of each cell
    low, high = cut[:-1, None, :], cut[1:, None, :] - 1
    off = np.maximum(np.maximum(low - centroids, centroids - high), 0) ** 2
    far = np.maximum(np.abs(centroids - low), np.abs(centroids - high)) ** 2
    out = []
    for one in (off, far):  # cell, centroid, dimension
        if one.shape[2] % 2:
            one = np.pad(one, ((0, 0), (0, 0), (0, 1)))
        pair = one[:, None, :, ::2] + one[None, :, :, 1::2]
        out.append(np.ascontiguousarray(pair.reshape(1 << 2 * BITS, *one.shape[1:2], -1).transpose(2, 0, 1)))
    return out[0], out[1]


def nearest(cells: np.ndarray, v: np.ndarray, centroids: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """Nearest centroid of each vector, ties to the smaller number, and the distances computed for it."""
    low = np.zeros((len(cells), len(centroids)), np.int64)
    high = np.zeros_like(low)
    for pair in range(cells.shape[1]):
        low += bounds[0][pair][cells[:, pair]]
        high += bounds[1][pair][cells[:, pair]]
    still = low <= high.min(axis=1, keepdims=True)
    found = still.argmax(axis=1)
    rows = np.flatnonzero(still.sum(axis=1) > 1)
    at, centroid = np.nonzero(still[rows])
    exact = np.full((rows.size, len(centroids)), np.iinfo(np.int64).max)
    for i in range(0, at.size, PAIRS):
        a, c = at[i : i + PAIRS], centroid[i : i + PAIRS]
        exact[a, c] = ((v[rows[a]] - centroids[c]) ** 2).sum(axis=1)
    found[rows] = exact.argmin(axis=1)
    return found, at.size


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for i in range(0, batch.num_rows, ROWS):
        part = batch.slice(i, ROWS)
        packed = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8)
        yield part, packed.reshape(part.num_rows, -1), _matrix(part.column("v"))


def moved(stored: DataFrame, centroids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The centroids after one round; those without vectors stay."""
    bounds = tables(centroids, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, cells, v in _slices(batch):
                found, _ = nearest(cells, v, centroids, bounds)
                counts += np.bincount(found, minlength=len(centroids))
                order = np.argsort(found, kind="stable")
                own, first = np.unique(found[order], return_index=True)
                sums[own] += np.add.reduceat(v[order], first, axis=0)
        used = np.flatnonzero(counts)
        dims = centroids.shape[1]
        if used.size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.repeat(used, dims), np.tile(np.arange(dims), used.size), np.repeat(counts[used], dims), sums[used].ravel())],
                ["cluster", "dim", "n", "total"])

    parts = stored.mapInArrow(run, "cluster bigint, dim bigint, n bigint, total bigint")
    after = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        after[r.cluster, r.dim] = r.total // r.n
    return after


def assigned(stored: DataFrame, centroids: np.ndarray, ends: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) with the squared distance to the nearest centroid."""
    bounds = tables(centroids, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells, v in _slices(batch):
                found, _ = nearest(cells, v, centroids, bounds)
                distance = ((v - centroids[found]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(found.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = stored.schema["vec_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def clusters(vectors: DataFrame, n: int = CENTROIDS, dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> DataFrame:
    """Cluster and distance per vector, with the inertia of the cluster and of all.

    ``vectors`` has (vec_id, embedding). Inertias are summed as decimals; the sum of
    all must fit 64 bits, as its column does.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dimensions)
    ends, centroids = grid(whole), first_centroids(whole, n)
    kind = whole.schema["vec_id"].dataType.simpleString()
    if ends is None or not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    stored = cut_lineage(coded(whole, ends), "vectors")
    for _ in range(rounds):
        centroids = moved(stored, centroids, ends)
    found = cut_lineage(assigned(stored, centroids, ends), "clusters")
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row per centroid, so the broadcast is bounded by their number.
    known = spark.createDataFrame(
        [(c, i, sum(inertia.values()), digests[c]) for c, i in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

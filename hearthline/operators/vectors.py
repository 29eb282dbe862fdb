"""Nearest vectors by cosine.

No pair of query and vector is ever emitted: each task multiplies one block of queries
with one block of vectors and keeps the k best of it per query. Few queries travel to all
vectors. Many are answered over cells of vectors around pivots, and the triangle
inequality over angles tells which cells a query need not visit.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.session import cut_lineage

# Large blocks keep the copies few; a task scores SLICE queries of a block at a time.
QUERY_BLOCK = 10_000
VECTOR_BLOCK = 10_000
SLICE = 500
PLACES = 9
#: Pairs of groups that a search has at least, where blocks are not larger; and the most
#: numbers of a group, 64 MB, where a block is not larger.
GROUPS = 64
GROUP_VALUES = 1 << 23
#: Vectors that cells lie around; their directions go to every task.
PIVOTS = 256
#: Similarities this near to the k-th best are still looked at, far above what rounding and angles are off.
SLACK = 1e-6
# Tasks get these functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HITS = "query_id bigint, vec_id bigint, similarity double"


def _unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


def _best(query_ids, queries, vec_ids, vectors, k: int) -> pa.Table:
    """The k best vectors of one block for each query of another."""
    return pa.concat_tables(
        _best_of_slice(query_ids[i : i + SLICE], queries[i : i + SLICE], vec_ids, vectors, k)
        for i in range(0, len(query_ids), SLICE)
    )


def _best_of_slice(query_ids, queries, vec_ids, vectors, k: int) -> pa.Table:
    """Scores at least the k-th best, ordered by score and id, cut at k."""
    similarity = np.round(queries @ vectors.T, PLACES)
    # A vector with a missing or non-finite part is no hit and finds none.
    similarity[~np.isfinite(similarity)] = -np.inf
    if len(vec_ids) > k:
        least = np.partition(similarity, -k, axis=1)[:, -k]
    else:
        least = similarity.min(axis=1)
    row, column = np.nonzero((similarity >= least[:, None]) & np.isfinite(similarity))
    found = similarity[row, column]
    order = np.lexsort((vec_ids[column], -found, row))
    row, column, found = row[order], column[order], found[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    return pa.table(
        {
            "query_id": query_ids[row[kept]],
            "vec_id": vec_ids[column[kept]],
            "similarity": found[kept],
        }
    )


def _cut(hits: pa.Table, k: int) -> pa.Table:
    """The k best hits of each query among those of several blocks."""
    query_ids, vec_ids, found = (hits.column(c).to_numpy() for c in ("query_id", "vec_id", "similarity"))
    order = np.lexsort((vec_ids, -found, query_ids))
    own = query_ids[order]
    return hits.take(pa.array(order[np.arange(len(own)) - np.searchsorted(own, own) < k]))


def _ids(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _scan(corpus: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Every task scores its own vectors against all queries; nothing shuffles yet."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hits = _best(query_ids, queries, _ids(batch["vec_id"]), _unit_rows(batch["embedding"]), k)
                yield from hits.to_batches()

    return corpus.select("vec_id", "embedding").mapInArrow(score, HITS)


def _unit_pivots(corpus: DataFrame, n: int) -> np.ndarray:
    """Directions of the vectors with the smallest hashes of their ids."""
    some = corpus.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("embedding").toArrow()
    units = _unit_rows(some.column("embedding"))
    return units[np.isfinite(units).all(axis=1) & units.any(axis=1)]


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def _finite_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with a finite vector, some at a time; others find nothing and are never found."""
    for i in range(0, batch.num_rows, SLICE):
        part = batch.slice(i, SLICE)
        units = _unit_rows(part.column("embedding"))
        fine = np.flatnonzero(np.isfinite(units).all(axis=1))
        if fine.size:
            yield part.take(pa.array(fine)), units[fine]


def _with_columns(part: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, columns.values())], [*part.schema.names, *columns])


def _in_cells(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, embedding, cell, angle, zero): the nearest pivot of each vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, units in _finite_slices(batch):
                angles = _angles(units, pivots)
                cell = angles.argmin(axis=1)
                yield _with_columns(part, cell=cell, angle=angles[np.arange(len(cell)), cell], zero=~units.any(axis=1))

    kept = corpus.select("vec_id", "embedding")
    return kept.mapInArrow(assign, _ddl(kept) + ", cell bigint, angle double, zero boolean")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _homes(queries: DataFrame, pivots: np.ndarray, sizes: np.ndarray, k: int) -> DataFrame:
    """(query_id, embedding, cell): the nearest cell that holds k vectors, or the nearest one."""
    poor = (sizes < k) * 10.0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, units in _finite_slices(batch):
                yield _with_columns(part, cell=(_angles(units, pivots) + poor).argmin(axis=1))

    kept = queries.select("query_id", "embedding")
    return kept.mapInArrow(assign, _ddl(kept) + ", cell bigint")


def _visits(homes: DataFrame, pivots: np.ndarray, cells: np.ndarray) -> DataFrame:
    """(query_id, embedding, cell): every other cell that may hold a hit of the query.

    A vector at angle a from its pivot and a query at angle b from that pivot are at
    least abs(a - b) apart, whatever their places; ``cells`` has the least and the
    greatest a of each cell, its size, and whether it holds a zero vector, which is at
    similarity 0 to all. ``floor`` is the k-th best similarity found at home.
    """
    least, most, sizes, zero = cells

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, units in _finite_slices(batch):
                angles = _angles(units, pivots)
                apart = np.maximum(np.maximum(angles - most, least - angles), 0)
                best = np.where(zero, np.maximum(np.cos(apart), 0), np.cos(apart))
                floor = part.column("floor").to_numpy(zero_copy_only=False).astype(float)
                floor = np.where(np.isnan(floor), -np.inf, floor)
                able = (best >= floor[:, None] - SLACK) & (sizes > 0)
                able[np.arange(len(floor)), part.column("cell").to_numpy()] = False
                row, cell = np.nonzero(able)
                if row.size:
                    yield _with_columns(part.select(["query_id", "embedding"]).take(pa.array(row)), cell=cell)

    kind = _ddl(homes.select("query_id", "embedding"))
    return homes.select("query_id", "embedding", "cell", "floor").mapInArrow(assign, kind + ", cell bigint")


def _search(visits: DataFrame, placed: DataFrame, sizes: np.ndarray, k: int, query_block: int, vector_block: int) -> DataFrame:
    """The k best of each visited cell for each of its visitors.

    A cell and its visitors are cut into groups of one or more blocks, by hash; a pair of
    groups is one group of rows, multiplied block by block. So a row moves once per group of
    the other side and not once per block, and while cells are below ``GROUP_VALUES`` the
    number of groups, and how often a row moves, stays as it is however many rows there are.
    Cells nobody visits do not move.
    """
    spark = placed.sparkSession
    visited = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    head = placed.select(F.size("embedding")).first()
    most = GROUP_VALUES // max(head[0] if head else 1, 1)
    v_rows = max(vector_block, most)
    q_rows = max(query_block, min(most, -(-sum(visited.values()) // GROUPS)))
    # One row per pivot at most, so the broadcast is bounded by their number.
    blocks = F.broadcast(spark.createDataFrame(
        [(c, -(-n // q_rows), -(-int(sizes[c]) // v_rows)) for c, n in visited.items() if sizes[c]],
        "cell bigint, q_groups bigint, v_groups bigint"))

    def numbers(n: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    left = visits.join(blocks, "cell").select(
        "query_id", "embedding", "cell", F.pmod(F.xxhash64("query_id"), F.col("q_groups")).alias("q_group"), numbers("v_groups").alias("v_group"))
    right = placed.join(blocks, "cell").select(
        "vec_id", "embedding", "cell", numbers("q_groups").alias("q_group"), F.pmod(F.xxhash64("vec_id"), F.col("v_groups")).alias("v_group"))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "similarity": pa.array([], pa.float64())})
        query_ids, queries = _ids(a["query_id"]), _unit_rows(a["embedding"])
        vec_ids, vectors = _ids(b["vec_id"]), _unit_rows(b["embedding"])
        return pa.concat_tables(
            _cut(pa.concat_tables(
                _best(query_ids[i : i + query_block], queries[i : i + query_block], vec_ids[j : j + vector_block], vectors[j : j + vector_block], k)
                for j in range(0, len(vec_ids), vector_block)
            ), k)
            for i in range(0, len(query_ids), query_block)
        )

    keys = ["cell", "q_group", "v_group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, HITS)


def _ranked(hits: DataFrame) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("vec_id")))
    return hits.withColumn("pos", rank)


def _indexed(queries: DataFrame, corpus: DataFrame, k: int, query_block: int, vector_block: int, pivots: int) -> DataFrame:
    """Hits over cells around pivots, exact by the triangle inequality.

    Each query is answered in its own cell first. Its k-th best similarity there rules
    out the cells all of whose vectors are too far off, and only the rest is visited:
    queries move to cells, and a vector moves once per block of visitors of its cell.
    """
    at = _unit_pivots(corpus, pivots)
    if not len(at):  # only zero vectors: one cell around any direction
        width = corpus.select(F.size("embedding")).first()
        at = np.eye(1, width[0] if width else 1)
    placed = cut_lineage(_in_cells(corpus, at), "cells")
    cells = np.zeros((4, len(at)))
    found = placed.groupBy("cell").agg(F.min("angle"), F.max("angle"), F.count(F.lit(1)), F.max(F.col("zero").cast("int")))
    for cell, *values in found.collect():
        cells[:, cell] = values
    cells = (*cells[:3], cells[3] > 0)
    homes = _homes(queries, at, cells[2], k)
    near = cut_lineage(_search(homes, placed, cells[2], k, query_block, vector_block), "near-hits")
    floor = _ranked(near).where(F.col("pos") == k).select("query_id", F.col("similarity").alias("floor"))
    visits = cut_lineage(_visits(homes.join(floor, "query_id", "left"), at, cells), "visits")
    return near.unionByName(_search(visits, placed, cells[2], k, query_block, vector_block))


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_block: int = QUERY_BLOCK,
    vector_block: int = VECTOR_BLOCK,
    pivots: int = PIVOTS,
) -> DataFrame:
    """The exact k nearest vectors per query: (query_id, pos, vec_id, similarity).

    ``queries`` has (query_id, embedding), ``corpus`` has (vec_id, embedding), all
    of one dimension. Up to ``query_block`` queries (checked by reading at most
    one more) travel to every task; more go through cells around ``pivots`` vectors.
    """
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    queries, corpus = queries.where(usable), corpus.where(usable)
    head = queries.limit(query_block + 1).toArrow()
    if head.num_rows == 0:
        hits = corpus.sparkSession.createDataFrame([], HITS)
    elif head.num_rows <= query_block:
        hits = _scan(corpus, _ids(head["query_id"]), _unit_rows(head["embedding"]), k)
    else:
        hits = _indexed(queries, corpus, k, query_block, vector_block, pivots)
    return _ranked(hits).where(F.col("pos") <= k)


def centroids(corpus: DataFrame, label: str = "label", places: int = 6) -> DataFrame:
    """Mean vector per label, combined in the map tasks by (label, axis)."""
    axes = corpus.select(label, F.posexplode("embedding").alias("axis", "x"))
    means = axes.groupBy(label, "axis").agg(
        (F.sum(F.round(F.col("x").cast("double") * 10**places).cast("bigint"))
         / F.count(F.lit(1)) / 10**places).alias("mean")
    )
    ordered = F.array_sort(F.collect_list(F.struct("axis", "mean")))
    return means.groupBy(F.col(label).cast("bigint").alias("query_id")).agg(
        F.transform(ordered, lambda s: s["mean"]).alias("embedding")
    )

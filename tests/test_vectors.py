"""Nearest vectors against brute force, by both routes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import vectors


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(300, 8)).astype(np.float32)
    corpus[50:60] = corpus[0]
    corpus[299] = 0
    asked = rng.normal(size=(40, 8)).astype(np.float32)
    asked[0] = corpus[0]
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(corpus)], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id bigint, embedding array<float>")
    return corpus.astype(float), asked.astype(float), c, q


def brute(corpus, asked, k):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    similarity = np.round(unit(asked) @ unit(corpus).T, vectors.PLACES)
    return {
        (q, pos + 1, int(v))
        for q in range(len(asked))
        for pos, v in enumerate(sorted(range(len(corpus)), key=lambda i: (-similarity[q, i], i))[:k])
    }


@pytest.mark.parametrize("blocks", [
    {}, {"query_block": 7, "vector_block": 23, "pivots": 9}, {"query_block": 39, "vector_block": 1000}, {"query_block": 20, "pivots": 1}])
def test_knn(sets, blocks):
    corpus, asked, c, q = sets
    got = {(r["query_id"], r["pos"], r["vec_id"]) for r in vectors.knn(q, c, 6, **blocks).collect()}
    assert got == brute(corpus, asked, 6)


def test_knn_in_slices(sets, monkeypatch):
    corpus, asked, c, q = sets
    monkeypatch.setattr(vectors, "SLICE", 9)
    for blocks in ({}, {"query_block": 20, "vector_block": 70}):
        got = {(r["query_id"], r["pos"], r["vec_id"]) for r in vectors.knn(q, c, 3, **blocks).collect()}
        assert got == brute(corpus, asked, 3)


def test_knn_with_fewer_vectors_than_k(sets):
    corpus, asked, c, q = sets
    got = vectors.knn(q, c.where("vec_id < 3"), 6).collect()
    assert len(got) == 3 * len(asked)


def test_knn_skips_missing_vectors_and_takes_no_queries(spark, sets):
    _, _, c, q = sets
    more = c.unionByName(spark.createDataFrame([(999, None)], "vec_id bigint, embedding array<float>"))
    assert vectors.knn(q, more, 2).count() == 80
    assert vectors.knn(q.where("false"), c, 2).count() == 0


def test_cells_too_far_off_are_not_visited(spark):
    """Tight clusters, copies, zero and non-finite vectors; most pairs of query and cell are ruled out."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 16))
    corpus = np.concatenate([m + rng.normal(size=(40, 16)) * 0.05 for m in middles])
    corpus[100:140] = corpus[100]
    corpus[7] = 0
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(corpus)] + [(900, [float("nan")] * 16), (901, [float("inf")] * 16)], "vec_id bigint, embedding array<double>")
    q = c.where("vec_id < 900").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["pos"], r["vec_id"]) for r in vectors.knn(q, c, 5, query_block=50, vector_block=30, pivots=24).collect()}
    assert got == brute(corpus, corpus, 5)
    at = vectors._unit_pivots(c.where("vec_id < 900"), 24)
    placed = vectors._in_cells(c, at)
    assert placed.count() == 480
    cells = np.zeros((4, len(at)))
    for r in placed.groupBy("cell").agg(F.min("angle"), F.max("angle"), F.count(F.lit(1)), F.max(F.col("zero").cast("int"))).collect():
        cells[:, r[0]] = r[1:]
    homes = vectors._homes(q, at, cells[2], 5)
    near = vectors._ranked(vectors._search(homes, placed, cells[2], 5, 50, 30)).where("pos = 5").selectExpr("query_id", "similarity AS floor")
    visits = vectors._visits(homes.join(near, "query_id", "left"), at, (*cells[:3], cells[3] > 0))
    assert visits.count() < 480 * (cells[2] > 0).sum() / 3


def test_knn_of_zero_vectors_only(spark):
    c = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(9)], "vec_id bigint, embedding array<float>")
    got = vectors.knn(c.withColumnRenamed("vec_id", "query_id"), c, 2, query_block=3).collect()
    assert {(r["pos"], r["vec_id"], r["similarity"]) for r in got} == {(1, 0, 0.0), (2, 1, 0.0)} and len(got) == 18


def test_centroids(spark, sets):
    corpus, _, c, _ = sets
    got = {r[0]: r[1] for r in vectors.centroids(c.selectExpr("vec_id % 2 AS label", "embedding")).collect()}
    for label in (0, 1):
        np.testing.assert_allclose(got[label], corpus[label::2].mean(axis=0), atol=1e-6)


def test_rows_move_once_per_group_not_per_block(spark):
    """With blocks of four rows every vector would move to some hundred blocks of queries."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(600, 4))
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id bigint, embedding array<double>")
    q = c.withColumnRenamed("vec_id", "query_id")
    placed = vectors._in_cells(c, vectors._unit_pivots(c, 1))
    visits = q.withColumn("cell", F.lit(0).cast("bigint"))
    hits = vectors._search(visits, placed, np.array([600]), 3, 4, 4)
    got = {(r["query_id"], r["pos"], r["vec_id"]) for r in vectors._ranked(hits).where("pos <= 3").collect()}
    assert got == brute(rows, rows, 3)
    assert hits.count() == 600 * 3  # one group of vectors; 150 blocks would give 150 times as many

"""Centroid clustering against its SQL and a plain version in whole numbers."""

import hashlib
import math
import random

import __spark_entry__ as entry_module
import compare
import numpy as np
import pytest

from hearthline.llm import va_clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, v string"


def plain(rows, n, dims, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:n]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    total = sum(d for d, _ in found)
    return [(i, k, d, sum(e for e, o in found if o == k), total, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, found, strict=True)]


def test_query_equals_its_sql(spark, sf_dir, duck):
    key = "op13_va_clusters"
    assert compare.spark_table(entry_module.queries()[key](spark, sf_dir)) == compare.duck_table(duck, entry_module.oracle_sql()[key])


@pytest.mark.parametrize("dims", [3, 4])
def test_hard_rows_against_a_plain_version(spark, dims):
    rng = random.Random(dims)
    rows = [(i, [float(np.float32(rng.gauss(rng.choice((-3, 0, 3)), 0.4))) for _ in range(dims)]) for i in range(300)]
    rows += [(1000 + i, v) for i, v in enumerate([None, [], [1.0], [1.0] * (dims + 1), [None] + [1.0] * (dims - 1), [float("nan")] * dims, [float("inf")] * dims])]
    rows += [rows[5], rows[5], (5, rows[9][1]), (None, rows[3][1]), (None, None)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(4)
    got = [tuple(r) for r in va_clusters.clusters(frame, n=12, dimensions=dims, rounds=3).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows, 12, dims, 3), key=repr)


def test_few_equal_and_no_vectors(spark):
    same = spark.createDataFrame([(i, [0.5, -0.25], "x", "y") for i in range(6)], SCHEMA)
    got = va_clusters.clusters(same, n=40, dimensions=2, rounds=2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 6
    empty = va_clusters.clusters(same.limit(0), dimensions=2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError):
        va_clusters.clusters(spark.createDataFrame([(1, [1e9, 0.0], "x", "y")], SCHEMA), dimensions=2)


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, (500, 6))
    ends = np.array([v.min(axis=0), v.max(axis=0)])
    centroids = v[:9]
    cells = (v - ends[0]) * 16 // (ends[1] - ends[0] + 1)
    packed = (cells[:, ::2] << 4 | cells[:, 1::2]).astype(np.uint8)
    low, high = va_clusters.tables(centroids, ends)
    exact = ((v[:, None, :] - centroids) ** 2).sum(axis=2)
    assert (sum(low[p][packed[:, p]] for p in range(3)) <= exact).all()
    assert (sum(high[p][packed[:, p]] for p in range(3)) >= exact).all()
    found, compared = va_clusters.nearest(packed, v, centroids, (low, high))
    assert (found == exact.argmin(axis=1)).all() and compared < exact.size

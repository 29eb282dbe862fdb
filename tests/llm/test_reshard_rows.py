"""Resharding of repeated rows, and of tables whose columns are named like the operator's own."""

import collections
import itertools

import numpy as np
from pyspark.sql import functions as F

from hearthline.llm import reshard


def test_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(reshard, "CHUNK", 300)
    rows = [(1, "same text " * 10)] * 2000 + [(None, None)] * 500 + [(i, f"text {i} " * (i % 17)) for i in range(2, 392)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name in ("size", "part", "block", "order_key", "old_shard", "doc", "shard"):
        docs = docs.withColumn(name, F.lit("x"))
    got = reshard.reshard(docs).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    assert all(r["size"] == r["part"] == r["doc"] == "x" for r in got)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r.shard] += len(r.text or "") + 8
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(len(t or "") for _, t in rows) + 8
    # A piece of an old shard ends within half a row of where the flow cuts it, on either side.
    flow, total = reshard.plan(reshard.placed(docs), reshard.OLD_SHARDS, reshard.NEW_SHARDS).flow, sum(size.values())
    assert len(size) == reshard.NEW_SHARDS
    for j, found in size.items():
        assert abs(found - total / reshard.NEW_SHARDS) <= sum(row[j] > 0 for row in flow) * largest
    assert max(size.values()) < 1.05 * min(size.values())


def test_flow_equals_brute_force():
    chance = np.random.default_rng(1)
    for _ in range(30):
        supply = chance.integers(0, 5, 3).tolist()
        total = sum(supply)
        capacity = [total // 3 + (j < total % 3) for j in range(3)]
        cost = chance.integers(0, 4, (3, 3))
        flow = reshard.min_cost_flow(supply, capacity, lambda i, j, cost=cost: int(cost[i][j]))
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == capacity
        ways = [[w for w in itertools.product(range(x + 1), repeat=3) if sum(w) == x] for x in supply]
        best = min(
            sum(w[i][j] * cost[i][j] for i in range(3) for j in range(3))
            for w in itertools.product(*ways) if [sum(c) for c in zip(*w, strict=True)] == capacity
        )
        assert sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(3)) == best

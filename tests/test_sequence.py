"""Hot keys cut into chunks give what whole keys give."""

import datetime
import random

import pytest
from compare import spark_table
from pyspark.sql import functions as F

from hearthline.operators import health, models, registry, sequence

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def probes(spark):
    """One service holds most rows; times repeat, cluster, leave gaps or are missing."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        service = 1 if rng.random() < 0.7 else rng.choice([2, 3, None])
        seconds = rng.choice([rng.randrange(300), rng.randrange(90_000), 5])
        ts = None if i % 90 == 0 else START + datetime.timedelta(seconds=seconds)
        rows.append((i, service, ts, rng.random() < 0.4, round(rng.random() * 400, 2)))
    df = spark.createDataFrame(
        rows, "sample_id bigint, service_id bigint, ts timestamp, online boolean, latency_ms double")
    return df.cache()


@pytest.fixture(scope="module")
def requests(probes):
    return probes.selectExpr(
        "sample_id AS request_id", "service_id AS server_id",
        "IF(online, 'a', IF(latency_ms < 100, 'b', 'c')) AS model", "ts")


WHOLE = 10**9


@pytest.mark.parametrize("rows_per_chunk", [20, 250])
@pytest.mark.parametrize("operator", [
    health.unhealthy_runs, health.sample_lag, health.sample_gaps, health.rolling_latency,
    lambda p, **kw: health.stale_flag(p, "2024-02-01 00:00:00", **kw),
])
def test_probe_operators(probes, operator, rows_per_chunk):
    assert spark_table(operator(probes, rows_per_chunk=rows_per_chunk)) == spark_table(
        operator(probes, rows_per_chunk=WHOLE))


@pytest.mark.parametrize("rows_per_chunk", [20, 250])
@pytest.mark.parametrize("operator", [
    models.model_swaps,
    lambda r, **kw: models.model_residency(r, 60, **kw),
    lambda r, **kw: models.model_residency(r, 60, pinned=("b",), **kw),
])
def test_request_operators(requests, operator, rows_per_chunk):
    assert spark_table(operator(requests, rows_per_chunk=rows_per_chunk)) == spark_table(
        operator(requests, rows_per_chunk=WHOLE))


@pytest.mark.parametrize("rows_per_chunk", [7, 100])
def test_positions(spark, rows_per_chunk):
    df = spark.range(0, 400, 1).selectExpr("IF(id % 5 = 0, id % 3, 9) AS owner", "id * id AS place")
    got = registry.with_position(df, "owner", "place", rows_per_chunk)
    want = registry.with_position(df, "owner", "place", WHOLE)
    assert spark_table(got) == spark_table(want)


def chunk_sizes(ordered, key):
    return {r["_chunk"]: r["count"] for r in ordered.rows.where(key).groupBy("_chunk").count().collect()}


def test_a_hot_key_is_spread(probes):
    """The window over a hot key runs in more than one group; other keys stay whole."""
    ordered = sequence.in_order(probes, ["service_id"], ["ts", "sample_id"], 250)
    sizes = chunk_sizes(ordered, "service_id = 1")
    assert len(sizes) > 3 and max(sizes.values()) <= 250
    assert set(chunk_sizes(ordered, "service_id is null or service_id > 1")) == {None}
    assert ordered.rows.count() == probes.count()


def test_equal_and_missing_times_are_spread(spark):
    """All rows of the hot key have one time or none; chunks follow the id, and text is cut by whole values."""
    df = spark.range(20_000).selectExpr("1 AS k", "IF(id % 2 = 0, NULL, 5) AS place", "id", "concat('same beginning ', id) AS name")
    for order in (["place", "id"], ["name"]):
        ordered = sequence.in_order(df, ["k"], order, 1000)
        sizes = chunk_sizes(ordered, "k = 1")
        assert sum(sizes.values()) == 20_000 and max(sizes.values()) <= 1000
        ends = ordered.rows.groupBy("_chunk").agg(F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high")).orderBy("_chunk").collect()
        key = lambda row: tuple((v is not None, v) for v in row)
        assert all(key(a["high"]) < key(b["low"]) for a, b in zip(ends, ends[1:], strict=False))


def test_keys_below_the_limit_take_one_shuffle(probes):
    ordered = sequence.in_order(probes, ["service_id"], ["ts", "sample_id"], WHOLE)
    assert not ordered.split
    plan = health.unhealthy_runs(probes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 or "AdaptiveSparkPlan" in plan and plan.count("Exchange") <= 2


def test_counts_with_totals(probes):
    for rows_per_chunk in (40, WHOLE):
        ordered = sequence.in_order(probes, ["service_id"], ["ts", "sample_id"], rows_per_chunk)
        rows = ordered.running_count(F.col("online"), "so_far", "of").done().collect()
        for service in (1, 2, 3, None):
            own = [r for r in rows if r["service_id"] == service]
            assert {r["of"] for r in own} == {sum(r["online"] for r in own)} == {max(r["so_far"] for r in own)}


def test_parts_of_a_hot_owner(spark):
    df = spark.range(0, 300).selectExpr("IF(id % 10 = 0, 1, 2) AS owner", "300 - id AS place", "id")
    whole = registry.post_parts(df, "owner", "place", F.col("id"), 7)
    cut = registry.post_parts(df, "owner", "place", F.col("id"), 7, rows_per_chunk=50)
    assert spark_table(whole) == spark_table(cut)
    assert {r["parts"] for r in cut.where("owner = 2").collect()} == {39}


def test_runs_by_hand(spark):
    marks = "-++---+----+--"
    rows = [(i, 1, START + datetime.timedelta(seconds=i), m == "+", 1.0) for i, m in enumerate(marks)]
    df = spark.createDataFrame(
        rows, "sample_id bigint, service_id bigint, ts timestamp, online boolean, latency_ms double")
    got = sorted((r["started"].second, r["ended"].second, r["failures"])
                 for r in health.unhealthy_runs(df, rows_per_chunk=4).collect())
    assert got == [(3, 5, 3), (7, 10, 4)]


def test_idle_gap_equal_to_limit_starts_a_span(spark):
    rows = [(i, 1, "m", START + datetime.timedelta(seconds=s)) for i, s in enumerate([0, 59, 119, 178])]
    df = spark.createDataFrame(rows, "request_id bigint, server_id bigint, model string, ts timestamp")
    got = sorted((r["loaded"].minute * 60 + r["loaded"].second, r["requests"])
                 for r in models.model_residency(df, 60).collect())
    assert got == [(0, 2), (119, 2)]
    stays = models.model_residency(df, 60, pinned=("m",)).collect()
    assert [(r["requests"], r["unloaded"]) for r in stays] == [(4, None)]


def test_text_keys_are_cut_along_their_order(spark):
    words = ["", "a", "b", "aé", "é", "zz", "prefix-1", "prefix-2", "日本", "\U0001f600"] + [f"k{i:03}" for i in range(60)]
    df = spark.createDataFrame([("o", w) for w in words], "owner string, name string")
    got = {r["name"]: r["position"] for r in registry.with_position(df, "owner", "name", rows_per_chunk=5).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words, key=lambda w: w.encode()))}


def test_short_chunks_share_tasks(spark):
    """Many short chunks make no tasks or files of their own, and repeated rows at their borders keep their order."""
    df = spark.range(3000).selectExpr("1 AS k", "id DIV 3 AS place")
    ordered = sequence.in_order(df, ["k"], ["place"], 8)
    sizes = chunk_sizes(ordered, "k = 1")
    assert len(ordered.rows.inputFiles()) <= 4 and max(sizes.values()) <= 8 and sum(sizes.values()) == 3000
    for ahead, apart in ((False, 1), (True, -1)):
        rows = ordered.look_around(1, {"other": lambda w: F.lag("place").over(w)}, ahead).done()
        got = {r[0]: r[1] for r in rows.groupBy((F.col("place") - F.col("other")).alias("d")).count().collect()}
        assert got == {None: 1, 0: 2000, apart: 999}

"""Health operators on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from hearthline.operators import health as h
from hearthline.operators import search as s
from hearthline.plans import views

START = datetime.datetime(2024, 1, 1)


def samples(spark, rows):
    """(service, second, online, latency)"""
    made = [(i, sv, START + datetime.timedelta(seconds=t), on, ms) for i, (sv, t, on, ms) in enumerate(rows)]
    return spark.createDataFrame(
        made, "sample_id bigint, service_id bigint, ts timestamp, online boolean, latency_ms double")


def test_any_answer_in_time_is_online(spark):
    raw = spark.createDataFrame(
        [(0, 200, 10.0, "{}"), (1, 503, 2999.9, "x"), (2, 404, 3000.0, "{}"), (3, None, 5.0, None)],
        "sample_id bigint, http_code int, latency_ms double, body string",
    ).withColumns({"service_id": F.lit(1), "ts": F.lit(START)})
    loose = [r["online"] for r in h.probe_outcome(raw).orderBy("sample_id").collect()]
    strict = [r["online"] for r in h.probe_outcome(raw, require_json=True).orderBy("sample_id").collect()]
    assert loose == [True, True, False, False]
    assert strict == [True, False, False, False]


def test_latest_breaks_ties_by_sample(spark):
    df = samples(spark, [(1, 5, True, 1.0), (1, 5, False, 2.0), (1, 4, True, 3.0), (2, 0, True, 4.0)])
    got = sorted((r["service_id"], r["sample_id"], r["online"]) for r in h.latest_status(df).collect())
    assert got == [(1, 1, False), (2, 3, True)]


def test_cards(spark):
    services = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "service_id bigint, name string")
    df = samples(spark, [(1, 0, True, 99.0), (2, 0, False, 300.0), (3, 0, None, None)])
    got = {r["name"]: (r["label"], r["accent"], r["band"]) for r in h.status_cards(services, h.latest_status(df)).collect()}
    assert got == {
        "a": ("Online", "#00e87a", "go"), "b": ("Offline", "#ff3b5c", "stop"),
        "c": ("Offline", "#ff3b5c", None), "d": ("Checking", "#2e2e2e", None)}


def test_last_refresh_of_nothing_is_a_dash(spark):
    assert tuple(h.last_refresh(samples(spark, [])).first()) == (None, "—")
    assert h.last_refresh(samples(spark, [(1, 3661, True, 1.0)])).first()["shown"] == "01:01:01"


@pytest.mark.parametrize("tries,want", [(1, (None, "not reachable")), (2, (2, "ready")), (20, (2, "ready"))])
def test_wait_until_ready(spark, tries, want):
    df = samples(spark, [(1, 2, True, 1.0), (1, 0, False, 1.0), (1, 1, True, 1.0)])
    assert tuple(h.wait_until_ready(df, tries).select("tries", "state").first()) == want


def test_missed_polls_and_stale(spark):
    df = samples(spark, [(1, 0, True, 1.0), (1, 10, True, 1.0), (1, 45, True, 1.0)])
    lag = [(r["gap_us"], r["missed_polls"]) for r in h.sample_lag(df).orderBy("sample_id").collect()]
    assert lag == [(None, None), (10_000_000, 0), (35_000_000, 2)]
    stale = h.stale_flag(df, "2024-01-01 00:00:50").orderBy("sample_id").collect()
    assert [(r["stood_us"], r["stale"]) for r in stale] == [
        (10_000_000, True), (35_000_000, True), (5_000_000, False)]


def test_rollup_values(spark):
    df = samples(spark, [(1, i, i != 3, float(ms)) for i, ms in enumerate([50, 150, 350, 250])])
    r = h.health_rollup(df).first()
    assert (r["samples"], r["uptime"], r["mean_ms"], r["p95_ms"]) == (4, 0.75, 200.0, 335.0)
    assert (r["go"], r["warn"], r["stop"]) == (1, 2, 1)


def test_approximate_forms_come_close(spark, sf_dir):
    probes = views.probes(spark, sf_dir).withColumn("service_id", F.lit(1))
    exact, rough = (h.health_rollup(probes, "month", exact=e).first()["p95_ms"] for e in (True, False))
    assert rough == pytest.approx(exact, rel=0.02)
    results = views.results(spark, sf_dir)
    close = {tuple(r)[:2]: r["hosts"] for r in s.distinct_engines(results, approximate=True).collect()}
    for row in s.distinct_engines(results).collect():
        assert close[tuple(row)[:2]] == pytest.approx(row["hosts"], abs=2)


def test_merged_sketches_keep_their_error(spark):
    """Hours of a service with many samples, merged to a day and over all services."""
    df = spark.range(40_000).selectExpr(
        "id AS sample_id", "id % 2 AS service_id", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(id % 24 AS int), 0, 0) AS ts",
        "id % 5 <> 0 AS online", "IF(id % 50 = 0, NULL, (id * 7919 % 10007) / 10) AS latency_ms")
    stored = h.health_sketches(df)
    assert stored.count() == 24  # an even hour for one service, an odd one for the other
    for keys, groups in ((("service_id",), [0, 1]), ((), [None])):
        rows = h.merged_health(stored, keys=keys).collect()
        assert len(rows) == len(groups)
        for row in rows:
            own = sorted(r["latency_ms"] for r in df.where("latency_ms IS NOT NULL").collect() if not keys or r["service_id"] == row["service_id"])
            rank = sum(x <= row["p95_ms"] for x in own) / len(own)
            assert abs(rank - 0.95) <= 2 * h.RANK_ERROR
            assert abs(row["mean_ms"] - sum(own) / len(own)) < 0.01 and row["uptime"] == 0.8


def test_latencies_beyond_the_limit_count_as_the_limit(spark):
    rows = [(i, 1, datetime.datetime(2024, 1, 1), True, x) for i, x in enumerate([5.0, 1e12, None, -3.0])]
    df = spark.createDataFrame(rows, "sample_id bigint, service_id bigint, ts timestamp, online boolean, latency_ms double")
    counted = [r[0] for r in df.select(h.timed_hundredths(df.latency_ms)).collect()]
    assert sorted(x for x in counted if x is not None) == [0, 500, 300_000]
    assert h.health_rollup(df).collect()[0]["p95_ms"] <= 3000
    nothing = h.merged_health(h.health_sketches(df.where("latency_ms IS NULL"))).collect()
    assert [(r["samples"], r["mean_ms"], r["p95_ms"]) for r in nothing] == [(1, None, None)]

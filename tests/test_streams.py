"""Streams over several batches, restarts and late rows against their batch twins."""

import datetime
import random
import tempfile
from types import SimpleNamespace

import pandas as pd
import pytest
from compare import spark_table

from hearthline.operators import health, models
from hearthline.plans import views
from hearthline.session import MERGE_SESSIONS
from hearthline.sources.payloads import stream_captures
from hearthline.sources.probes import PROBE_SCHEMA, read_probes, read_samples, stream_files, stream_probes
from hearthline.streaming import asof
from hearthline.streaming import health as st
from hearthline.streaming import run
from hearthline.streaming.asof import stream_asof


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture(scope="module")
def landed(spark, sf_dir):
    """The shared samples as five files that follow each other in time."""
    path = folder()
    probes = views.probes(spark, sf_dir).selectExpr(
        "sample_id", "service_id", "cast(ts AS timestamp) AS ts", "online", "latency_ms")
    n = probes.count()
    for i in range(5):
        part = probes.where((probes.sample_id >= i * n // 5) & (probes.sample_id < (i + 1) * n // 5))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def test_latest_status(spark, landed):
    stream = st.stream_latest(stream_probes(spark, landed, files_per_batch=1))
    got = run.newest_per_key(run.drain_updates(stream, "t-latest"), "service_id")
    assert spark_table(got) == spark_table(health.latest_status(read_probes(spark, landed)))


def test_container_health_counts_runs_across_batches(spark, landed):
    stream = st.stream_container_health(stream_probes(spark, landed, files_per_batch=1), "0 seconds")
    changes = run.drain_append(stream, "t-health")
    batch = health.unhealthy_runs(spark.read.parquet(landed))
    assert changes.where("state = 'unhealthy'").count() == batch.count()


START = datetime.datetime(2024, 1, 1)


def container_changes(spark, batches, delay="0 seconds", **options):
    """Changes as (service, second, state) from batches of (id, service, second, mark)."""
    path = folder()
    for rows in batches:
        rows = [(i, service, s and START + datetime.timedelta(seconds=s - 1), {"+": True, "-": False}.get(mark), 1.0) for i, service, s, mark in rows]
        spark.createDataFrame(rows, PROBE_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = st.stream_container_health(stream_probes(spark, path, files_per_batch=1), delay, **options)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    out = run.drain_append(stream, "t-marks").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return sorted((r["service_id"], int((r["ts"] - START).total_seconds()), r["state"]) for r in out)


def in_halves(marks):
    rows = [(i, 1, i + 1, m) for i, m in enumerate(marks)]
    return [rows[: len(rows) // 2], rows[len(rows) // 2:]]


def stepped(rows, grace=0, until=None):
    """The same from a plain loop over all samples of (id, service, second, mark)."""
    want, memory = [], {}
    for at, i, service, mark in sorted((s - 1, i, service, m) for i, service, s, m in rows):
        if until is not None and at > until:
            continue
        state, streak, started, first = memory.get(service, ("starting", 0, False, at))
        new = state
        if mark == "+":
            started, streak, new = True, 0, "healthy"
        elif started or at >= first + grace:
            streak += 1
            new = "unhealthy" if streak >= 3 else state
        if new != state:
            want.append((service, at, new))
        memory[service] = (new, streak, started, first)
    return sorted(want)


def test_container_states_by_hand(spark):
    assert container_changes(spark, in_halves("--+---+---")) == [
        (1, 2, "healthy"), (1, 5, "unhealthy"), (1, 6, "healthy"), (1, 9, "unhealthy")]


def test_failures_in_the_start_period_do_not_count(spark):
    assert container_changes(spark, in_halves("-----" + "--+---"), start_period_seconds=5) == [
        (1, 7, "healthy"), (1, 10, "unhealthy")]
    assert container_changes(spark, in_halves("+---------"), start_period_seconds=60) == [
        (1, 0, "healthy"), (1, 3, "unhealthy")]


@pytest.mark.parametrize("batches", [1, 5, 50])
def test_container_states_do_not_depend_on_batches(spark, batches):
    """Samples up to 19 seconds late and with equal times, in any split into batches."""
    rng = random.Random(11)
    rows = [(i, rng.randrange(3), rng.randrange(300) + 1, rng.choice("+---")) for i in range(600)]
    rows.append((600, 0, 321, "+"))
    split = [[] for _ in range(batches)]
    for row in rows:
        arrival = row[2] + (rng.randrange(20) if row[0] < 600 else 19)
        split[min(arrival * batches // 341, batches - 1)].append(row)
    got = container_changes(spark, [s for s in split if s], "20 seconds", start_period_seconds=7)
    assert got == stepped(rows, 7, until=300)


def test_container_samples_without_time_outcome_or_service(spark):
    rows = [(1, 1, 1, "+"), (2, 1, 2, None), (3, 1, 3, "-"), (4, 1, 4, "-"), (5, 1, None, "+")]
    assert container_changes(spark, [rows]) == [(1, 0, "healthy"), (1, 3, "unhealthy")]
    path = folder()
    mixed = [(i, service, START + datetime.timedelta(seconds=i), service is None, 1.0) for i in range(30) for service in (None, 1, 2)]
    spark.createDataFrame(mixed, PROBE_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    out = run.drain_append(st.stream_container_health(stream_probes(spark, path), "0 seconds"), "t-null").collect()
    assert sorted(((r["service_id"], r["state"]) for r in out), key=repr) == [(1, "unhealthy"), (2, "unhealthy"), (None, "healthy")]


def test_late_container_samples_are_dropped(spark):
    """A sample before the watermark of the batch before changes nothing; one after it is stepped in its place."""
    batches = [[(1, 1, 1, "+"), (2, 1, 50, "-")], [(4, 1, 45, "-")], [(3, 1, 20, "-"), (5, 1, 52, "-")], [(6, 1, 99, "+")]]
    assert container_changes(spark, batches, "10 seconds") == [(1, 0, "healthy"), (1, 51, "unhealthy")]


def test_late_rows_are_dropped(spark):
    path = folder()
    day = datetime.datetime(2024, 1, 1)
    hours = [[0, 1, 30], [50], [2, 55, 80]]
    for batch, part in enumerate(hours):
        rows = [(batch * 10 + i, 1, day + datetime.timedelta(hours=h), True, 1.0) for i, h in enumerate(part)]
        spark.createDataFrame(rows, PROBE_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = st.stream_health(stream_probes(spark, path, files_per_batch=1), "1 day", "1 hour")
    got = {r["window_start"].day: r["samples"] for r in run.drain_append(stream, "t-late").collect()}
    # Hour 30 closed the first day; a batch later its row at hour 2 is too late.
    assert got == {1: 2, 2: 1, 3: 2}


@pytest.mark.parametrize("early", ["false", "true"])
def test_residency_equals_batch_on_closed_spans(spark, landed, early):
    spark.conf.set(MERGE_SESSIONS, early)
    requests = "sample_id AS request_id", "service_id AS server_id", "'m' AS model", "ts"
    stream = st.stream_residency(stream_probes(spark, landed, 1).selectExpr(*requests), "1 hour", 3600)
    got = spark_table(run.drain_append(stream, "t-residency"))
    stored = spark.read.parquet(landed)
    mark = stored.selectExpr("max(ts) - INTERVAL 1 HOUR").first()[0]
    batch = models.model_residency(stored.selectExpr(*requests), 3600).drop("last_used")
    spark.conf.set(MERGE_SESSIONS, "true")
    assert got == spark_table(batch.where(batch.unloaded <= mark))


def test_repeated_samples_are_used_once(spark, landed):
    path = folder()
    stored = spark.read.parquet(landed)
    for _ in range(2):
        stored.coalesce(1).write.mode("append").parquet(path)
    stream = st.stream_dedup(stream_probes(spark, path), "1 hour")
    assert run.drain_append(stream, "t-dedup").count() == stored.count()


def test_a_stopped_stream_goes_on_where_it_was(spark, landed):
    """Two runs with one checkpoint see every row once."""
    source, base = folder(), folder()
    stored = spark.read.parquet(landed)

    def go():
        query = (
            stream_files(spark, source, PROBE_SCHEMA).writeStream.format("parquet")
            .option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start())
        query.awaitTermination()

    for part in ("sample_id % 2 = 0", "sample_id % 2 = 1"):
        stored.where(part).coalesce(1).write.mode("append").parquet(source)
        go()
    assert spark_table(spark.read.parquet(f"{base}/table")) == spark_table(stored)


def test_captured_lines_of_any_kind(spark):
    """Damaged and empty lines give no row, damaged answers one like any other; a limit in bytes only cuts batches."""
    path = folder()
    lines = ['{"sample_id":1,"service_id":7,"ts":"2024-01-01 00:00:00.123456","payload":"{\\"online\\":true,\\"latencyMs\\":5}"}',
             "", "broken {", "[1]", "{}", '{"sample_id":2,"payload":"<html>"}', '{"sample_id":3,"service_id":7,"payload":null,"more":[1]}']
    for line in lines:
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)
    fields = "sample_id bigint, service_id bigint, ts timestamp, payload string"
    for limit in ({"files_per_batch": 2}, {"bytes_per_batch": 100}, {}):
        got = run.drain_append(read_samples(stream_captures(spark, path, fields, **limit)), "t-captures").orderBy("sample_id").collect()
        assert [(r["sample_id"], r["service_id"], r["online"], r["latency_ms"]) for r in got] == [
            (1, 7, True, 5.0), (2, None, False, None), (3, 7, False, None)]
        assert got[0]["ts"] == datetime.datetime(2024, 1, 1, 0, 0, 0, 123456)


@pytest.mark.parametrize("batches", [1, 6])
def test_rows_meet_the_version_valid_at_their_time(spark, batches):
    """Rows and changes up to 9 seconds late, in any split into batches, against a plain loop."""
    rng = random.Random(batches)
    second = lambda s: START + datetime.timedelta(seconds=s, microseconds=s)
    rows = [(i, rng.choice([1, 2, 3, None]), rng.randrange(100)) for i in range(200)] + [(200, 1, 130)]
    changes = [(rng.choice([1, 2, None]), s, rng.choice(["a", "b", "é", None]), rng.choice([None, s])) for s in rng.sample(range(100), 40)] + [(9, 130, "z", 1)]
    paths = folder(), folder()
    kinds = "row_id int, id int, ts timestamp", "id int, ts timestamp, name string, size int"
    late = [[r[-1 if k == 0 else 1] + rng.randrange(10) for r in side] for k, side in enumerate((rows, changes))]
    for batch in range(batches):
        for path, kind, side, arrivals in zip(paths, kinds, (rows, changes), late, strict=True):
            part = [r for r, at in zip(side, arrivals, strict=True) if min(at * batches // 110, batches - 1) == batch]
            stamped = [(r[0], r[1], second(r[2])) if path == paths[0] else (r[0], second(r[1]), r[2], r[3]) for r in part]
            spark.createDataFrame(stamped, kind).coalesce(1).write.mode("append").parquet(path)
    streams = [stream_files(spark, p, k, files_per_batch=1) for p, k in zip(paths, kinds, strict=True)]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = run.drain_append(stream_asof(*streams, "id", ["name", "size"], "10 seconds"), "t-asof").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for row_id, key, s in rows[:-1]:
        known = max(((t, name, size) for k, t, name, size in changes if k == key and t <= s), key=lambda c: c[0], default=(0, None, None))
        gone = known[1] is None and known[2] is None
        want.append((row_id, key, second(s), None if gone else known[1], None if gone else known[2], 404 if gone else 200))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


class Kept:
    """State of one key, as a processor sees it."""

    def __init__(self):
        self.entries, self.timers = {}, []

    def state(self, name, schema):
        entries = self.entries.setdefault(name, [])
        return SimpleNamespace(
            exists=lambda: bool(entries), get=lambda: entries[0] if name in ("due", "known", "health") else iter(list(entries)),
            update=lambda value: entries.__setitem__(slice(None), [value]), put=lambda values: entries.__setitem__(slice(None), values),
            appendValue=entries.append, appendList=entries.extend, clear=entries.clear)

    getValueState = getListState = state

    def registerTimer(self, ms):
        self.timers.append(ms)


def fire(processor, kept, mark_ms):
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark_ms)
    return [part for ms in list(kept.timers) for part in processor.handleExpiredTimer(("k",), clock, SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms))]


def test_services_of_a_bucket_are_stepped_side_by_side():
    """A hundred services are one key of state, and give what a loop over each gives."""
    rng = random.Random(12)
    rows = [(i, rng.randrange(100), rng.randrange(400) + 1, rng.choice("+---")) for i in range(6000)]
    kept, processor = Kept(), st.ContainerHealth(3, 9)
    processor.init(kept)
    got = []
    for half in (rows[:3000], rows[3000:]):
        part = pd.DataFrame([(s, False, (at - 1) * 1_000_000, i, m == "+") for i, s, at, m in half], columns=["service", "missing", "ts_us", "sample_id", "online"])
        processor.handleInputRows(("k",), iter([part]), None)
    for mark in (200_000, 399_000):
        got += [(r.service, r.ts_us // 1_000_000, r.state) for out in fire(processor, kept, mark) for r in out.itertuples()]
    assert sorted(got) == stepped(rows, 9)
    assert not kept.entries["waiting"] and len(kept.entries["health"]) == 1


def test_waiting_rows_are_kept_in_runs():
    """A piece of a batch is one entry of state whatever rows it has; each row meets the version of its time."""
    kept, processor = Kept(), asof.AsOf()
    processor.init(kept)
    changes = [(100, "a"), (200, None), (300, "b"), (300, "c"), (900_000, "later")]
    rows = [(at, 0, body) for at, body in changes] + [(at, 1, str(at)) for at in range(50, 950, 50)] + [(800_000, 1, "waits")]
    processor.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=["at", "kind", "body"])]), None)
    assert len(kept.entries["waiting"]) == 1
    got = {int(r.body): r.version for out in fire(processor, kept, 1) for r in out.itertuples()}
    want = {at: "a" if 100 <= at < 200 else "c" if at >= 300 else None for at in range(50, 950, 50)}
    assert got == want and kept.entries["known"] == [("c",)] and len(kept.entries["changes"]) == 1
    late = [r for out in fire(processor, kept, 1000) for r in out.itertuples()]
    assert [(r.body, r.version) for r in late] == [("waits", "c")]
    assert not kept.entries["waiting"] and kept.entries["known"] == [("later",)]

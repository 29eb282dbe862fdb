"""Streams of probes, model requests and chat messages.

``ts`` must be a TIMESTAMP (an instant): watermarks do not take naive ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hearthline import fixed
from hearthline.functions.units import micros
from hearthline.operators.chat import clean
from hearthline.operators.health import hundredths
from hearthline.operators.registry import registry_lookup

# Tasks get the processor with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_latest(probes: DataFrame) -> DataFrame:
    """Newest sample per service; run in update mode."""
    newest = F.max(F.struct("ts", "sample_id", "online", "latency_ms"))
    return probes.groupBy("service_id").agg(newest.alias("s")).select("service_id", "s.*")


def stream_health(
    probes: DataFrame, size: str, delay: str, slide: str | None = None
) -> DataFrame:
    """Samples, uptime and mean latency per service and closed window."""
    window = F.window("ts", size, slide or size)
    return (
        probes.withWatermark("ts", delay)
        .groupBy(window.alias("w"), "service_id")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.count_if("online").alias("up"),
            F.count("latency_ms").alias("timed"),
            F.sum(hundredths(F.col("latency_ms"))).alias("sum"),
        )
        .select(
            "service_id",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "samples",
            (F.col("up") / F.col("samples")).alias("uptime"),
            (F.col("sum") / F.nullif("timed", F.lit(0)) / 100).alias("mean_ms"),
        )
    )


def stream_residency(
    requests: DataFrame, delay: str, idle_seconds: int = fixed.IDLE_SECONDS
) -> DataFrame:
    """Closed spans in which a server held a model."""
    return (
        requests.withWatermark("ts", delay)
        .groupBy("server_id", "model", F.session_window("ts", f"{idle_seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(
            "server_id", "model",
            F.col("w.start").alias("loaded"),
            F.col("w.end").alias("unloaded"),
            "requests",
        )
    )


def stream_dedup(probes: DataFrame, delay: str) -> DataFrame:
    """Use a repeated sample once; state older than ``delay`` is dropped."""
    return probes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sample_id"])


def stream_enrich(ids: DataFrame, registry: DataFrame, key: str = "id") -> DataFrame:
    """Registry row per streamed id, read anew each batch; unknown ids keep 404."""
    return registry_lookup(ids, registry, key)


def stream_clean(chat: DataFrame) -> DataFrame:
    """Clean assistant messages on arrival; a stateless projection."""
    return clean(chat)


class ContainerHealth(StatefulProcessor):
    """starting → healthy at the first success; unhealthy after ``retries`` failures
    in a row; failures within ``start_period`` and before any success do not count.

    Samples wait in state until the watermark has passed them, and only then are the
    state machines stepped, in the order of (ts, sample_id). So neither the order of
    arrival nor the borders of micro-batches change a state. A key is a bucket of
    services, stepped side by side, so calls to the state store are per bucket and not
    per service. Waiting samples are kept as they came, 26 bytes each, one run per piece
    of a batch; a bucket holds those of one delay and one batch at most.
    """

    OUTPUT = "service bigint, ts_us bigint, state string"
    MEMORY = "services binary"
    #: When the key is due: the time of its first waiting sample, in milliseconds.
    DUE = "ms bigint"
    WAITING = "run binary"
    SAMPLE = [("service", "<i8"), ("missing", "?"), ("ts", "<i8"), ("id", "<i8"), ("online", "?")]
    SERVICE = [("service", "<i8"), ("missing", "?"), ("state", "<i8"), ("streak", "<i8"), ("first", "<i8"), ("started", "?")]
    STATES = ("starting", "healthy", "unhealthy")

    def __init__(self, retries: int, start_period_seconds: int):
        self.retries = retries
        self.grace_us = start_period_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("health", self.MEMORY)
        self.due = handle.getValueState("due", self.DUE)
        self.waiting = handle.getListState("waiting", self.WAITING)

    def _wake(self, first_us: int) -> None:
        """Ask to be called once the watermark has reached a waiting sample."""
        ms = -(-first_us // 1000)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first_us = None
        for part in rows:
            if len(part):
                run = np.empty(len(part), self.SAMPLE)
                for name, column in (("service", "service"), ("missing", "missing"), ("ts", "ts_us"), ("id", "sample_id"), ("online", "online")):
                    run[name] = part[column].to_numpy()
                self.waiting.appendValue((run.tobytes(),))
                begin = int(run["ts"].min())
                first_us = begin if first_us is None else min(first_us, begin)
        if first_us is not None and (not self.due.exists() or first_us <= (self.due.get()[0] - 1) * 1000):
            self._wake(first_us)
        return iter(())

    def _step(self, samples: np.ndarray, memory: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        """The services after ``samples``, and the changes of state on the way."""
        p = samples[np.lexsort((samples["id"], samples["ts"], samples["service"], samples["missing"]))]
        online, ts, at = p["online"], p["ts"], np.arange(p.size)
        begins = np.append(True, (p["service"][1:] != p["service"][:-1]) | (p["missing"][1:] != p["missing"][:-1]))
        heads, group = np.flatnonzero(begins), np.cumsum(begins) - 1
        head = heads[group]
        known = {own: i for i, own in enumerate(zip(memory["missing"].tolist(), memory["service"].tolist(), strict=True))}
        place = np.array([known.get(own, -1) for own in zip(p["missing"][heads].tolist(), p["service"][heads].tolist(), strict=True)])
        old = place >= 0
        before = np.zeros(heads.size, self.SERVICE)
        before["first"] = ts[heads]
        before[old] = memory[place[old]]
        last_up = np.maximum.accumulate(np.where(online, at, -1))
        upped = last_up >= head
        started = upped | before["started"][group]
        counted = ~online & (started | (ts >= before["first"][group] + self.grace_us))
        failures = np.cumsum(counted)
        streak = failures - np.where(upped, failures[last_up], failures[head] - counted[head] - before["streak"][group])
        told = np.where(online, 1, np.where(counted & (streak >= self.retries), 2, -1))
        last_told = np.maximum.accumulate(np.where(told >= 0, at, -1))
        state = np.where(last_told >= head, told[last_told], before["state"][group])
        changed = state != np.where(begins, before["state"][group], np.roll(state, 1))
        ends = np.append(heads[1:], p.size) - 1
        after = before.copy()
        for name, values in (("service", p["service"]), ("missing", p["missing"]), ("state", state), ("streak", streak), ("started", started)):
            after[name] = values[ends]
        memory = memory.copy()
        memory[place[old]] = after[old]
        found = p[changed]
        changes = {
            "service": pd.arrays.IntegerArray(found["service"].copy(), found["missing"].copy()),
            "ts_us": found["ts"].copy(), "state": np.array(self.STATES, object)[state[changed]],
        }
        return np.concatenate([memory, after[~old]]), pd.DataFrame(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.due.exists() or expiredTimerInfo.getExpiryTimeInMs() != self.due.get()[0]:
            return  # an earlier sample has come since and woke the key before
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        runs = [np.frombuffer(bytes(r[0]), self.SAMPLE) for r in self.waiting.get()]
        passed = np.concatenate([run[run["ts"] <= mark] for run in runs])
        left = [run[run["ts"] > mark] for run in runs]
        left = [run for run in left if run.size]
        changes = None
        if passed.size:
            memory = np.frombuffer(bytes(self.memory.get()[0]) if self.memory.exists() else b"", self.SERVICE)
            memory, changes = self._step(passed, memory)
            self.memory.update((memory.tobytes(),))
        if left:
            self.waiting.put([(run.tobytes(),) for run in left])
            self._wake(min(int(run["ts"].min()) for run in left))
        else:
            self.waiting.clear()
            self.due.clear()
        if changes is not None and len(changes):
            yield changes

    def close(self) -> None:
        pass


#: Services are dealt to so many buckets; those of one are stepped together.
BUCKETS = 512


def stream_container_health(
    probes: DataFrame, delay: str, retries: int = fixed.RETRIES, start_period_seconds: int = 0
) -> DataFrame:
    """State changes per service up to the watermark, the newest time less ``delay``.

    Samples later than that are dropped, those without a time too; one without an
    outcome counts as failed. Run in append mode with RocksDB as state store.
    """
    return (
        probes.where(F.col("ts").isNotNull())
        .withWatermark("ts", delay)
        # State keeps no key apart that is null, so a missing service goes as a flag.
        .select(F.pmod(F.xxhash64(F.col("service_id").cast("bigint")), F.lit(BUCKETS)).cast("int").alias("bucket"),
                F.coalesce(F.col("service_id").cast("bigint"), F.lit(0)).alias("service"), F.col("service_id").isNull().alias("missing"),
                F.coalesce(F.col("sample_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("sample_id"), "ts",
                micros(F.col("ts")).alias("ts_us"), F.coalesce("online", F.lit(False)).alias("online"))
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=ContainerHealth(retries, start_period_seconds),
            outputStructType=ContainerHealth.OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
        .select(F.col("service").alias("service_id"), F.timestamp_micros("ts_us").alias("ts"), "state")
    )

"""Rows joined to what a registry said at their time, when both are streams.

Rows and changes of an id wait in state until the watermark has passed them and are then
taken by time, changes first where times are equal. A change replaces what is known of
its id; a row is emitted with what is known. So a row meets the version valid at its
time whatever batches the two came in, and only one version per id stays in state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hearthline.functions.units import micros

# Tasks get the processor with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CHANGE, _ROW = 0, 1
# No underscores in front: such names do not reach the processor. The id goes as JSON,
# as the state of a key that is null would be that of whichever key came before it.
_ID, _AT, _KIND, _BODY = "id", "at", "kind", "body"


def _packed(at: pa.Array, bodies: pa.Array) -> bytes:
    batch = pa.record_batch([at, bodies], names=[_AT, _BODY])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(run: bytes) -> list[pa.Array]:
    return pa.ipc.open_stream(bytes(run)).read_next_batch().columns


class AsOf(StatefulProcessor):
    """Waiting rows and changes of one id, and the version that is valid by now.

    Rows wait as Arrow runs, one per piece of a batch, and meet their versions run by
    run; only changes, which are few, are kept and sorted one by one.
    """

    OUTPUT = "body string, version string"
    KNOWN = "version string"
    DUE = "ms bigint"
    CHANGES = "at bigint, body string"
    WAITING = "run binary"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", self.KNOWN)
        self.due = handle.getValueState("due", self.DUE)
        self.changes = handle.getListState("changes", self.CHANGES)
        self.waiting = handle.getListState("waiting", self.WAITING)

    def _wake(self, first_us: int) -> None:
        ms = -(-first_us // 1000)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first_us = None
        for part in rows:
            if len(part):
                change = (part[_KIND] == _CHANGE).to_numpy()
                told = part[change]
                if len(told):
                    bodies = (None if pd.isna(b) else b for b in told[_BODY])
                    self.changes.appendList([(int(at), body) for at, body in zip(told[_AT], bodies, strict=True)])
                if not change.all():
                    rest = part[~change]
                    self.waiting.appendValue((_packed(pa.array(rest[_AT].to_numpy(np.int64)), pa.array(rest[_BODY], pa.string(), from_pandas=True)),))
                begin = int(part[_AT].min())
                first_us = begin if first_us is None else min(first_us, begin)
        if first_us is not None and (not self.due.exists() or -(-first_us // 1000) < self.due.get()[0]):
            self._wake(first_us)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.due.exists() or expiredTimerInfo.getExpiryTimeInMs() != self.due.get()[0]:
            return  # an earlier row has come since and woke the id before
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        version = self.known.get()[0] if self.known.exists() else None
        told = sorted((tuple(e) for e in self.changes.get()), key=lambda e: (e[0], e[1] or ""))
        passed = [e for e in told if e[0] <= mark]  # of one moment, the greatest text is the last
        runs = [_unpacked(r[0]) for r in self.waiting.get()]
        versions = pa.array([version, *(body for _, body in passed)], pa.string())
        since = np.array([at for at, _ in passed], np.int64)
        if versions[-1].as_py() is None:
            self.known.clear()
        else:
            self.known.update((versions[-1].as_py(),))
        first, left, ready = [e[0] for e in told[len(passed):]][:1], [], []
        for at, bodies in runs:
            times = at.to_numpy()
            due = times <= mark
            if due.any():
                ready.append((times[due], bodies.filter(pa.array(due))))
            if not due.all():
                left.append((_packed(at.filter(pa.array(~due)), bodies.filter(pa.array(~due))),))
                first.append(int(times[~due].min()))
        for state, entries in ((self.changes, told[len(passed):]), (self.waiting, left)):
            if entries:
                state.put(entries)
            else:
                state.clear()
        if first:
            self._wake(min(first))
        else:
            self.due.clear()
        for times, bodies in ready:
            valid = versions.take(pa.array(np.searchsorted(since, times, "right")))
            yield pd.DataFrame({"body": bodies.to_pandas(), "version": valid.to_pandas()})

    def close(self) -> None:
        pass


def _entries(df: DataFrame, key: str, delay: str, kind: int, body: Column) -> DataFrame:
    return df.where(F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        F.to_json(F.struct(key)).alias(_ID), "ts", micros(F.col("ts")).alias(_AT), F.lit(kind).alias(_KIND), body.alias(_BODY)
    )


def stream_asof(rows: DataFrame, changes: DataFrame, key: str, values: list[str], delay: str) -> DataFrame:
    """``rows`` with the ``values`` that ``changes`` gave for their id by their time, and
    status 200, or nulls and 404 before the first change and after a removal.

    Both have ``key`` and an instant ``ts``; a change in which all values are null removes
    its id. Rows come out once the watermarks of both streams have passed them; rows and
    changes later than that, and those without a time, are dropped.
    """
    removed = F.coalesce(*[F.col(v).cast("string") for v in values]).isNull()
    told = F.when(~removed, F.to_json(F.struct(*values)))
    both = _entries(rows, key, delay, _ROW, F.to_json(F.struct(*rows.columns), _EXACT)).unionByName(
        _entries(changes, key, delay, _CHANGE, told)
    )
    joined = both.groupBy(_ID).transformWithStateInPandas(
        statefulProcessor=AsOf(), outputStructType=AsOf.OUTPUT, outputMode="Append", timeMode="EventTime"
    )
    row_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    value_type = ", ".join(f"`{v}` {changes.schema[v].dataType.simpleString()}" for v in values)
    opened = joined.select(F.from_json("body", row_type, _EXACT).alias("r"), F.from_json("version", value_type).alias("v"), "version")
    return opened.select("r.*", *[F.col("v")[v].alias(v) for v in values], F.when(F.col("version").isNull(), 404).otherwise(200).alias("status"))


#: Times inside stored rows keep their microseconds.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

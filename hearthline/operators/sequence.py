"""Look-back windows and running counts over rows in order, also of a hot key.

A window partitioned by key puts all rows of one key in one task. Here keys are counted
first, by one job that reads nothing but the key columns. While every key fits into
``rows_per_chunk`` rows, a plain window is the plan: one shuffle and one sort.

The rows of keys above the limit are sorted across tasks instead, by key and by the
whole order, and stored so. A task holds ``ROWS_PER_TASK`` rows or one chunk, whichever
is more, and numbers its chunks by the places of its rows, so short chunks cost rows and
not tasks. Equal, missing and clustered times are spread like others, as the last column
of the order tells them apart. Chunks are joined up by a scan over what each passes on:

* a look-back of n rows gets the last n rows before each chunk as extra rows;
* a running count gets the sum over the earlier chunks as an offset.

What is passed on is a few rows per chunk. It is joined without a hint, so its measured
size decides how.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.session import cut_lineage

ROWS_PER_CHUNK = 8_000_000
#: Rows of hot keys that a task sorts, where chunks are shorter.
ROWS_PER_TASK = 200_000
_CHUNK, _EXTRA = "_chunk", "_extra"


def _same(names: list[str], prefix: str) -> Column:
    return reduce(lambda acc, k: acc & F.col(k).eqNullSafe(F.col(prefix + k)), names, F.lit(True))


def _renamed(names: list[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(prefix + k) for k in names]


@dataclass(frozen=True)
class Ordered:
    """Rows with their keys and order; ``split`` tells whether some keys are in chunks."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    split: bool

    @property
    def _part(self) -> list[str]:
        return [*self.keys, _CHUNK] if self.split else self.keys

    def done(self) -> DataFrame:
        return self.rows.drop(_CHUNK)

    def look_around(
        self, reach: int, columns: dict[str, Callable[[WindowSpec], Column]], ahead: bool = False
    ) -> Ordered:
        """Add window columns that look at most ``reach`` rows back.

        With ``ahead`` the order is turned round, so that ``F.lag`` reads the next row.
        """
        turn, back = (F.desc, F.asc) if ahead else (F.asc, F.desc)
        turned = [turn(c) for c in self.order]
        if not self.split:
            w = W.partitionBy(*self._part).orderBy(*turned)
            return replace(self, rows=self.rows.withColumns({name: make(w) for name, make in columns.items()}))
        # Extra rows come first, also where their order equals that of the chunk's own.
        w = W.partitionBy(*self._part).orderBy(F.desc(_EXTRA), *turned)
        added = {name: make(w) for name, make in columns.items()}
        from_end = W.partitionBy(*self._part).orderBy(*[back(c) for c in self.order])
        edges = (
            self.rows.where(F.col(_CHUNK).isNotNull())
            .withColumn("_rank", F.row_number().over(from_end))
            .where(F.col("_rank") <= reach)
            .drop("_rank")
        )
        # Every later chunk within reach gets the edge rows; all chunks hold rows of the key.
        later = F.collect_list(_CHUNK).over(
            W.partitionBy(*self.keys).orderBy(turn(_CHUNK)).rowsBetween(1, reach)
        )
        targets = edges.select(*self._part).distinct().withColumn("_later", later).select(
            *_renamed(self._part, "_k_"), F.explode("_later").alias("_to")
        )
        extra = (
            edges.join(targets, _same(self._part, "_k_"))
            .withColumn(_CHUNK, F.col("_to"))
            .select(*self.rows.columns)
        )
        both = self.rows.withColumn(_EXTRA, F.lit(False)).unionByName(extra.withColumn(_EXTRA, F.lit(True)))
        return replace(self, rows=both.withColumns(added).where(~F.col(_EXTRA)).drop(_EXTRA))

    def running_count(self, flag: Column, name: str, total: str | None = None) -> Ordered:
        """Add how many rows up to and with this one have ``flag``, per key in order,
        and as ``total`` how many of the key have it."""
        one = F.when(flag, 1).otherwise(0).cast("bigint")
        rows = self.rows.withColumn("_one", one)
        whole = W.partitionBy(*self._part)
        so_far = whole.orderBy(*self.order).rowsBetween(W.unboundedPreceding, 0)
        added = {name: F.sum("_one").over(so_far)} | ({total: F.sum("_one").over(whole)} if total else {})
        if not self.split:
            return replace(self, rows=rows.withColumns(added).drop("_one"))
        before = W.partitionBy(*self.keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
        offsets = (
            rows.where(F.col(_CHUNK).isNotNull())
            .groupBy(*self._part)
            .agg(F.sum("_one").alias("_sum"))
            .withColumns({"_offset": F.sum("_sum").over(before), "_all": F.sum("_sum").over(W.partitionBy(*self.keys))})
            .select(*_renamed(self._part, "_k_"), "_offset", "_all")
        )
        joined = rows.withColumns(added).join(offsets, _same(self._part, "_k_"), "left")
        whole_count = {name: F.col(name) + F.coalesce("_offset", F.lit(0))} | ({total: F.coalesce("_all", total)} if total else {})
        return replace(self, rows=joined.withColumns(whole_count).select(*self.rows.columns, *added))


def in_order(
    df: DataFrame, keys: list[str], order: list[str], rows_per_chunk: int = ROWS_PER_CHUNK
) -> Ordered:
    """``df`` by keys in a total order; rows of a key above ``rows_per_chunk`` get chunk
    numbers that rise along the order, missing values first, as in windows."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_chunk)
    if counted.isEmpty():
        return Ordered(df, keys, order, False)
    hot = cut_lineage(counted.select(*_renamed(keys, "_k_"), "_n"), "hot-keys")
    total = hot.agg(F.sum("_n")).first()[0]
    # Twice the tasks that would do: bounds come from a sample.
    tasks = 2 * -(-total // max(rows_per_chunk, ROWS_PER_TASK))
    ranged = df.join(hot, _same(keys, "_k_"), "left_semi").repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order)
    # Task number and place within the task, in one number; cut to the first place of the chunk.
    at = ranged.withColumn(_CHUNK, F.monotonically_increasing_id())
    place = F.col(_CHUNK).bitwiseAND((1 << 33) - 1)
    placed = cut_lineage(at.withColumn(_CHUNK, F.col(_CHUNK) - place % max(rows_per_chunk // 2, 1)), "chunks")
    rest = df.join(hot, _same(keys, "_k_"), "left_anti").withColumn(_CHUNK, F.lit(None).cast("bigint"))
    return Ordered(rest.unionByName(placed), keys, order, True)

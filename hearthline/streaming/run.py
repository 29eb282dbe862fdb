"""Running a stream over what has landed so far, into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.session import fresh_dir


def drain_append(stream: DataFrame, label: str, base: str | None = None) -> DataFrame:
    """Process all landed input, append to a table, return it.

    The table is a fresh one, or that below ``base``, where an earlier run of the same
    stream left off.
    """
    spark = stream.sparkSession
    base = base or fresh_dir(spark, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{base}/table")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def drain_batches(
    stream: DataFrame, label: str, write: Callable[[DataFrame, int], None], mode: str = "update"
) -> None:
    """Process all landed input batch by batch through a re-runnable writer."""
    base = fresh_dir(stream.sparkSession, label)
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain_updates(stream: DataFrame, label: str) -> DataFrame:
    """All rows emitted in update mode, with the batch that emitted them.

    Each batch overwrites its own folder, so a replayed batch changes nothing.
    """
    spark = stream.sparkSession
    table = fresh_dir(spark, label + "-table")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    drain_batches(stream, label, write)
    schema = T.StructType([*stream.schema, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(table)


def newest_per_key(updates: DataFrame, key: str) -> DataFrame:
    """The last emitted row per key."""
    rest = [c for c in updates.columns if c not in (key, "batch")]
    last = F.max_by(F.struct(*rest), "batch")
    return updates.groupBy(key).agg(last.alias("r")).select(key, "r.*")

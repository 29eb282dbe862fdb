"""Health samples as a table or a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE_SCHEMA = (
    "sample_id bigint, service_id bigint, ts timestamp, online boolean, latency_ms double"
)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Landed samples; the schema is fixed, so no file is read to infer it."""
    return spark.read.schema(PROBE_SCHEMA).parquet(path)


def read_samples(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Captured health answers: ``{"online": …, "latencyMs": …}``.

    An answer without ``online``, such as the error for an unknown service, counts
    as offline and has no latency.
    """
    keep = [c for c in payloads.columns if c != column]
    sample = F.from_json(F.col(column), "online boolean, latencyMs double")
    return payloads.select(*keep, sample.alias("s")).select(
        *keep,
        F.coalesce("s.online", F.lit(False)).alias("online"),
        F.col("s.latencyMs").alias("latency_ms"),
    )


def stream_probes(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same as a stream of newly landed files."""
    return stream_files(spark, path, PROBE_SCHEMA, files_per_batch)


def stream_files(
    spark: SparkSession,
    path: str,
    schema,
    files_per_batch: int | None = None,
    bytes_per_batch: int | None = None,
) -> DataFrame:
    """Newly landed files; either limit bounds what one micro-batch holds."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)

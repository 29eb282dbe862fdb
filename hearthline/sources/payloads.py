"""JSON payloads captured from search and model servers.

A payload is one server answer, so its arrays are bounded by the server and are
opened inside the row: none of these readers shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEARCH_SCHEMA = (
    "results array<struct<title string, content string, url string, engine string,"
    " publishedDate string, length string>>"
)
CATALOG_SCHEMA = (
    "models array<struct<name string, model string, modified_at string, size bigint,"
    " digest string, details struct<format string, family string, families array<string>,"
    " parameter_size string, quantization_level string>>>"
)
SERVED_SCHEMA = "object string, data array<struct<id string, object string, created bigint>>"
LOADED_SCHEMA = "models array<struct<name string, size_vram bigint>>"


def read_captures(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Landed answers as (source, payload): one per file, or one per line."""
    raw = spark.read.text(path, wholetext=not per_line)
    return raw.select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("payload")
    )


def stream_captures(
    spark: SparkSession,
    path: str,
    fields: str,
    files_per_batch: int | None = None,
    bytes_per_batch: int | None = None,
) -> DataFrame:
    """Captured answers and reports as they land: JSON lines with ``fields``, of which
    one holds the answer as it came.

    A file source keeps its own offsets, splits files over tasks and goes on after a
    restart where it was; either limit is the rate. The readers of this package turn the
    answers into rows, in a stream as in a table. A line that is no JSON object, or has
    none of the fields, gives no row. Files must be moved into ``path`` whole.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    opened = reader.text(path).select(F.from_json("value", fields).alias("c")).select("c.*")
    return opened.dropna("all")


def search_array(payload: Column) -> Column:
    """The results of one answer in received order; null where there are none."""
    return F.from_json(payload, SEARCH_SCHEMA)["results"]


def is_damaged(payload: Column) -> Column:
    """No answer at all, or one that is no JSON object."""
    parsed = F.from_json(payload, SEARCH_SCHEMA + ", _corrupt_record string")
    return payload.isNull() | parsed["_corrupt_record"].isNotNull()


def _others(df: DataFrame, column: str) -> list[str]:
    return [c for c in df.columns if c != column]


def read_search_results(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per result with its position from 1; no ``results`` gives no rows."""
    keep = _others(payloads, column)
    opened = payloads.select(*keep, F.posexplode(search_array(F.col(column))).alias("at", "r"))
    return opened.select(
        *keep,
        (F.col("at") + 1).alias("pos"),
        "r.title", "r.content", "r.url", "r.engine",
        F.col("r.publishedDate").alias("published"),
        "r.length",
    )


def damaged_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The payloads that are no JSON object, so that they can be counted."""
    return payloads.where(is_damaged(F.col(column)))


def read_model_catalog(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Local-model catalog as flat rows; a bad payload gives no rows."""
    models = F.from_json(F.col(column), CATALOG_SCHEMA)["models"]
    keep = _others(payloads, column)
    return payloads.select(*keep, F.explode(models).alias("m")).select(
        *keep,
        "m.name", "m.model", "m.modified_at", "m.size", "m.digest",
        "m.details.format", "m.details.family", "m.details.families",
        "m.details.parameter_size", "m.details.quantization_level",
    )


def read_served_catalog(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Served-model catalog as flat rows."""
    data = F.from_json(F.col(column), SERVED_SCHEMA)["data"]
    keep = _others(payloads, column)
    return payloads.select(*keep, F.inline(data))


def read_loaded_models(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Models in memory; a missing size counts as 0."""
    models = F.from_json(F.col(column), LOADED_SCHEMA)["models"]
    keep = _others(payloads, column)
    return payloads.select(*keep, F.explode(models).alias("m")).select(
        *keep, "m.name", F.coalesce("m.size_vram", F.lit(0)).alias("size_vram")
    )

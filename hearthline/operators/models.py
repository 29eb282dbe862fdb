"""Model catalogs, memory and residency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import fixed
from hearthline.functions.text import short_model_name
from hearthline.functions.units import binary_gib, format_bytes, micros
from hearthline.operators import sequence
from hearthline.sources.reports import counter_entries

ORDER = ["ts", "request_id"]


def model_rows(catalog: DataFrame) -> DataFrame:
    return catalog.select("server", "name", format_bytes(F.col("size")).alias("shown_size"))


def model_count(servers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog length per server, 0 where it lists nothing."""
    counts = catalog.groupBy("server").agg(F.count(F.lit(1)).alias("n"))
    return servers.join(counts, "server", "left").select(
        *servers.columns, F.coalesce("n", F.lit(0)).alias("models")
    )


def model_cube(catalog: DataFrame) -> DataFrame:
    """Models and bytes by family and quantisation, with all margins."""
    return catalog.cube("family", "quantization_level").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("models"),
        F.sum("size").alias("bytes"),
    )


def unified_catalog(local: DataFrame, served: DataFrame) -> DataFrame:
    """Both catalogs in one list, tagged by backend; duplicates stay."""
    first = local.select("server", "name", "size").withColumn("backend", F.lit("local"))
    second = served.select(
        "server", short_model_name(F.col("id")).alias("name"), "created"
    ).withColumn("backend", F.lit("served"))
    return first.unionByName(second, allowMissingColumns=True)


def memory_summary(counters: DataFrame, totals: DataFrame, report: str = "report_id") -> DataFrame:
    """Used, free and total memory per report, in GiB; a missing counter is 0.

    ``counters`` has (report, key, value), ``totals`` has (report, total_bytes).
    """
    pages = F.sum(F.when(F.col("key").isin(*fixed.USED_COUNTERS), F.col("value")))
    used = counters.groupBy(report).agg(F.coalesce(pages, F.lit(0)).alias("pages"))
    return totals.join(used, report, "left").select(report, *_memory(F.col("pages"), F.col("total_bytes")))


def _memory(pages: Column, total_bytes: Column) -> list[Column]:
    used_bytes = F.coalesce(pages, F.lit(0)) * fixed.PAGE_BYTES
    return [
        binary_gib(total_bytes, 0).alias("total_gib"),
        binary_gib(used_bytes).alias("used_gib"),
        binary_gib(total_bytes - used_bytes).alias("free_gib"),
    ]


def memory_of_reports(
    reports: DataFrame, report: str = "report_id", column: str = "report", total: str = "total_bytes"
) -> DataFrame:
    """The same from the reports themselves, one row each, with the total beside the
    text; all within the row, so nothing shuffles."""
    used = F.filter(counter_entries(F.col(column)), lambda e: e["key"].isin(*fixed.USED_COUNTERS))
    pages = F.aggregate(used, F.lit(0).cast("bigint"), lambda sum_, e: sum_ + e["value"].cast("bigint"))
    return reports.select(report, total, pages.alias("pages")).select(report, *_memory(F.col("pages"), F.col(total)))


def model_swaps(requests: DataFrame, rows_per_chunk: int = sequence.ROWS_PER_CHUNK) -> DataFrame:
    """Requests that make a server load another model than it holds."""
    keys = ["server_id"]
    rows = sequence.in_order(
        requests.select("request_id", "server_id", "model", "ts"), keys, ORDER, rows_per_chunk
    )
    before = rows.look_around(1, {"previous_model": lambda w: F.lag("model").over(w)})
    return before.done().where(F.col("model") != F.col("previous_model"))


def model_residency(
    requests: DataFrame,
    idle_seconds: int = fixed.IDLE_SECONDS,
    pinned: tuple[str, ...] = (),
    rows_per_chunk: int = sequence.ROWS_PER_CHUNK,
) -> DataFrame:
    """Spans in which a server holds a model: loaded at the first request,
    unloaded after ``idle_seconds`` without one; a pinned model is never unloaded.

    A gap equal to the idle time starts a new span, as ``session_window`` does.
    """
    keys = ["server_id", "model"]
    rows = sequence.in_order(
        requests.select("request_id", "server_id", "model", "ts"), keys, ORDER, rows_per_chunk
    )
    before = rows.look_around(1, {"prev_ts": lambda w: F.lag("ts").over(w)})
    gap = micros(F.col("ts")) - micros(F.col("prev_ts"))
    loads = F.col("prev_ts").isNull() | (
        (gap >= idle_seconds * 1_000_000) & ~F.col("model").isin(*pinned)
    )
    numbered = before.running_count(loads, "span").done()
    stays: Column = F.col("model").isin(*pinned)
    last = F.max("ts")
    return (
        numbered.groupBy(*keys, "span")
        .agg(F.min("ts").alias("loaded"), last.alias("last_used"),
             F.count(F.lit(1)).alias("requests"))
        .withColumn(
            "unloaded",
            F.when(~stays, F.col("last_used") + F.make_dt_interval(secs=F.lit(idle_seconds))),
        )
        .drop("span")
    )

"""Catalogs, text reports, memory and model residency."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import models as m
from hearthline.plans import views as v
from hearthline.plans.views import C, check
from hearthline.sources import payloads, reports

# Requests are sparse in the shared table, so one hour stands for the idle time.
IDLE = 3600
PINNED = "purchase"


def model_catalog_scan(spark, sf_dir):
    rows = payloads.read_model_catalog(v.catalog_payloads(spark, sf_dir))
    return rows.withColumn("families", F.array_join("families", ","))


def served_catalog_scan(spark, sf_dir):
    return payloads.read_served_catalog(v.served_payloads(spark, sf_dir))


def loaded_models_scan(spark, sf_dir):
    return payloads.read_loaded_models(v.loaded_payloads(spark, sf_dir))


def model_projection(spark, sf_dir):
    return m.model_rows(v.catalog(spark, sf_dir))


def model_count(spark, sf_dir):
    servers = v.table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("server"))
    return m.model_count(servers, v.catalog(spark, sf_dir))


def model_family_cube(spark, sf_dir):
    return m.model_cube(v.catalog(spark, sf_dir))


def unified_catalog(spark, sf_dir):
    return m.unified_catalog(v.catalog(spark, sf_dir), v.served(spark, sf_dir))


def model_swaps(spark, sf_dir):
    return m.model_swaps(v.requests(spark, sf_dir))


def model_swaps_hot(spark, sf_dir):
    return m.model_swaps(v.requests_hot(spark, sf_dir), rows_per_chunk=v.HOT_CHUNK)


def model_residency(spark, sf_dir):
    return m.model_residency(v.requests(spark, sf_dir), IDLE)


def model_residency_hot(spark, sf_dir):
    return m.model_residency(v.requests_hot(spark, sf_dir), IDLE, rows_per_chunk=v.HOT_CHUNK // 5)


def model_residency_pinned(spark, sf_dir):
    return m.model_residency(v.requests(spark, sf_dir), IDLE, pinned=(PINNED,))


def kv_config_scan(spark, sf_dir):
    return reports.read_kv(v.kv_lines(spark, sf_dir), "API_KEY")


def counter_report_scan(spark, sf_dir):
    return reports.read_counters(v.counter_reports(spark, sf_dir))


def column_report_scan(spark, sf_dir):
    return reports.read_columns(v.column_reports(spark, sf_dir))


def skip_header(spark, sf_dir):
    return reports.skip_header(v.column_reports(spark, sf_dir))


def memory_summary(spark, sf_dir):
    total = (C("report_id") % 9 + 8) * F.lit(1024**3)
    return m.memory_of_reports(v.counter_reports(spark, sf_dir).withColumn("total_bytes", total))


_NAME = "concat(replace(p_name, ' ', '-'), ':', p_partkey, '.', i)"
_SHOWN = ("CASE WHEN n % 10 = 0 THEN cast(n // 10 AS VARCHAR) ELSE cast(n // 10 AS VARCHAR) || '.' ||"
          " cast(n % 10 AS VARCHAR) END || ' ' || unit")


def _per_server(most: int, columns: str) -> str:
    return (
        f"SELECT p_partkey AS server, {columns} FROM (SELECT *, unnest(generate_series(1, p_partkey % {most}))"
        " AS i FROM part) WHERE p_partkey % 17 <> 3"
    )


def _residency(gap_rule: str, unloaded: str) -> str:
    return (
        ", marked AS (SELECT *, CASE WHEN prev IS NULL OR (" + gap_rule + ") THEN 1 ELSE 0 END AS loads FROM"
        " (SELECT *, lag(ts) OVER (PARTITION BY server_id, model ORDER BY ts, request_id) AS prev FROM requests)),"
        " spans AS (SELECT *, sum(loads) OVER (PARTITION BY server_id, model ORDER BY ts, request_id) AS span"
        " FROM marked)"
        " SELECT server_id, model, min(ts) AS loaded, max(ts) AS last_used, count(*) AS requests,"
        f" {unloaded} AS unloaded FROM spans GROUP BY server_id, model, span")


_GAP = f"ts - prev >= INTERVAL {IDLE} SECOND"
_END = f"max(ts) + INTERVAL {IDLE} SECOND"

RESIDENCY_SQL = _residency(_GAP, _END)
SWAPS_SQL = (
        "SELECT * FROM (SELECT request_id, server_id, model, ts, lag(model) OVER"
        " (PARTITION BY server_id ORDER BY ts, request_id) AS previous_model FROM requests)"
        " WHERE model <> previous_model"
)

QUERIES = {
    "model_catalog_scan": (model_catalog_scan, _per_server(
        5, f"{_NAME} AS name, {_NAME} AS model, '2024-01-31T00:00:00Z' AS modified_at,"
        " cast(floor(p_retailprice * 1000000 * (i - 1)) AS BIGINT) AS size, 'd' || p_partkey AS digest,"
        " 'gguf' AS format, p_brand AS family, p_brand || ',' || p_type AS families,"
        " p_size || 'B' AS parameter_size, p_type AS quantization_level")),
    "served_catalog_scan": (served_catalog_scan, _per_server(
        4, f"'mlx-community/' || {_NAME} AS id, 'model' AS object, 1700000000 + p_partkey + i AS created")),
    "loaded_models_scan": (loaded_models_scan, _per_server(
        4, f"{_NAME} AS name, CASE WHEN (p_partkey + i) % 3 <> 0 THEN"
        " cast(floor(p_retailprice * 1000000 * i) AS BIGINT) ELSE 0 END AS size_vram")),
    "model_projection": (model_projection, check(
        ", scaled AS (SELECT *, CASE WHEN size >= 1099511627776 THEN 1099511627776 WHEN size >= 1073741824"
        " THEN 1073741824 WHEN size >= 1048576 THEN 1048576 WHEN size >= 1024 THEN 1024 ELSE 1 END AS step"
        " FROM catalog), parts AS (SELECT server, name, CASE step WHEN 1 THEN 'B' WHEN 1024 THEN 'KB'"
        " WHEN 1048576 THEN 'MB' WHEN 1073741824 THEN 'GB' ELSE 'TB' END AS unit,"
        " (cast(size AS HUGEINT) * 20 + step) // (2 * step) AS n FROM scaled)"
        f" SELECT server, name, {_SHOWN} AS shown_size FROM parts", "catalog")),
    "model_count": (model_count, check(
        "SELECT s_suppkey AS server, count(name) AS models FROM supplier LEFT JOIN catalog"
        " ON s_suppkey = server GROUP BY 1", "catalog")),
    "model_family_cube": (model_family_cube, check(
        "SELECT family, quantization_level, grouping(family, quantization_level) AS level, count(*) AS models,"
        " cast(sum(size) AS BIGINT) AS bytes FROM catalog GROUP BY CUBE (family, quantization_level)",
        "catalog")),
    "unified_catalog": (unified_catalog, check(
        "SELECT server, name, size, 'local' AS backend, NULL AS created FROM catalog UNION ALL"
        " SELECT server, regexp_replace(id, 'mlx-community/', ''), NULL, 'served', created FROM served",
        "catalog", "served")),
    "model_swaps": (model_swaps, check(SWAPS_SQL, "requests")),
    "model_swaps_hot": (model_swaps_hot, check(v.on_hot(SWAPS_SQL, "requests"), "requests_hot")),
    "model_residency": (model_residency, check(RESIDENCY_SQL, "requests")),
    "model_residency_hot": (model_residency_hot, check(v.on_hot(RESIDENCY_SQL, "requests"), "requests_hot")),
    "model_residency_pinned": (model_residency_pinned, check(_residency(
        f"model <> '{PINNED}' AND {_GAP}", f"CASE WHEN model <> '{PINNED}' THEN {_END} END"), "requests")),
    "kv_config_scan": (kv_config_scan, check(
        "SELECT line_no, 'API_KEY' AS key, substring(line, 9) AS value FROM kv_lines"
        " WHERE starts_with(line, 'API_KEY=')", "kv_lines")),
    "counter_report_scan": (counter_report_scan, check("SELECT * FROM counters", "counters")),
    "column_report_scan": (column_report_scan,
        "SELECT p_partkey AS report_id, cast(i + 1 AS INTEGER) AS line_no, replace(p_name, ' ', '-') || ':' || i AS name,"
        " p_size || ' GB' AS size FROM (SELECT *, unnest(generate_series(1, p_partkey % 4 + 1)) AS i FROM part)"),
    "skip_header": (skip_header,
        "SELECT p_partkey AS report_id, cast(i + 1 AS INTEGER) AS line_no, replace(p_name, ' ', '-') || ':' || i || '   id' ||"
        " p_partkey || '   ' || p_size || ' GB   2 weeks ago' AS line"
        " FROM (SELECT *, unnest(generate_series(1, p_partkey % 4 + 1)) AS i FROM part)"),
    "memory_summary": (memory_summary, check(
        ", used AS (SELECT report_id, cast(sum(value) AS HUGEINT) * 16384 AS used FROM counters GROUP BY 1),"
        " whole AS (SELECT event_id AS report_id, cast(event_id % 9 + 8 AS HUGEINT) * 1073741824 AS total"
        " FROM events)"
        " SELECT report_id, cast(total // 1073741824 AS DOUBLE) AS total_gib,"
        " cast((used * 20 + 1073741824) // 2147483648 AS DOUBLE) / 10 AS used_gib,"
        " cast(((total - used) * 20 + 1073741824) // 2147483648 AS DOUBLE) / 10 AS free_gib"
        " FROM whole JOIN used USING (report_id)", "counters")),
}

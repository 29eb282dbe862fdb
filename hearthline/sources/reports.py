"""Plain-text reports: key/value files, counter reports, column reports.

A report is one captured command output, a few dozen lines held in one row. Its
lines are opened, ordered and resolved inside that row, so nothing shuffles
however many reports there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions import text


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Each file below ``path`` as one report."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.col("_metadata.file_path").alias("report_id"), F.col("value").alias("report")
    )


def lines_of(report: Column) -> Column:
    return F.split(report, "\n")


def without_header(report: Column) -> Column:
    return F.filter(lines_of(report), lambda line, at: at > 0)


def skip_header(reports: DataFrame, column: str = "report") -> DataFrame:
    """The lines of each report but the first, numbered as in the report."""
    keep = [c for c in reports.columns if c != column]
    opened = reports.select(
        *keep, F.posexplode(without_header(F.col(column))).alias("at", "line")
    )
    return opened.select(*keep, (F.col("at") + 2).alias("line_no"), "line")


def read_kv(lines: DataFrame, key: str | None = None, column: str = "line") -> DataFrame:
    """``KEY=value`` lines; with ``key`` only lines that begin with exactly it."""
    line = F.col(column)
    if key is None:
        rows = lines.where(line.contains("="))
    else:
        rows = lines.where(line.startswith(key + "="))
    keep = [c for c in lines.columns if c != column]
    return rows.select(*keep, text.kv_key(line).alias("key"), text.kv_value(line).alias("value"))


def counter_entries(report: Column) -> Column:
    """``key: 123.`` lines of one report as (key, value), last value per key."""

    def entry(line: Column) -> Column:
        parts = F.split(line, ":")
        number = F.rtrim(text.strip_ws(F.get(parts, F.lit(1))), F.lit("."))
        return F.struct(
            text.strip_ws(F.get(parts, F.lit(0))).alias("key"),
            text.try_int(number).alias("value"),
            F.size(parts).alias("parts"),
        )

    entries = F.filter(
        F.transform(without_header(F.regexp_replace(report, r"^\s+|\s+$", "")), entry),
        lambda e: (e["parts"] == 2) & e["value"].isNotNull(),
    )

    def last_per_key(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda e: e["key"]))
        last = lambda k: F.element_at(F.filter(found, lambda e: e["key"] == k), -1)
        return F.transform(
            keys, lambda k: F.struct(k.alias("key"), last(k)["value"].alias("value"))
        )

    # Bound as a lambda variable, the entries are parsed once and not once per key.
    return F.get(F.transform(F.array(entries), last_per_key), F.lit(0))


def read_counters(reports: DataFrame, column: str = "report") -> DataFrame:
    """One row per report and key."""
    keep = [c for c in reports.columns if c != column]
    return reports.select(*keep, F.inline(counter_entries(F.col(column))))


def read_columns(reports: DataFrame, column: str = "report") -> DataFrame:
    """Whitespace columns: field 1 as name, fields 3 and 4 as size; header dropped."""
    lines = skip_header(reports, column)
    keep = [c for c in lines.columns if c != "line"]
    parts = F.split(F.trim("line"), r"\s+")
    field = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return lines.select(
        *keep, field(0).alias("name"), F.concat(field(2), F.lit(" "), field(3)).alias("size")
    )

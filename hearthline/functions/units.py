"""Byte, time and latency functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline import fixed


def format_bytes(c: Column, decimals: int = 1) -> Column:
    """Bytes as ``1.5 KB``; trailing zeros dropped, TB is the largest unit.

    Negative and null give null.
    """
    size = c.cast("bigint")

    def shown(power: int) -> Column:
        exact = size.cast("decimal(20,0)") / F.lit(fixed.BYTE_STEP**power).cast("decimal(14,0)")
        text = F.round(exact, decimals).cast(f"decimal(20,{decimals})").cast("string")
        if decimals:
            text = F.regexp_replace(text, r"\.?0+$", "")
        return F.concat(text, F.lit(" " + fixed.BYTE_UNITS[power]))

    top = len(fixed.BYTE_UNITS) - 1
    scaled = reduce(
        lambda acc, power: acc.when(size >= F.lit(fixed.BYTE_STEP**power), shown(power)),
        range(top - 1, 0, -1),
        F.when(size >= F.lit(fixed.BYTE_STEP**top), shown(top)),
    )
    return scaled.when(size >= 0, F.concat(size.cast("string"), F.lit(" B")))


def decimal_gb(c: Column) -> Column:
    """Bytes over 10^9 to one place, ties away from zero, as ``2.0GB``."""
    gb = F.round(c.cast("decimal(20,0)") / F.lit(10**9).cast("decimal(10,0)"), 1)
    return F.concat(gb.cast("decimal(20,1)").cast("string"), F.lit("GB"))


def binary_gib(c: Column, decimals: int = 1) -> Column:
    """Bytes over 1024^3, rounded."""
    gib = c.cast("decimal(20,0)") / F.lit(1024**3).cast("decimal(10,0)")
    return F.round(gib, decimals).cast("double")


def latency_band(ms: Column) -> Column:
    """``go`` below 100 ms, ``warn`` below 300 ms, else ``stop``; null stays null."""
    (fast, fast_name), (fair, fair_name) = fixed.LATENCY_BANDS
    return (
        F.when(ms < fast, fast_name)
        .when(ms < fair, fair_name)
        .when(ms.isNotNull(), fixed.SLOW_BAND)
    )


def clock_time(epoch_ms: Column) -> Column:
    """Epoch milliseconds as ``HH:mm:ss`` in the session zone; 0 and null give a dash."""
    shown = F.date_format(F.timestamp_millis(epoch_ms), "HH:mm:ss")
    return F.when(F.coalesce(epoch_ms, F.lit(0)) == 0, "—").otherwise(shown)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; takes naive timestamps too."""
    return F.unix_micros(ts.cast("timestamp"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two instants, each cut to its millisecond."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))

"""String functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hearthline import fixed


def strip_ws(c: Column) -> Column:
    """Cut outer whitespace of every Unicode kind (``F.trim`` takes only spaces)."""
    return F.btrim(c, F.lit(fixed.SPACES))


def strip_thinking(c: Column) -> Column:
    """Drop closed reasoning blocks, then outer whitespace."""
    return strip_ws(F.regexp_replace(c, fixed.THINKING, ""))


def truthy(c: Column) -> Column:
    """True for text that is neither null nor empty."""
    return F.nullif(c, F.lit("")).isNotNull()


def join_nonempty(*parts: Column) -> Column:
    """Join the non-empty parts; concat_ws skips nulls."""
    return F.concat_ws(fixed.SEPARATOR, *[F.nullif(p, F.lit("")) for p in parts])


def with_default(c: Column, default: str) -> Column:
    """A missing field gets its default; an empty string stays."""
    return F.coalesce(c, F.lit(default))


def kv_key(line: Column) -> Column:
    return F.substring_index(line, "=", 1)


def kv_value(line: Column) -> Column:
    """Everything after the first ``=``, further ``=`` included."""
    return F.regexp_extract(line, "(?s)^[^=]*=(.*)$", 1)


def try_int(c: Column) -> Column:
    """Whole number or null; ``12.5`` and ``n/a`` are null."""
    # A failing try_cast costs an exception per row, so only digits get to it.
    return F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), c.try_cast("bigint"))


def json_field(c: Column, path: str, dtype: str = "string") -> Column:
    return F.get_json_object(c, path).try_cast(dtype)


def is_json(c: Column) -> Column:
    """The whole text is one JSON value.

    One parser forgives trailing text and the other forgives extra members, so
    a text passes only where both wrapped forms parse.
    """
    wrapped = F.from_json(
        F.concat(F.lit('{"v":'), c, F.lit("}")), "v string, _corrupt_record string"
    )
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.coalesce(
        c.isNotNull() & wrapped["_corrupt_record"].isNull() & listed.isNotNull(), F.lit(False)
    )


def short_model_name(c: Column) -> Column:
    """Remove the first model-hub prefix, wherever it stands."""
    at = F.instr(c, fixed.MODEL_PREFIX)
    cut = F.concat(
        F.substring(c, F.lit(1), at - 1),
        F.substring(c, at + len(fixed.MODEL_PREFIX), F.length(c)),
    )
    return F.when(at > 0, cut).otherwise(c)


def short_model_name_all(c: Column) -> Column:
    """Remove every model-hub prefix."""
    return F.replace(c, F.lit(fixed.MODEL_PREFIX), F.lit(""))


def pad_right(c: Column, width: int) -> Column:
    """Left-aligned column that never cuts a longer text."""
    return F.rpad(c, F.greatest(F.lit(width), F.length(c)), F.lit(" "))


def endpoint_url(base: Column, path: str) -> Column:
    return F.concat(base, F.lit(path))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/?#]+)", 1)


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)


def html_language(html: Column) -> Column:
    return F.regexp_extract(html, '<html lang="([a-z]+)"', 1)


def tokens(c: Column) -> Column:
    """Distinct lower-case a-z words of four letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))


def register_sql(spark: SparkSession) -> None:
    """Make the chat functions callable from SQL, still as Catalyst expressions."""

    def sql_text(pattern: str) -> str:
        return pattern.replace("\\", "\\\\")

    spaces = "".join(f"\\u{ord(char):04x}" for char in fixed.SPACES)
    cleaned = f"regexp_replace(c, '{sql_text(fixed.THINKING)}', '')"
    for name, body in (
        ("strip_ws", f"btrim(c, '{spaces}')"),
        ("strip_thinking", f"btrim({cleaned}, '{spaces}')"),
    ):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(c STRING) RETURNS STRING RETURN {body}"
        )

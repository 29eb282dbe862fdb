"""Scalar functions and predicates over chat, sizes and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import fixed
from hearthline.functions import bodies, text, units
from hearthline.operators import chat
from hearthline.operators.health import http_success
from hearthline.plans import views as v
from hearthline.plans.views import C, check
from hearthline.streaming import run

SPACE = v.OUTER_SPACE
CLEAN_SQL = (
    f"regexp_replace(regexp_replace(content, '{fixed.THINKING}', '', 'g'), '{SPACE}', '', 'g')"
)

BODY_SQL = check(
    f", told AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN {CLEAN_SQL}"
    f" ELSE content END AS content FROM chat) SELECT conv_id, turn, {v.BODY_SQL} AS body FROM told", "chat")


def strip_thinking(spark, sf_dir):
    c = v.chat(spark, sf_dir).where(C("role") == "assistant")
    return c.select("conv_id", "turn", text.strip_thinking(C("content")).alias("content"))


def strip_thinking_sql(spark, sf_dir):
    text.register_sql(spark)
    return v.chat(spark, sf_dir).selectExpr("conv_id", "turn", "strip_thinking(content) AS content")


def assistant_filter(spark, sf_dir):
    return chat.clean(v.chat(spark, sf_dir))


def chat_body_clean(spark, sf_dir):
    """A body per turn: its content is text, a list of parts or missing; some bodies are damaged."""
    return bodies.clean(v.chat_bodies(spark, sf_dir))


def stream_chat_bodies(spark, sf_dir):
    stream = v.as_chat_bodies(v.as_chat(v.stream_of(spark, sf_dir, "conversations")))
    return run.drain_append(bodies.clean(stream), "bodies")


def strip_ws(spark, sf_dir):
    wide = F.concat(F.lit(" \t"), C("content"), F.lit(" \n\x1f"))
    return v.chat(spark, sf_dir).select("conv_id", "turn", text.strip_ws(wide).alias("content"))


def format_bytes(spark, sf_dir):
    return v.sized(spark, sf_dir).select(
        "id", units.format_bytes(C("bytes")).alias("shown"),
        units.format_bytes(C("bytes"), 2).alias("shown2"),
    )


# The check counts in whole tenths (hundredths) of a unit, so it rounds exactly.
def _bytes_sql(scale: int, name: str) -> str:
    part = f"n % {scale}"
    digits = {10: f"cast({part} AS VARCHAR)",
              100: f"rtrim(lpad(cast({part} AS VARCHAR), 2, '0'), '0')"}[scale]
    return (
        f"CASE WHEN n % {scale} = 0 THEN cast(n // {scale} AS VARCHAR)"
        f" ELSE cast(n // {scale} AS VARCHAR) || '.' || {digits} END || ' ' || unit AS {name}"
    ).replace("n ", f"n{scale} ")


FORMAT_BYTES_SQL = check(
    ", scaled AS (SELECT id, bytes, CASE WHEN bytes >= 1099511627776 THEN 1099511627776"
    " WHEN bytes >= 1073741824 THEN 1073741824 WHEN bytes >= 1048576 THEN 1048576"
    " WHEN bytes >= 1024 THEN 1024 ELSE 1 END AS step FROM sized),"
    " parts AS (SELECT id, CASE step WHEN 1 THEN 'B' WHEN 1024 THEN 'KB' WHEN 1048576 THEN 'MB'"
    " WHEN 1073741824 THEN 'GB' ELSE 'TB' END AS unit,"
    " (cast(bytes AS HUGEINT) * 20 + step) // (2 * step) AS n10,"
    " (cast(bytes AS HUGEINT) * 200 + step) // (2 * step) AS n100 FROM scaled)"
    f" SELECT id, {_bytes_sql(10, 'shown')}, {_bytes_sql(100, 'shown2')} FROM parts",
    "sized",
)


def decimal_gb(spark, sf_dir):
    return v.sized(spark, sf_dir).select("id", units.decimal_gb(C("bytes")).alias("shown"))


def binary_gib(spark, sf_dir):
    return v.sized(spark, sf_dir).select(
        "id", units.binary_gib(C("bytes")).alias("gib"), units.binary_gib(C("bytes"), 0).alias("whole_gib")
    )


def latency_band(spark, sf_dir):
    return v.probes(spark, sf_dir).select("sample_id", units.latency_band(C("latency_ms")).alias("band"))


def short_model_name(spark, sf_dir):
    return v.served(spark, sf_dir).select("id", text.short_model_name(C("id")).alias("short"))


def short_model_name_all(spark, sf_dir):
    return v.served(spark, sf_dir).select("id", text.short_model_name_all(C("id")).alias("short"))


def kv_split(spark, sf_dir):
    return v.kv_lines(spark, sf_dir).select(
        "line_no", text.kv_key(C("line")).alias("key"), text.kv_value(C("line")).alias("value")
    )


def try_int(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    raw = (
        F.when(C("event_type") == "view", F.concat(F.lit(" "), C("event_id"), F.lit(" ")))
        .when(C("event_type") == "click", C("value").cast("string"))
        .when(C("event_type") == "error", F.lit("n/a"))
        .otherwise(F.concat(F.lit("-"), C("event_id")))
    )
    return e.select("event_id", text.try_int(raw).alias("number"))


def join_nonempty(spark, sf_dir):
    return v.results(spark, sf_dir).select("pos", text.join_nonempty(C("engine"), C("length")).alias("meta"))


def clock_time(spark, sf_dir):
    millis = F.floor(units.micros(C("ts")) / 1000)
    shown = F.when(C("event_type") == "error", 0).when(C("event_type") != "signup", millis)
    return v.table(spark, sf_dir, "events").select("event_id", units.clock_time(shown).alias("shown"))


def endpoint_url(spark, sf_dir):
    base = F.concat(F.lit("http://"), C("host"))
    return v.pages_parsed(spark, sf_dir).select(
        "page_id",
        text.endpoint_url(base, "/v1/models").alias("models_url"),
        text.endpoint_url(base, "/api/tags").alias("tags_url"),
    )


def pad_columns(spark, sf_dir):
    name = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return v.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("|"), text.pad_right(name, 30), F.lit("|")).alias("padded"),
    )


def page_fields(spark, sf_dir):
    return v.pages_parsed(spark, sf_dir)


def http_success_query(spark, sf_dir):
    return v.probes_raw(spark, sf_dir).select(
        "sample_id", F.coalesce(http_success(C("http_code")), F.lit(False)).alias("ok")
    )


def truthy_filter(spark, sf_dir):
    r = v.results(spark, sf_dir)
    return r.where(text.truthy(C("published")) & text.truthy(C("content"))).select(
        "pos", "published", "content"
    )


def default_projection(spark, sf_dir):
    r = v.results(spark, sf_dir).select(
        "pos",
        F.nullif("content", F.lit("")).alias("title"),
        F.nullif("engine", F.lit("")).alias("engine"),
    )
    return chat.with_defaults(r, {"title": fixed.NO_TITLE, "engine": ""})


def json_property_scan(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select("event_id", text.json_field(C("props"), "$.k", "bigint").alias("k"))


QUERIES = {
    "strip_thinking": (strip_thinking, check(
        f"SELECT conv_id, turn, {CLEAN_SQL} AS content FROM chat WHERE role = 'assistant'", "chat")),
    "strip_thinking_sql": (strip_thinking_sql, check(
        f"SELECT conv_id, turn, {CLEAN_SQL} AS content FROM chat", "chat")),
    "assistant_filter": (assistant_filter, check(
        f"SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN {CLEAN_SQL} ELSE content END"
        " AS content FROM chat", "chat")),
    "chat_body_clean": (chat_body_clean, BODY_SQL),
    "stream_chat_bodies": (stream_chat_bodies, BODY_SQL),
    "strip_ws": (strip_ws, check(
        f"SELECT conv_id, turn, regexp_replace(content, '{SPACE}', '', 'g') AS content FROM chat", "chat")),
    "format_bytes": (format_bytes, FORMAT_BYTES_SQL),
    "decimal_gb": (decimal_gb, check(
        ", tenths AS (SELECT id, (cast(bytes AS HUGEINT) * 20 + 1000000000) // 2000000000 AS n FROM sized)"
        " SELECT id, cast(n // 10 AS VARCHAR) || '.' || cast(n % 10 AS VARCHAR) || 'GB' AS shown FROM tenths",
        "sized")),
    "binary_gib": (binary_gib, check(
        "SELECT id, cast((cast(bytes AS HUGEINT) * 20 + 1073741824) // 2147483648 AS DOUBLE) / 10 AS gib,"
        " cast((cast(bytes AS HUGEINT) * 2 + 1073741824) // 2147483648 AS DOUBLE) AS whole_gib FROM sized",
        "sized")),
    "latency_band": (latency_band, check(
        "SELECT sample_id, CASE WHEN latency_ms < 100 THEN 'go' WHEN latency_ms < 300 THEN 'warn' ELSE 'stop'"
        " END AS band FROM probes", "probes")),
    "short_model_name": (short_model_name, check(
        "SELECT id, regexp_replace(id, 'mlx-community/', '') AS short FROM served", "served")),
    "short_model_name_all": (short_model_name_all, check(
        "SELECT id, replace(id, 'mlx-community/', '') AS short FROM served", "served")),
    "kv_split": (kv_split, check(
        "SELECT line_no, split_part(line, '=', 1) AS key, substring(line, strpos(line, '=') + 1) AS value"
        " FROM kv_lines", "kv_lines")),
    "try_int": (try_int,
        "SELECT event_id, CASE WHEN event_type = 'view' THEN event_id WHEN event_type IN ('click', 'error')"
        " THEN NULL ELSE -event_id END AS number FROM events"),
    "join_nonempty": (join_nonempty, check(
        "SELECT pos, concat_ws(' — ', nullif(engine, ''), nullif(length, '')) AS meta FROM results",
        "results")),
    "clock_time": (clock_time,
        "SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN '—' ELSE strftime(ts, '%H:%M:%S')"
        " END AS shown FROM events"),
    "endpoint_url": (endpoint_url, check(
        "SELECT page_id, 'http://' || host || '/v1/models' AS models_url, 'http://' || host || '/api/tags'"
        " AS tags_url FROM pages_parsed", "pages_parsed")),
    "pad_columns": (pad_columns,
        "SELECT p_partkey, '|' || rpad(n, cast(greatest(30, length(n)) AS INT), ' ') || '|' AS padded FROM"
        " (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS n FROM part)"),
    "page_fields": (page_fields, check("SELECT * FROM pages_parsed", "pages_parsed")),
    "http_success": (http_success_query, check(
        "SELECT sample_id, coalesce(http_code BETWEEN 200 AND 299, false) AS ok FROM probes_raw",
        "probes_raw")),
    "truthy_filter": (truthy_filter, check(
        "SELECT pos, published, content FROM results WHERE published <> '' AND content <> ''", "results")),
    "default_projection": (default_projection, check(
        "SELECT pos, coalesce(nullif(content, ''), 'No title') AS title, coalesce(nullif(engine, ''), '')"
        " AS engine FROM results", "results")),
    "json_property_scan": (json_property_scan,
        "SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
}

"""The shared tables in the shapes the operators take.

Each view is written twice: as a DataFrame and, in ``SQL``, as the text its
check runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions import text
from hearthline.session import prepare
from hearthline.sources.probes import stream_files

C = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream, with the schema from its parquet footer.

    A file stream takes a folder or a pattern but no single file, so the path is
    written as a pattern; it fits a table stored as one file or as a folder.
    """
    schema = table(spark, sf_dir, name).schema
    return stream_files(spark, f"{sf_dir}/[{name[0]}]{name[1:]}.parquet", schema)


# --- health -----------------------------------------------------------------


def as_probes(events: DataFrame) -> DataFrame:
    return events.select(
        C("event_id").alias("sample_id"),
        C("user_id").alias("service_id"),
        "ts",
        (C("event_type") != "error").alias("online"),
        C("value").alias("latency_ms"),
    )


def probes(spark, sf_dir):
    return as_probes(table(spark, sf_dir, "events"))


def _hot(rows: DataFrame, row: str, key: str) -> DataFrame:
    """Three keys hold all rows; half of the times are tied within a day, some are missing."""
    tied = F.when(C(row) % 7 == 0, None).when(C(row) % 2 == 0, F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return rows.withColumns({key: C(key) % 3, "ts": F.when(C(row) % 2 == 0, tied).when(C(row) % 7 != 0, C("ts"))})


def probes_hot(spark, sf_dir):
    return _hot(probes(spark, sf_dir), "sample_id", "service_id")


def requests_hot(spark, sf_dir):
    return _hot(requests(spark, sf_dir), "request_id", "server_id")


def probes_raw(spark, sf_dir):
    """No code = no answer; some latencies above the limit; some damaged bodies."""
    e = table(spark, sf_dir, "events")
    code = (
        F.when(C("event_type") == "error", None)
        .when(C("event_type") == "signup", 503)
        .when(C("event_type") == "click", 404)
        .otherwise(200)
    )
    damaged = F.when(C("event_id") % 7 == 0, F.expr("substring(props, 2)")).otherwise(C("props"))
    return e.select(
        C("event_id").alias("sample_id"), C("user_id").alias("service_id"), "ts",
        code.alias("http_code"), (C("value") * 10).alias("latency_ms"), damaged.alias("body"),
    )


def sample_payloads(spark, sf_dir):
    """One captured health answer per event; some are errors, some are damaged."""
    n = C("event_id")
    answer = F.to_json(F.struct((C("event_type") != "error").alias("online"), C("value").alias("latencyMs")))
    payload = (
        F.when(n % 9 == 4, '{"error":"Unknown service"}').when(n % 13 == 6, "<html>").otherwise(answer)
    )
    return table(spark, sf_dir, "events").select(
        n.alias("sample_id"), C("user_id").alias("service_id"), "ts", payload.alias("payload")
    )


def as_requests(events: DataFrame) -> DataFrame:
    return events.select(
        C("event_id").alias("request_id"), C("user_id").alias("server_id"),
        C("event_type").alias("model"), "ts",
    )


def requests(spark, sf_dir):
    return as_requests(table(spark, sf_dir, "events"))


# --- chat and search ----------------------------------------------------------


def as_chat(conversations: DataFrame) -> DataFrame:
    """Closed blocks of mixed form, unclosed blocks and plain text."""
    newline = F.lit("\n")
    closed = F.concat(
        F.lit("<think>"), F.substring("text", 1, 20), newline, F.lit("</THINKING> "), newline,
        C("text"), F.lit(" "),
    )
    content = (
        F.when((C("role") == "assistant") & (C("conv_id") % 3 == 0), closed)
        .when(C("conv_id") % 3 == 1, F.concat(F.lit("<think>open "), C("text")))
        .otherwise(C("text"))
    )
    return conversations.select("conv_id", "turn", "role", content.alias("content"))


_BODY = (
    '{"chat":{"id":', ',"tags":["a",null,1.5]},"messages":[{"content":"<think>asked</think>","role":"user"},"loose",',
    '],"model":"m","stream":false}',
)


def as_chat_bodies(chat: DataFrame) -> DataFrame:
    """One JSON body per message, which is text, has a list of parts, or no content."""
    quoted = F.to_json(F.struct(C("content").alias("c")))
    text_json = F.expr("substring(q, 6, length(q) - 6)")
    role = F.concat(F.lit('"role":"'), "role", F.lit('"}'))
    message = (
        F.when(C("turn") % 4 == 2, F.concat(F.lit('{"content":[{"text":'), text_json, F.lit(',"type":"text"}],'), role))
        .when(C("turn") % 4 == 3, F.concat(F.lit("{"), role))
        .otherwise(F.concat(F.lit('{"content":'), text_json, F.lit(',"id":'), "turn", F.lit(","), role))
    )
    body = F.concat(F.lit(_BODY[0]), "conv_id", F.lit(_BODY[1]), message, F.lit(_BODY[2]))
    whole = F.when(C("turn") % 4 == 0, F.concat(F.lit("["), body)).otherwise(body)
    return chat.withColumn("q", quoted).select("conv_id", "turn", whole.alias("body"))


#: The same over (conv_id, turn, role, content) as check text; every fourth body is damaged.
BODY_SQL = (
    f"CASE WHEN turn % 4 = 0 THEN '[' ELSE '' END || '{_BODY[0]}' || conv_id || '{_BODY[1]}' || CASE turn % 4"
    """ WHEN 2 THEN '{"content":[{"text":' || to_json(content) || ',"type":"text"}],"role":"' || role || '"}'"""
    """ WHEN 3 THEN '{"role":"' || role || '"}'"""
    """ ELSE '{"content":' || to_json(content) || ',"id":' || turn || ',"role":"' || role || '"}' END"""
    f" || '{_BODY[2]}'"
)


def chat_bodies(spark, sf_dir):
    return as_chat_bodies(chat(spark, sf_dir))


def chat(spark, sf_dir):
    return as_chat(table(spark, sf_dir, "conversations"))


def pages_parsed(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.url_host(C("url")).alias("host"),
        "url",
        text.html_title(C("html")).alias("title"),
        text.html_language(C("html")).alias("language"),
    )


def results(spark, sf_dir):
    """Flat search results: a host is a query, page order is received order."""
    n = C("page_id")
    title = C("title")
    return pages_parsed(spark, sf_dir).select(
        C("host").alias("query_id"),
        C("host").alias("q"),
        n.alias("pos"),
        "title",
        F.when(n % 4 == 0, "").when(n % 4 == 1, F.concat(F.lit("  "), title, F.lit(" ")))
        .otherwise(title).alias("content"),
        "url",
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("engine"), n % 5)).alias("engine"),
        F.when(n % 3 == 0, "").otherwise("2024-01-31").alias("published"),
        F.when(n % 6 < 3, "").otherwise("3:20").alias("length"),
        F.when((n % 7) % 3 == 0, "news").when((n % 7) % 3 == 1, "science")
        .otherwise("videos").alias("category"),
        "language",
    )


MOST_RESULTS = 8


def search_payloads(spark, sf_dir):
    """One captured answer per page with 0 to 8 results; some are damaged or bare."""
    n = C("page_id")
    title = C("title")

    def result(i):
        return F.struct(
            F.when((n + i) % 5 != 0, title).alias("title"),
            F.when((n + i) % 4 == 0, "").when((n + i) % 4 == 1, F.concat(F.lit("  "), title, F.lit(" ")))
            .otherwise(title).alias("content"),
            F.concat(C("url"), F.lit("#"), i).alias("url"),
            F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("engine"), i % 4)).alias("engine"),
            F.when((n + i) % 3 != 0, "2024-01-31").alias("publishedDate"),
            F.when(i % 2 == 0, "").otherwise("3:20").alias("length"),
        )

    places = F.slice(
        F.array(*[F.lit(i) for i in range(1, MOST_RESULTS + 1)]),
        F.lit(1), (n % (MOST_RESULTS + 1)).cast("int"),
    )
    whole = F.to_json(F.struct(F.transform(places, result).alias("results")))
    payload = (
        F.when(n % 11 == 5, F.expr("substring(whole, 3)")).when(n % 13 == 7, "{}")
        .otherwise(C("whole"))
    )
    return pages_parsed(spark, sf_dir).withColumn("whole", whole).select(
        n.alias("query_id"), title.alias("q"), payload.alias("payload")
    )


# --- catalogs -----------------------------------------------------------------


def catalog(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        (C("p_partkey") % 20).alias("server"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(":"), "p_partkey").alias("name"),
        F.floor(C("p_retailprice") * 1000000 * (C("p_partkey") % 7)).alias("size"),
        C("p_brand").alias("family"),
        C("p_type").alias("quantization_level"),
        F.concat(C("p_size"), F.lit("B")).alias("parameter_size"),
    )


def served(spark, sf_dir):
    """Hub prefix absent, once and twice."""
    p = table(spark, sf_dir, "part")
    prefix = (
        F.when(C("p_partkey") % 3 == 0, "").when(C("p_partkey") % 3 == 1, "mlx-community/")
        .otherwise("mlx-community/mlx-community/")
    )
    return p.select(
        (C("p_partkey") % 20).alias("server"),
        F.concat(prefix, F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_partkey").alias("id"),
        (C("p_partkey") + 1700000000).alias("created"),
    )


def _model_places(most: int):
    return F.slice(
        F.array(*[F.lit(i) for i in range(1, most)]), F.lit(1), (C("p_partkey") % most).cast("int")
    )


def _model_name(i):
    return F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(":"), "p_partkey", F.lit("."), i)


def _payload(whole):
    damaged = F.when(C("p_partkey") % 17 == 3, F.expr("substring(whole, 3)")).otherwise(C("whole"))
    return lambda p: p.withColumn("whole", whole).select(
        C("p_partkey").alias("server"), damaged.alias("payload")
    )


def catalog_payloads(spark, sf_dir):
    """One local-model catalog per server with 0 to 4 models; some damaged."""

    def model(i):
        return F.struct(
            _model_name(i).alias("name"),
            _model_name(i).alias("model"),
            F.lit("2024-01-31T00:00:00Z").alias("modified_at"),
            F.floor(C("p_retailprice") * 1000000 * (i - 1)).alias("size"),
            F.concat(F.lit("d"), "p_partkey").alias("digest"),
            F.struct(
                F.lit("gguf").alias("format"),
                C("p_brand").alias("family"),
                F.array("p_brand", "p_type").alias("families"),
                F.concat(C("p_size"), F.lit("B")).alias("parameter_size"),
                C("p_type").alias("quantization_level"),
            ).alias("details"),
        )

    whole = F.to_json(F.struct(F.transform(_model_places(5), model).alias("models")))
    return _payload(whole)(table(spark, sf_dir, "part"))


def served_payloads(spark, sf_dir):
    def model(i):
        return F.struct(
            F.concat(F.lit("mlx-community/"), _model_name(i)).alias("id"),
            F.lit("model").alias("object"),
            (C("p_partkey") + 1700000000 + i).alias("created"),
        )

    whole = F.to_json(
        F.struct(F.lit("list").alias("object"), F.transform(_model_places(4), model).alias("data"))
    )
    return _payload(whole)(table(spark, sf_dir, "part"))


def loaded_payloads(spark, sf_dir):
    """Every third size is missing."""

    def model(i):
        size = F.floor(C("p_retailprice") * 1000000 * i)
        return F.struct(
            _model_name(i).alias("name"),
            F.when((C("p_partkey") + i) % 3 != 0, size).alias("size_vram"),
        )

    whole = F.to_json(F.struct(F.transform(_model_places(4), model).alias("models")))
    return _payload(whole)(table(spark, sf_dir, "part"))


def sized(spark, sf_dir):
    """Byte counts from B to TB."""
    return table(spark, sf_dir, "orders").select(
        C("o_orderkey").alias("id"),
        F.floor(C("o_totalprice") * F.pow(F.lit(10), C("o_orderkey") % 8)).alias("bytes"),
    )


# --- text reports ---------------------------------------------------------------


def kv_lines(spark, sf_dir):
    key = (
        F.when(C("c_custkey") % 3 == 0, "API_KEY=").when(C("c_custkey") % 3 == 1, "#API_KEY=")
        .otherwise("OTHER=")
    )
    return table(spark, sf_dir, "customer").select(
        C("c_custkey").alias("line_no"),
        F.concat(key, "c_name", F.lit("="), "c_custkey").alias("line"),
    )


def counter_reports(spark, sf_dir):
    """One counter report per event: header, repeated keys, lines that must drop."""
    value = F.floor(C("value") * 100)
    n = C("event_id")
    kind = C("event_type")
    report = F.concat_ws(
        "\n",
        F.concat(F.lit("Report: "), n, F.lit(".")),
        F.concat(F.lit("Pages active:   "), value, F.lit(".")),
        F.when(kind.isin("click", "view"), F.concat(F.lit("Pages wired down:  "), n % 1000, F.lit("."))),
        F.lit("no colon here"),
        F.lit("Pages free: n/a"),
        F.lit("a: b: 3."),
        F.when(kind == "purchase", F.concat(F.lit("Pages active: "), n % 77, F.lit(".."))),
        F.when(kind == "signup", F.lit("Pages speculative: 12.5."))
        .otherwise(F.concat(F.lit("Pages speculative:"), n % 13)),
    )
    return table(spark, sf_dir, "events").select(n.alias("report_id"), report.alias("report"))


def column_reports(spark, sf_dir):
    """One column report per part, with a header row and 1 to 4 data rows."""

    def line(i):
        return F.concat(
            F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(":"), i, F.lit("   id"), C("p_partkey"),
            F.lit("   "), C("p_size"), F.lit(" GB   2 weeks ago"),
        )

    places = F.slice(
        F.array(*[F.lit(i) for i in range(1, 5)]), F.lit(1), (C("p_partkey") % 4 + 1).cast("int")
    )
    report = F.concat(
        F.lit("NAME    ID    SIZE    MODIFIED\n"), F.array_join(F.transform(places, line), "\n")
    )
    return table(spark, sf_dir, "part").select(C("p_partkey").alias("report_id"), report.alias("report"))


# --- registries -------------------------------------------------------------------


def engines(spark, sf_dir):
    """Engine registry from the document sources."""
    n = F.substring("source", 4, 10).cast("int")
    categories = (
        F.when(n % 4 == 0, F.array(F.lit("general"), F.lit("news")))
        .when(n % 4 == 1, F.array(F.lit("videos")))
        .when(n % 4 == 2, F.array(F.lit("science")))
    )
    return table(spark, sf_dir, "documents").select("source").distinct().select(
        C("source").alias("name"),
        F.when(n % 5 != 4, n % 5 == 0).alias("disabled"),
        categories.alias("categories"),
    )


# Outer whitespace as the checks write it.
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
OUTER_SPACE = f"^{SPACE_CLASS}+|{SPACE_CLASS}+$"

_HOT_TS = (
    "CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN cast(date_trunc('day', ts) AS TIMESTAMP) ELSE ts END END AS ts"
)

SQL = {
    "probes": "SELECT event_id AS sample_id, user_id AS service_id, ts, event_type <> 'error' AS online,"
    " value AS latency_ms FROM events",
    "probes_hot": f"SELECT event_id AS sample_id, user_id % 3 AS service_id, {_HOT_TS}, event_type <> 'error' AS online,"
    " value AS latency_ms FROM events",
    "requests_hot": f"SELECT event_id AS request_id, user_id % 3 AS server_id, event_type AS model, {_HOT_TS} FROM events",
    "probes_raw": "SELECT event_id AS sample_id, user_id AS service_id, ts, CASE event_type WHEN 'error'"
    " THEN NULL WHEN 'signup' THEN 503 WHEN 'click' THEN 404 ELSE 200 END AS http_code,"
    " value * 10 AS latency_ms, CASE WHEN event_id % 7 = 0 THEN substring(props, 2) ELSE props END AS body"
    " FROM events",
    "requests": "SELECT event_id AS request_id, user_id AS server_id, event_type AS model, ts FROM events",
    "chat": "SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN"
    " concat('<think>', substring(text, 1, 20), chr(10), '</THINKING> ', chr(10), text, ' ')"
    " WHEN conv_id % 3 = 1 THEN concat('<think>open ', text) ELSE text END AS content FROM conversations",
    "pages_parsed": "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, url,"
    " regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,"
    " regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS language FROM pages",
    "results": "SELECT host AS query_id, host AS q, page_id AS pos, title, CASE page_id % 4 WHEN 0 THEN ''"
    " WHEN 1 THEN concat('  ', title, ' ') ELSE title END AS content, url,"
    " CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('engine', page_id % 5) END AS engine,"
    " CASE WHEN page_id % 3 = 0 THEN '' ELSE '2024-01-31' END AS published,"
    " CASE WHEN page_id % 6 < 3 THEN '' ELSE '3:20' END AS length,"
    " CASE (page_id % 7) % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'science' ELSE 'videos' END AS category,"
    " language FROM pages_parsed",
    "hits": "SELECT page_id AS query_id, title AS q, cast(i AS INTEGER) AS pos,"
    " CASE WHEN (page_id + i) % 5 <> 0 THEN title END AS title,"
    " CASE (page_id + i) % 4 WHEN 0 THEN '' WHEN 1 THEN concat('  ', title, ' ') ELSE title END AS content,"
    " concat(url, '#', i) AS url,"
    " CASE WHEN i % 4 = 0 THEN '' ELSE concat('engine', i % 4) END AS engine,"
    " CASE WHEN (page_id + i) % 3 <> 0 THEN '2024-01-31' END AS published,"
    " CASE WHEN i % 2 = 0 THEN '' ELSE '3:20' END AS length"
    " FROM (SELECT *, unnest(generate_series(1, page_id % 9)) AS i FROM pages_parsed)"
    " WHERE page_id % 11 <> 5 AND page_id % 13 <> 7",
    "catalog": "SELECT p_partkey % 20 AS server, concat(replace(p_name, ' ', '-'), ':', p_partkey) AS name,"
    " cast(floor(p_retailprice * 1000000 * (p_partkey % 7)) AS BIGINT) AS size, p_brand AS family,"
    " p_type AS quantization_level, concat(p_size, 'B') AS parameter_size FROM part",
    "served": "SELECT p_partkey % 20 AS server, concat(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN"
    " 'mlx-community/' ELSE 'mlx-community/mlx-community/' END, replace(p_name, ' ', '-'), '-', p_partkey)"
    " AS id, 1700000000 + p_partkey AS created FROM part",
    "sized": "SELECT o_orderkey AS id, cast(floor(o_totalprice * power(10, o_orderkey % 8)) AS BIGINT)"
    " AS bytes FROM orders",
    "kv_lines": "SELECT c_custkey AS line_no, concat(CASE c_custkey % 3 WHEN 0 THEN 'API_KEY=' WHEN 1 THEN"
    " '#API_KEY=' ELSE 'OTHER=' END, c_name, '=', c_custkey) AS line FROM customer",
    "counters": "SELECT event_id AS report_id, 'Pages active' AS key, CASE WHEN event_type = 'purchase' THEN"
    " event_id % 77 ELSE cast(floor(value * 100) AS BIGINT) END AS value FROM events"
    " UNION ALL SELECT event_id, 'Pages wired down', event_id % 1000 FROM events"
    " WHERE event_type IN ('click', 'view')"
    " UNION ALL SELECT event_id, 'Pages speculative', event_id % 13 FROM events"
    " WHERE event_type <> 'signup'",
    "engines": "SELECT name, n % 5 = 0 AS disabled, CASE n % 4 WHEN 0 THEN ['general', 'news']"
    " WHEN 1 THEN ['videos'] WHEN 2 THEN ['science'] ELSE ['general'] END AS categories"
    " FROM (SELECT DISTINCT source AS name, cast(substring(source, 4) AS INT) AS n FROM documents)",
}

# Views that are built on another view come after it.
_NEEDS = {"results": ("pages_parsed",), "hits": ("pages_parsed",)}


def check(body: str, *views: str) -> str:
    """Check text: the views it uses as common tables, then ``body``, which may
    go on with further common tables."""
    names: list[str] = []
    for view in views:
        for name in (*_NEEDS.get(view, ()), view):
            if name not in names:
                names.append(name)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + body


#: Rows of a chunk where hot keys are cut on purpose.
HOT_CHUNK = 2500


def on_hot(body: str, view: str) -> str:
    """A check text over the view with hot keys; missing times come first, as in Spark."""
    return body.replace(f"FROM {view}", f"FROM {view}_hot").replace("ORDER BY ts", "ORDER BY ts NULLS FIRST")

"""Streaming queries, run over all landed input, each with its batch check."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions.units import micros
from hearthline.operators import registry
from hearthline.plans import health, models
from hearthline.plans import views as v
from hearthline.plans.chat import CLEAN_SQL
from hearthline.plans.views import C, check
from hearthline.session import fresh_dir
from hearthline.sources.payloads import read_loaded_models, stream_captures
from hearthline.sources.posts import PostedLists
from hearthline.sources.probes import read_samples, stream_files
from hearthline.sources.reports import read_counters
from hearthline.streaming import health as st
from hearthline.streaming import run
from hearthline.streaming.asof import stream_asof

DELAY = "1 hour"
GRACE = 6 * 3600
LANDINGS = 5
ASOF_DELAY = "2 days"


def _events(spark, sf_dir):
    e = v.stream_of(spark, sf_dir, "events")
    return e.withColumn("ts", C("ts").cast("timestamp"))


def _naive(df, *columns):
    return df.withColumns({c: C(c).cast("timestamp_ntz") for c in columns})


def stream_latest_status(spark, sf_dir):
    stream = st.stream_latest(v.as_probes(_events(spark, sf_dir)))
    updates = run.drain_updates(stream, "latest")
    return _naive(run.newest_per_key(updates, "service_id"), "ts")


def stream_windows(size, slide=None):
    def query(spark, sf_dir):
        stream = st.stream_health(v.as_probes(_events(spark, sf_dir)), size, DELAY, slide)
        return _naive(run.drain_append(stream, "windows"), "window_start", "window_end")

    return query


def stream_residency(spark, sf_dir):
    stream = st.stream_residency(v.as_requests(_events(spark, sf_dir)), DELAY, models.IDLE)
    return _naive(run.drain_append(stream, "residency"), "loaded", "unloaded")


def _container_changes(probes):
    stream = st.stream_container_health(probes, DELAY, start_period_seconds=GRACE)
    return _naive(run.drain_append(stream, "container-health"), "ts")


def stream_container_health(spark, sf_dir):
    return _container_changes(v.as_probes(_events(spark, sf_dir)))


def stream_container_health_batches(spark, sf_dir):
    """The same samples in files that land one per batch, each sample up to 50 minutes
    late, so that batches overlap in time."""
    events = v.table(spark, sf_dir, "events").withColumn("ts", C("ts").cast("timestamp"))
    probes = v.as_probes(events)
    landed = fresh_dir(spark, "samples")
    at = micros(C("ts")) + F.pmod(F.xxhash64("sample_id"), F.lit(50 * 60)) * 1_000_000
    ends = probes.agg(F.min(micros(C("ts"))).alias("low"), F.max(micros(C("ts"))).alias("high")).first()
    if ends.low is None:
        probes.write.parquet(landed)
    else:
        span = ends.high - ends.low + 3_600_000_000
        turn = F.floor((at - ends.low) * LANDINGS / F.lit(span))
        for i in range(LANDINGS):  # a file source takes files by the time they were written
            probes.where(turn == i).coalesce(1).write.mode("append").parquet(landed)
    return _container_changes(stream_files(spark, landed, probes.schema, files_per_batch=1))


def stream_probe_dedup(spark, sf_dir):
    """Every sample arrives twice."""
    twice = v.as_probes(_events(spark, sf_dir)).unionByName(v.as_probes(_events(spark, sf_dir)))
    return _naive(run.drain_append(st.stream_dedup(twice, DELAY), "dedup"), "ts")


def stream_registry_join(spark, sf_dir):
    ids = _events(spark, sf_dir).select("event_id", (C("user_id") % 30).cast("int").alias("id"))
    nations = v.table(spark, sf_dir, "nation").select(C("n_nationkey").alias("id"), C("n_name").alias("name"))
    return run.drain_append(st.stream_enrich(ids, nations), "enrich")


def registry_changes(spark, sf_dir):
    """Every nation changes its name each third day, from a day of its own on; some are
    removed in between. The last changes come after all events."""
    days = F.explode(F.sequence(F.lit(0), F.lit(30))).alias("day")
    n = C("n_nationkey") + C("day")
    start = F.timestamp_micros(F.lit(1704067200000000))
    return v.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", days).where((n % 3 == 0) | (C("day") == 30)).select(
        C("n_nationkey").cast("int").alias("id"), (start + F.make_dt_interval("day")).alias("ts"),
        F.when(n % 5 != 0, F.concat("n_name", F.lit(" "), "day")).alias("name"))


def stream_registry_asof(spark, sf_dir):
    """Events meet the name their nation had at their time. Changes land in three files,
    one per batch, that overlap in time, while all events are there from the first batch on."""
    landed = fresh_dir(spark, "changes")
    changes = registry_changes(spark, sf_dir)
    turn = F.floor((F.dayofmonth("ts") + C("id") % 2) / 11)
    for i in range(3):
        turned = turn.isin(2, 3) if i == 2 else turn == i
        changes.where(turned).coalesce(1).write.mode("append").parquet(landed)
    ids = _events(spark, sf_dir).select("event_id", (C("user_id") % 30).cast("int").alias("id"), "ts")
    told = stream_files(spark, landed, changes.schema, files_per_batch=1)
    return _naive(run.drain_append(stream_asof(ids, told, "id", ["name"], ASOF_DELAY), "asof"), "ts")


def stream_strip_thinking(spark, sf_dir):
    chat = v.as_chat(v.stream_of(spark, sf_dir, "conversations"))
    return run.drain_append(st.stream_clean(chat), "clean")


def stream_registry_sink(spark, sf_dir):
    """Lists posted in parts that come one file per batch; a batch logged twice changes
    nothing, and the log is put together between batches."""
    suppliers = v.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    parts = registry.post_parts(suppliers, "s_nationkey", "s_suppkey", F.struct("s_suppkey", "s_name"), part_rows=5)
    landed, path = fresh_dir(spark, "posted"), fresh_dir(spark, "stream-registry")
    parts.withColumn("post", F.lit(1)).repartition(3, "part").write.parquet(landed)
    schema = spark.read.parquet(landed).schema

    lists = PostedLists(spark, path, "s_nationkey", schema)

    def log(batch, batch_id):
        for _ in range(2):
            lists.append(batch, "stream", batch_id)
        if batch_id % 2:
            lists.compact()
            lists.expire()

    run.drain_batches(stream_files(spark, landed, schema, files_per_batch=1), "registry-sink", log, mode="append")
    return lists.read()


def _captured(spark, rows, fields, read, label):
    """Captures land as JSON lines; a stream reads one file per batch, stops, and goes on
    from its checkpoint with files that have landed since."""
    landed, base = fresh_dir(spark, "captures"), fresh_dir(spark, label)
    key = rows.columns[0]
    lines = rows.select(key, F.to_json(F.struct(*rows.columns)).alias("value"))
    for turn in range(2):
        part = lines.where(F.pmod(F.xxhash64(key), F.lit(2)) == turn).select("value")
        # A damaged line lands with each part.
        broken = spark.range(1).select(F.lit('{"damaged').alias("value"))
        part.unionByName(broken).repartition(2).write.mode("append").text(landed)
        done = run.drain_append(read(stream_captures(spark, landed, fields, files_per_batch=1)), label, base)
    return done


def stream_probe_payloads(spark, sf_dir):
    rows = v.sample_payloads(spark, sf_dir).withColumn("ts", C("ts").cast("string"))
    fields = "sample_id bigint, service_id bigint, ts timestamp, payload string"
    return _naive(_captured(spark, rows, fields, read_samples, "samples"), "ts")


def stream_loaded_models(spark, sf_dir):
    rows = v.loaded_payloads(spark, sf_dir)
    return _captured(spark, rows, "server bigint, payload string", read_loaded_models, "loaded")


def stream_counter_reports(spark, sf_dir):
    rows = v.counter_reports(spark, sf_dir)
    return _captured(spark, rows, "report_id bigint, report string", read_counters, "counters")


# An append-mode window is emitted once the watermark (newest ts less the delay,
# cut to its millisecond) has reached its end.
MARK = f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"


def _windows_sql(hours: int, slide: int) -> str:
    return check(
        f", opened AS (SELECT *, unnest(generate_series(0, {hours // slide - 1})) AS back FROM probes),"
        f" placed AS (SELECT *, time_bucket(INTERVAL {slide} HOUR, ts, TIMESTAMP '2024-01-01')"
        f" - back * INTERVAL {slide} HOUR AS window_start FROM opened)"
        f" SELECT service_id, window_start, window_start + INTERVAL {hours} HOUR AS window_end,"
        f" count(*) AS samples, {health.UPTIME_SQL} AS uptime, {health.MEAN_SQL} AS mean_ms FROM placed"
        f" WHERE window_start + INTERVAL {hours} HOUR <= {MARK} GROUP BY 1, 2, 3", "probes")


ASOF_SQL = (
    "WITH changes AS (SELECT CAST(n_nationkey AS INTEGER) AS id, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INTEGER)) AS ts,"
    " CASE WHEN (n_nationkey + day) % 5 <> 0 THEN n_name || ' ' || day END AS name FROM nation, range(0, 31) r(day)"
    " WHERE (n_nationkey + day) % 3 = 0 OR day = 30), ids AS (SELECT event_id, CAST(user_id % 30 AS INTEGER) AS id, ts FROM events"
    " WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY FROM events))"
    " SELECT event_id, i.id, i.ts, c.name, CASE WHEN c.name IS NULL THEN 404 ELSE 200 END AS status"
    " FROM ids i ASOF LEFT JOIN changes c ON i.id = c.id AND i.ts >= c.ts"
)


CONTAINER_SQL = check(
    f", passed AS (SELECT * FROM probes WHERE ts <= {MARK}),"
    " first AS (SELECT service_id, min(ts) AS first_ts, min(ts) FILTER (online) AS first_ok FROM passed"
    " GROUP BY 1), counted AS (SELECT p.* FROM passed p JOIN first USING (service_id) WHERE online"
    f" OR ts >= first_ts + INTERVAL {GRACE} SECOND OR ts > first_ok),"
    " placed AS (SELECT *, count(*) FILTER (online) OVER (PARTITION BY service_id ORDER BY ts, sample_id"
    " ROWS UNBOUNDED PRECEDING) AS ups FROM counted),"
    " fails AS (SELECT *, row_number() OVER (PARTITION BY service_id, ups ORDER BY ts, sample_id) AS n"
    " FROM placed WHERE NOT online),"
    " runs AS (SELECT service_id, ups, max(n) AS n FROM fails GROUP BY 1, 2)"
    " SELECT service_id, ts, 'unhealthy' AS state FROM fails WHERE n = 3 UNION ALL"
    " SELECT p.service_id, ts, 'healthy' FROM placed p LEFT JOIN runs r"
    " ON p.service_id = r.service_id AND p.ups - 1 = r.ups"
    " WHERE online AND (p.ups = 1 OR r.n >= 3)", "probes")


QUERIES = {
    "stream_latest_status": (stream_latest_status, check(health.LATEST_SQL, "probes")),
    "stream_tumbling_health": (stream_windows("1 day"), _windows_sql(24, 24)),
    "stream_sliding_health": (stream_windows("1 day", "6 hours"), _windows_sql(24, 6)),
    "stream_residency": (stream_residency, (
        "WITH spans AS (" + models.QUERIES["model_residency"][1] + ")"
        f" SELECT server_id, model, loaded, unloaded, requests FROM spans WHERE unloaded <= {MARK}")),
    "stream_container_health": (stream_container_health, CONTAINER_SQL),
    "stream_container_health_batches": (stream_container_health_batches, CONTAINER_SQL),
    "stream_probe_dedup": (stream_probe_dedup, check("SELECT * FROM probes", "probes")),
    "stream_registry_join": (stream_registry_join,
        "SELECT event_id, cast(user_id % 30 AS INT) AS id, n_name AS name, CASE WHEN n_name IS NULL THEN 404"
        " ELSE 200 END AS status FROM events LEFT JOIN nation ON user_id % 30 = n_nationkey"),
    "stream_registry_asof": (stream_registry_asof, ASOF_SQL),
    "stream_probe_payloads": (stream_probe_payloads, health.QUERIES["probe_payload_scan"][1]),
    "stream_loaded_models": (stream_loaded_models, models.QUERIES["loaded_models_scan"][1]),
    "stream_counter_reports": (stream_counter_reports, models.QUERIES["counter_report_scan"][1]),
    "stream_strip_thinking": (stream_strip_thinking, check(
        f"SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN {CLEAN_SQL} ELSE content END AS content"
        " FROM chat", "chat")),
    "stream_registry_sink": (stream_registry_sink, "SELECT s_suppkey, s_name, s_nationkey FROM supplier"),
}

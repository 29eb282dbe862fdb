"""Probes: outcomes, rollups, runs and cards."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from hearthline.operators import health as h
from hearthline.plans import views as v
from hearthline.plans.views import C, check
from hearthline.session import cut_lineage
from hearthline.sources.probes import read_samples

ASOF = "2024-02-01 00:00:00"


def probe_log_scan(spark, sf_dir):
    return v.probes(spark, sf_dir)


def probe_payload_scan(spark, sf_dir):
    return read_samples(v.sample_payloads(spark, sf_dir))


def probe_outcome(spark, sf_dir):
    return h.probe_outcome(v.probes_raw(spark, sf_dir))


def strict_probe_outcome(spark, sf_dir):
    return h.probe_outcome(v.probes_raw(spark, sf_dir), require_json=True)


def status_projection(spark, sf_dir):
    """Cards for all customers; most have no sample yet."""
    services = v.table(spark, sf_dir, "customer").select(C("c_custkey").alias("service_id"), "c_name")
    return h.status_cards(services, h.latest_status(v.probes(spark, sf_dir)))


def latest_status(spark, sf_dir):
    return h.latest_status(v.probes(spark, sf_dir))


def last_refresh(spark, sf_dir):
    return h.last_refresh(v.probes(spark, sf_dir))


def wait_until_ready(tries):
    return lambda spark, sf_dir: h.wait_until_ready(v.probes(spark, sf_dir), tries)


def health_rollup(spark, sf_dir):
    rolled = h.health_rollup(v.probes(spark, sf_dir))
    return rolled.withColumn("hour", C("hour").cast("timestamp_ntz"))


def health_rollup_daily(spark, sf_dir):
    rolled = h.health_rollup(v.probes(spark, sf_dir), grain="day")
    return rolled.withColumn("day", C("day").cast("timestamp_ntz"))


def health_rollup_merged(spark, sf_dir):
    """Days per service from stored sketches of hours."""
    stored = cut_lineage(h.health_sketches(v.probes(spark, sf_dir)), "sketches")
    return h.merged_health(stored).withColumn("day", C("day").cast("timestamp_ntz"))


def health_fleet_p95(spark, sf_dir):
    """Days over all services: whether the estimated percentile has nearly its rank among the samples."""
    probes = v.probes(spark, sf_dir)
    stored = cut_lineage(h.health_sketches(probes), "sketches")
    days = h.merged_health(stored, keys=()).withColumn("day", C("day").cast("timestamp_ntz"))
    own = probes.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), h.timed_hundredths(C("latency_ms")).alias("at"))
    estimate = F.round(C("p95_ms") * 100).cast("bigint")
    ranks = days.join(own, "day").groupBy("day", "samples").agg(
        F.count_if(C("at") < estimate).alias("below"), F.count_if(C("at") <= estimate).alias("up_to"), F.count("at").alias("n"))
    # Twice the stated error, so that chance does not decide, and one sample for the step of a rank.
    off = F.lit(2 * h.RANK_ERROR) * C("n") + 1
    close = (C("below") <= 0.95 * C("n") + off) & (C("up_to") >= 0.95 * C("n") - off)
    return ranks.select("day", "samples", close.alias("close"))


def health_rollup_totals(spark, sf_dir):
    return h.health_rollup_totals(v.probes(spark, sf_dir))


def slowest_services(spark, sf_dir):
    return h.slowest_services(v.probes(spark, sf_dir))


LATEST_SQL = (
    "SELECT service_id, max(ts) AS ts, arg_max(sample_id, ts) AS sample_id, arg_max(online, ts) AS online,"
    " arg_max(latency_ms, ts) AS latency_ms FROM probes GROUP BY 1"
)
BAND_SQL = "CASE WHEN latency_ms < 100 THEN 'go' WHEN latency_ms < 300 THEN 'warn' WHEN latency_ms >= 300 THEN 'stop' END"
MEAN_SQL = "cast(sum(cast(round(latency_ms * 100) AS BIGINT)) AS DOUBLE) / count(latency_ms) / 100"
UPTIME_SQL = "cast(count(*) FILTER (online) AS DOUBLE) / count(*)"
ORDERED = "PARTITION BY service_id ORDER BY ts, sample_id"
GAP_SQL = f"date_diff('microsecond', lag(ts) OVER ({ORDERED}), ts)"
READY_SQL = (
    "SELECT service_id, min(n) FILTER (online) AS tries, CASE WHEN min(n) FILTER (online) IS NOT NULL THEN 'ready'"
    " ELSE 'not reachable' END AS state FROM (SELECT *, cast(row_number() OVER (" + ORDERED + ") AS INTEGER) AS n FROM probes)"
    " WHERE n <= {} GROUP BY 1"
)
OUTCOME_SQL = (
    "SELECT sample_id, service_id, ts, http_code IS NOT NULL AND latency_ms < 3000{} AS online, latency_ms"
    " FROM probes_raw"
)


def _rollup_sql(grain: str) -> str:
    return check(
        f"SELECT service_id, cast(date_trunc('{grain}', ts) AS TIMESTAMP) AS {grain}, count(*) AS samples,"
        f" {UPTIME_SQL} AS uptime, {MEAN_SQL} AS mean_ms,"
        " round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,"
        " count(*) FILTER (latency_ms < 100) AS go,"
        " count(*) FILTER (latency_ms >= 100 AND latency_ms < 300) AS warn,"
        " count(*) FILTER (latency_ms >= 300) AS stop FROM probes GROUP BY 1, 2", "probes")


#: Operators over samples in order of (ts, sample_id), with the text of their check.
IN_ORDER = {
    "unhealthy_runs": (h.unhealthy_runs,
        f", numbered AS (SELECT *, row_number() OVER ({ORDERED}) - row_number() OVER"
        " (PARTITION BY service_id, online ORDER BY ts, sample_id) AS island FROM probes)"
        " SELECT service_id, min(ts) AS started, max(ts) AS ended, count(*) AS failures FROM numbered"
        " WHERE NOT online GROUP BY service_id, island HAVING count(*) >= 3"),
    "stale_flag": (partial(h.stale_flag, asof=ASOF),
        f", stood AS (SELECT sample_id, service_id, date_diff('microsecond', ts, coalesce(lead(ts) OVER ({ORDERED}),"
        f" TIMESTAMP '{ASOF}')) AS stood_us FROM probes)"
        " SELECT sample_id, service_id, stood_us, stood_us > 5000000 AS stale FROM stood"),
    "sample_lag": (h.sample_lag,
        f", gaps AS (SELECT sample_id, service_id, {GAP_SQL} AS gap_us FROM probes)"
        " SELECT *, CASE WHEN gap_us IS NOT NULL THEN greatest(gap_us // 10000000 - 1, 0) END AS missed_polls"
        " FROM gaps"),
    "elapsed_ms": (h.sample_gaps,
        f"SELECT sample_id, service_id, epoch_us(lead(ts) OVER ({ORDERED})) // 1000 - epoch_us(ts) // 1000 AS elapsed_ms"
        " FROM probes"),
    "rolling_latency": (h.rolling_latency,
        f"SELECT sample_id, service_id, cast(sum(cast(round(latency_ms * 100) AS BIGINT)) OVER w AS DOUBLE)"
        " / count(latency_ms) OVER w / 100 AS mean_ms, max(latency_ms) OVER w AS max_ms FROM probes"
        f" WINDOW w AS ({ORDERED} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"),
}


def _in_order(key: str) -> dict[str, tuple]:
    """An operator over all services, and over three that hold all samples, cut into
    chunks, with equal and missing times."""
    operator, body = IN_ORDER[key]
    return {
        key: (lambda spark, sf_dir: operator(v.probes(spark, sf_dir)), check(body, "probes")),
        key + "_hot": (
            lambda spark, sf_dir: operator(v.probes_hot(spark, sf_dir), rows_per_chunk=v.HOT_CHUNK),
            check(v.on_hot(body, "probes"), "probes_hot")),
    }


QUERIES = {
    "probe_log_scan": (probe_log_scan, check("SELECT * FROM probes", "probes")),
    "probe_payload_scan": (probe_payload_scan,
        "SELECT event_id AS sample_id, user_id AS service_id, ts, event_type <> 'error' AND event_id % 9 <> 4"
        " AND event_id % 13 <> 6 AS online, CASE WHEN event_id % 9 <> 4 AND event_id % 13 <> 6 THEN value END"
        " AS latency_ms FROM events"),
    "probe_outcome": (probe_outcome, check(OUTCOME_SQL.format(""), "probes_raw")),
    "strict_probe_outcome": (strict_probe_outcome, check(
        OUTCOME_SQL.format(" AND json_valid(body)"), "probes_raw")),
    "status_projection": (status_projection, check(
        f", latest AS ({LATEST_SQL}), cards AS (SELECT c_custkey AS service_id, c_name, CASE WHEN l.service_id"
        " IS NULL THEN 'Checking' WHEN online THEN 'Online' ELSE 'Offline' END AS label,"
        f" {BAND_SQL} AS band FROM customer LEFT JOIN latest l ON c_custkey = l.service_id)"
        " SELECT *, CASE label WHEN 'Checking' THEN '#2e2e2e' WHEN 'Online' THEN '#00e87a' ELSE '#ff3b5c' END"
        " AS accent FROM cards", "probes")),
    "latest_status": (latest_status, check(LATEST_SQL, "probes")),
    "last_refresh": (last_refresh, check(
        "SELECT max(ts) AS last_ts, coalesce(strftime(max(ts), '%H:%M:%S'), '—') AS shown FROM probes", "probes")),
    "wait_until_ready": (wait_until_ready(20), check(READY_SQL.format(20), "probes")),
    "wait_until_ready_short": (wait_until_ready(1), check(READY_SQL.format(1), "probes")),
    "health_rollup": (health_rollup, _rollup_sql("hour")),
    "health_rollup_daily": (health_rollup_daily, _rollup_sql("day")),
    "health_rollup_merged": (health_rollup_merged, check(
        f"SELECT service_id, cast(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS samples, {UPTIME_SQL} AS uptime,"
        f" {MEAN_SQL} AS mean_ms, cast(quantile_disc(cast(round(latency_ms * 100) AS BIGINT), 0.95) AS DOUBLE) / 100 AS p95_ms"
        " FROM probes GROUP BY 1, 2", "probes")),
    "health_fleet_p95": (health_fleet_p95, check(
        "SELECT cast(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS samples, true AS close FROM probes GROUP BY 1", "probes")),
    "health_rollup_totals": (health_rollup_totals, check(
        f", banded AS (SELECT *, {BAND_SQL} AS band FROM probes) SELECT service_id, band,"
        f" grouping(service_id, band) AS level, count(*) AS samples, {UPTIME_SQL} AS uptime,"
        f" {MEAN_SQL} AS mean_ms FROM banded GROUP BY ROLLUP (service_id, band)", "probes")),
    "slowest_services": (slowest_services, check(
        "SELECT service_id, max(latency_ms) AS worst_ms FROM probes GROUP BY 1"
        " ORDER BY worst_ms DESC, service_id LIMIT 10", "probes")),
    **{key: query for name in IN_ORDER for key, query in _in_order(name).items()},
}

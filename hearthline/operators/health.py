"""Health probes: outcome, latest status, uptime, failure runs.

Samples are (sample_id, service_id, ts, online, latency_ms); a sample's place in
time is (ts, sample_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline import fixed
from hearthline.functions.text import is_json
from hearthline.functions.units import clock_time, elapsed_ms, latency_band, micros
from hearthline.operators import sequence

SERVICE = ["service_id"]
ORDER = ["ts", "sample_id"]


def hundredths(ms: Column) -> Column:
    """Latency as whole hundredths, so that sums do not depend on their order."""
    return F.round(ms * 100).cast("bigint")


def mean_ms(ms: Column) -> Column:
    return F.sum(hundredths(ms)) / F.count(ms) / 100


def probe_outcome(raw: DataFrame, require_json: bool = False) -> DataFrame:
    """Online = any answer within the time limit; elapsed time is kept either way."""
    online = F.col("http_code").isNotNull() & F.coalesce(F.col("latency_ms") < fixed.PROBE_TIMEOUT_MS, F.lit(False))
    if require_json:
        online = online & F.coalesce(is_json(F.col("body")), F.lit(False))
    return raw.select("sample_id", "service_id", "ts", online.alias("online"), "latency_ms")


def http_success(code: Column) -> Column:
    return code.cast("string").startswith("2")


def status_label(online: Column, sampled: Column) -> Column:
    """``Checking`` before the first sample, then ``Online`` or ``Offline``."""
    return (
        F.when(~sampled, "Checking")
        .when(F.coalesce(online, F.lit(False)), "Online")
        .otherwise("Offline")
    )


def accent(label: Column) -> Column:
    return F.coalesce(*[F.when(label == name, value) for name, value in fixed.ACCENTS.items()])


def status_cards(services: DataFrame, latest: DataFrame) -> DataFrame:
    """Label, colour and latency band per registered service."""
    seen = latest.withColumn("_seen", F.lit(True))
    sampled = F.col("_seen").isNotNull()
    label = status_label(F.col("online"), sampled)
    return services.join(seen, "service_id", "left").select(
        *services.columns,
        label.alias("label"),
        accent(label).alias("accent"),
        latency_band(F.col("latency_ms")).alias("band"),
    )


def latest_status(probes: DataFrame) -> DataFrame:
    """Newest sample per service: one aggregation, combined in the map tasks."""
    newest = F.max(F.struct("ts", "sample_id", "online", "latency_ms"))
    return probes.groupBy(*SERVICE).agg(newest.alias("s")).select("service_id", "s.*")


def last_refresh(probes: DataFrame) -> DataFrame:
    """Time of the newest sample over all services, as shown in the page head."""
    newest = probes.agg(F.max("ts").alias("last_ts"))
    millis = F.floor(micros(F.col("last_ts")) / 1000)
    return newest.select("last_ts", clock_time(millis).alias("shown"))


def unhealthy_runs(
    probes: DataFrame,
    retries: int = fixed.RETRIES,
    rows_per_chunk: int = sequence.ROWS_PER_CHUNK,
) -> DataFrame:
    """Runs of at least ``retries`` failed samples: start, end, length.

    All failures between two successes share the count of successes before them.
    """
    rows = sequence.in_order(
        probes.select("sample_id", "service_id", "ts", "online"), SERVICE, ORDER, rows_per_chunk
    )
    counted = rows.running_count(F.col("online"), "run").done()
    return (
        counted.where(~F.col("online"))
        .groupBy("service_id", "run")
        .agg(
            F.min("ts").alias("started"),
            F.max("ts").alias("ended"),
            F.count(F.lit(1)).alias("failures"),
        )
        .where(F.col("failures") >= retries)
        .drop("run")
    )


def wait_until_ready(attempts: DataFrame, max_tries: int = fixed.READY_TRIES) -> DataFrame:
    """Tries until the first success among the first ``max_tries`` per service."""
    tried = attempts.select("service_id", "online", "ts", "sample_id").withColumn(
        "n", F.row_number().over(W.partitionBy(*SERVICE).orderBy(*ORDER))
    )
    first = F.min(F.when(F.col("online"), F.col("n")))
    return (
        tried.where(F.col("n") <= max_tries)
        .groupBy(*SERVICE)
        .agg(first.alias("tries"))
        .withColumn("state", F.when(F.col("tries").isNotNull(), "ready").otherwise("not reachable"))
    )


def stale_flag(
    probes: DataFrame,
    asof: str,
    seconds: int = fixed.STALE_SECONDS,
    rows_per_chunk: int = sequence.ROWS_PER_CHUNK,
) -> DataFrame:
    """Time each sample stood until the next one, or until ``asof``, and whether
    it outlived the freshness limit."""
    rows = sequence.in_order(
        probes.select("sample_id", "service_id", "ts"), SERVICE, ORDER, rows_per_chunk
    )
    after = rows.look_around(1, {"next_ts": lambda w: F.lag("ts").over(w)}, ahead=True).done()
    end = F.coalesce(micros(F.col("next_ts")), micros(F.lit(asof)))
    stood = end - micros(F.col("ts"))
    return after.select(
        "sample_id", "service_id",
        stood.alias("stood_us"),
        (stood > seconds * 1_000_000).alias("stale"),
    )


def sample_gaps(
    probes: DataFrame, rows_per_chunk: int = sequence.ROWS_PER_CHUNK
) -> DataFrame:
    """Milliseconds from each sample to the next of its service."""
    rows = sequence.in_order(
        probes.select("sample_id", "service_id", "ts"), SERVICE, ORDER, rows_per_chunk
    )
    after = rows.look_around(1, {"next_ts": lambda w: F.lag("ts").over(w)}, ahead=True).done()
    return after.select(
        "sample_id", "service_id",
        elapsed_ms(F.col("ts"), F.col("next_ts")).alias("elapsed_ms"),
    )


def sample_lag(
    probes: DataFrame,
    interval: int = fixed.POLL_SECONDS,
    rows_per_chunk: int = sequence.ROWS_PER_CHUNK,
) -> DataFrame:
    """Gap to the previous sample and the polls that are missing in it."""
    rows = sequence.in_order(
        probes.select("sample_id", "service_id", "ts"), SERVICE, ORDER, rows_per_chunk
    )
    before = rows.look_around(1, {"prev_ts": lambda w: F.lag("ts").over(w)}).done()
    gap = micros(F.col("ts")) - micros(F.col("prev_ts"))
    missed = F.greatest(F.floor(gap / (interval * 1_000_000)) - 1, F.lit(0))
    return before.select(
        "sample_id", "service_id",
        gap.alias("gap_us"),
        F.when(gap.isNotNull(), missed).alias("missed_polls"),
    )


def rolling_latency(
    probes: DataFrame, n: int = 6, rows_per_chunk: int = sequence.ROWS_PER_CHUNK
) -> DataFrame:
    """Mean and maximum of the last n samples of the service."""
    rows = sequence.in_order(
        probes.select("sample_id", "service_id", "ts", "latency_ms"), SERVICE, ORDER, rows_per_chunk
    )
    frame = lambda w: w.rowsBetween(-(n - 1), 0)
    rolled = rows.look_around(
        n - 1,
        {
            "_sum": lambda w: F.sum(hundredths(F.col("latency_ms"))).over(frame(w)),
            "_n": lambda w: F.count("latency_ms").over(frame(w)),
            "max_ms": lambda w: F.max("latency_ms").over(frame(w)),
        },
    )
    return rolled.done().select(
        "sample_id", "service_id", (F.col("_sum") / F.col("_n") / 100).alias("mean_ms"), "max_ms"
    )


def timed_hundredths(ms: Column) -> Column:
    """Latency in whole hundredths from 0 to the time limit; a longer one counts as the
    limit, so there are 300,001 values at most."""
    within = F.least(F.greatest(hundredths(ms), F.lit(0)), F.lit(fixed.PROBE_TIMEOUT_MS * 100))
    return F.when(ms.isNotNull(), within).cast("bigint")


def _measures(exact: bool) -> list[Column]:
    # The exact percentile keeps a count per distinct value, whatever the number of rows.
    percentile = F.percentile if exact else F.approx_percentile
    p95 = percentile(timed_hundredths(F.col("latency_ms")), 0.95) / 100
    return [
        F.count(F.lit(1)).alias("samples"),
        (F.count_if("online") / F.count(F.lit(1))).alias("uptime"),
        mean_ms(F.col("latency_ms")).alias("mean_ms"),
        F.round(p95, 6).alias("p95_ms"),
        F.count_if(F.col("band") == "go").alias("go"),
        F.count_if(F.col("band") == "warn").alias("warn"),
        F.count_if(F.col("band") == "stop").alias("stop"),
    ]


#: Accuracy of quantile sketches, and what it costs: with 200 a quantile is off by less
#: than 0.0133 in rank with 99 % confidence, and a sketch holds some hundred values.
SKETCH_K = 200
RANK_ERROR = 0.0133


def health_sketches(probes: DataFrame, grain: str = "hour", k: int = SKETCH_K) -> DataFrame:
    """Per service and time grain, what can be merged into longer times: counts, a sum,
    and a quantile sketch of the latency. To be stored; (service_id, from, …)."""
    return probes.groupBy("service_id", F.date_trunc(grain, "ts").alias("from")).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if("online").alias("up"),
        F.count("latency_ms").alias("timed"),
        F.sum(hundredths(F.col("latency_ms"))).alias("sum"),
        F.kll_sketch_agg_bigint(timed_hundredths(F.col("latency_ms")), k).alias("sketch"),
    )


def merged_health(sketches: DataFrame, grain: str = "day", keys: tuple[str, ...] = ("service_id",)) -> DataFrame:
    """Samples, uptime and mean, as exact as over the samples, and the estimated 95th
    percentile, from stored sketches; without ``keys`` over all services. Up to ``SKETCH_K``
    latencies in a group it is a latency that was measured, at its exact rank."""
    whole = F.kll_merge_agg_bigint("sketch")
    return sketches.groupBy(*keys, F.date_trunc(grain, "from").alias(grain)).agg(
        F.sum("samples").alias("samples"),
        (F.sum("up") / F.sum("samples")).alias("uptime"),
        (F.sum("sum") / F.nullif(F.sum("timed"), F.lit(0)) / 100).alias("mean_ms"),
        F.when(F.sum("timed") > 0, F.kll_sketch_get_quantile_bigint(whole, F.lit(0.95)) / 100).alias("p95_ms"),
    )


def health_rollup(probes: DataFrame, grain: str = "hour", exact: bool = True) -> DataFrame:
    """Samples, uptime, latency and bands per service and time grain."""
    banded = probes.withColumn("band", latency_band(F.col("latency_ms")))
    return banded.groupBy("service_id", F.date_trunc(grain, "ts").alias(grain)).agg(
        *_measures(exact)
    )


def health_rollup_totals(probes: DataFrame) -> DataFrame:
    """Samples, uptime and mean per service and band, with both subtotals."""
    banded = probes.withColumn("band", latency_band(F.col("latency_ms")))
    return banded.rollup("service_id", "band").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("samples"),
        (F.count_if("online") / F.count(F.lit(1))).alias("uptime"),
        mean_ms(F.col("latency_ms")).alias("mean_ms"),
    )


def slowest_services(probes: DataFrame, k: int = 10) -> DataFrame:
    """The k services with the highest worst latency; ties by id."""
    worst = probes.groupBy("service_id").agg(F.max("latency_ms").alias("worst_ms"))
    return worst.orderBy(F.desc("worst_ms"), F.asc("service_id")).limit(k)

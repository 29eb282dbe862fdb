"""Rows that the shared tables do not have."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from hearthline.operators import health, search, vectors
from hearthline.sources import reports


def test_an_answer_without_a_latency_is_offline(spark):
    now = datetime.datetime(2024, 1, 1)
    raw = spark.createDataFrame([(1, 1, now, "200", None, "{}"), (2, 1, now, "200", 5.0, None)], "sample_id long, service_id long, ts timestamp, http_code string, latency_ms double, body string")
    assert [r.online for r in health.probe_outcome(raw).orderBy("sample_id").collect()] == [False, True]
    assert [r.online for r in health.probe_outcome(raw, require_json=True).orderBy("sample_id").collect()] == [False, False]


def test_results_without_a_key_are_no_copies(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "", "c"), (4, "u", "d"), (5, "u", "e")], "pos long, url string, engine string")
    assert search.dedup_results(rows, F.col("url"), "pos", "engine").count() == 4


def test_a_blank_line_in_front_is_no_header(spark):
    rows = spark.createDataFrame([("\nReport: 5.\nfree: 7.\n",)], "report string")
    assert [(r.key, r.value) for r in reports.read_counters(rows).collect()] == [("free", 7)]


def test_vectors_without_a_number_hide_no_hits():
    chance = np.random.default_rng(0)
    good, bad = chance.normal(size=(14, 4)), np.full((6, 4), np.nan)
    found = vectors._best(np.arange(1), good[:1], np.arange(20), np.concatenate([good, bad]), 6)
    assert found.num_rows == 6 and max(found.column("vec_id").to_pylist()) < 14

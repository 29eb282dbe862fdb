"""What the physical plans must and must not show."""

import re

import __spark_entry__ as entry_module
import pytest

# Queries of the operators for training text have their own tests.
QUERIES = {k: run for k, run in entry_module.queries().items() if not re.match(r"op\d+_|pipeline$", k)}
STREAMS = {k for k in QUERIES if k.startswith("stream_")}
WRITERS = {"registry_overwrite", "markdown_report", "dependency_closure"}
VECTORS = {"embedding_knn", "embedding_neighbours"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMS - WRITERS))
def test_no_pair_products_and_no_python(spark, sf_dir, key):
    text = plan(QUERIES[key](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text
    if key not in VECTORS:
        assert "Python" not in text and "InPandas" not in text and "InArrow" not in text


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMS - WRITERS - {"last_refresh"}))
def test_nothing_runs_through_one_task(spark, sf_dir, key):
    assert "SinglePartition" not in plan(QUERIES[key](spark, sf_dir))


def test_dedup_shuffles_once(spark, sf_dir):
    assert plan(QUERIES["result_dedup"](spark, sf_dir)).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("key", ["top_results", "render_results", "keyword_search", "wait_until_ready"])
def test_ranked_limits_start_in_the_map_tasks(spark, sf_dir, key):
    text = plan(QUERIES[key](spark, sf_dir))
    assert "row_number(), " in text and "Partial" in text.split("WindowGroupLimit", 1)[1]


NARROW = [
    "strip_thinking", "strip_thinking_sql", "assistant_filter", "strip_ws", "format_bytes", "search_academic", "search_news",
    "search_videos", "search_results_scan", "model_catalog_scan", "served_catalog_scan", "loaded_models_scan",
    "counter_report_scan", "column_report_scan", "skip_header", "kv_config_scan", "probe_outcome",
    "strict_probe_outcome", "search_filter", "result_block", "unified_catalog", "memory_summary",
]


@pytest.mark.parametrize("key", NARROW)
def test_projections_do_not_shuffle(spark, sf_dir, key):
    assert "Exchange" not in plan(QUERIES[key](spark, sf_dir))


@pytest.mark.parametrize("key", ["first_row", "admin_key_lookup", "slowest_services"])
def test_small_limits_take_ordered(spark, sf_dir, key):
    assert "TakeOrderedAndProject" in plan(QUERIES[key](spark, sf_dir))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["strip_thinking"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)]" in text
    text = plan(QUERIES["latest_status"](spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    text = plan(QUERIES["last_refresh"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text


def test_texts_stay_out_of_the_dedup_shuffle(spark, sf_dir):
    text = plan(QUERIES["result_dedup"](spark, sf_dir))
    above = text.split("Exchange")[0]
    assert "text" not in above

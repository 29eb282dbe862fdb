"""Registries, reports, sinks and graphs on hand-made rows."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from hearthline.operators import graph, models
from hearthline.operators import registry as r
from hearthline.sources import payloads, reports, sinks


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def closure_by_hand(edges):
    known = {}
    for start in {a for a, _ in edges}:
        depth, front = 0, {start}
        while front:
            depth += 1
            front = {b for a, b in edges if a in front and (start, b) not in known}
            known.update({(start, b): depth for b in front})
    return sorted((a, b, d) for (a, b), d in known.items())


@pytest.mark.parametrize("edges", [
    [("chat", "search"), ("chat", "stt"), ("chat", "tts"), ("search", "proxy")],
    [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")],
    [("a", "a")],
    [(f"n{i:02}", f"n{i + 1:02}") for i in range(21)],
    [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "e"), ("a", "b")],
])
def test_dependency_closure(spark, edges):
    df = spark.createDataFrame(edges, "svc string, dep string")
    assert rows(graph.dependency_closure(df)) == closure_by_hand(edges)


def reach(pairs):
    known = {a for p in pairs for a in p}
    out = {a: {b for x, b in pairs if x == a} for a in known}
    for _ in known:
        out = {a: bs | {c for b in bs for c in out[b]} for a, bs in out.items()}
    return out


def test_components_and_outages_of_random_graphs(spark):
    """Cycles inside cycles, chains between them, loops on one node, and acyclic parts."""
    rng = random.Random(6)
    for nodes, n in ((9, 12), (30, 45), (30, 25), (6, 20)):
        name = lambda i: f"s{i:02}"
        pairs = {(name(rng.randrange(nodes)), name(rng.randrange(nodes))) for _ in range(n)}
        df = spark.createDataFrame(sorted(pairs) + sorted(pairs)[:2], "svc string, dep string")
        to = reach(pairs)
        want = {a: min([a, *(b for b in to[a] if a in to[b])]) for a in to}
        members = graph.components(df).cache()
        assert dict(rows(members)) == want and members.count() == len(want)
        between = rows(graph.condensed(df, members))
        assert between == sorted({(want[a], want[b]) for a, b in pairs if want[a] != want[b]})
        acyclic = reach(between)
        assert all(a not in bs for a, bs in acyclic.items())
        failed = [name(0), name(1), "unknown"]
        depth, last = dict.fromkeys(failed, 0), set(failed)
        while last:
            last = {a for a, b in pairs if b in last and a not in depth}
            depth |= dict.fromkeys(last, max(depth.values()) + 1)
        hit = graph.hit_by_outage(df, spark.createDataFrame([(f,) for f in failed], "svc string"))
        assert dict(rows(hit)) == depth


def test_graphs_without_edges(spark):
    nothing = spark.createDataFrame([], "svc string, dep string")
    assert rows(graph.components(nothing)) == rows(graph.hit_by_outage(nothing, nothing.select("svc"))) == []
    loose = spark.createDataFrame([("a", None), (None, "b"), ("c", "c")], "svc string, dep string")
    assert rows(graph.components(loose)) == [("c", "c")]


def test_dependency_closure_of_nothing(spark):
    assert rows(graph.dependency_closure(spark.createDataFrame([], "svc string, dep string"))) == []


def test_overwrite_replaces_only_posted_lists(spark):
    path = folder()
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "owner int, name string")
    second = spark.createDataFrame([(1, "z")], "owner int, name string")
    sinks.write_registry(first, path, "owner")
    sinks.write_registry(second, path, "owner")
    once = rows(spark.read.parquet(path).select("owner", "name"))
    sinks.write_registry(second, path, "owner")
    assert once == rows(spark.read.parquet(path).select("owner", "name")) == [(1, "z"), (2, "c")]


def test_markdown_round_trip(spark):
    path = folder()
    answers = spark.createDataFrame([("news", "a\n\nb\n"), ("video", "c\n"), ("news", "")], "kind string, answer string")
    sinks.write_markdown(answers, path)
    assert rows(sinks.read_markdown(spark, path)) == sorted([("news", "a\n\nb\n"), ("video", "c\n"), ("news", "")])


def test_markdown_keeps_separators_inside_answers(spark):
    path = folder()
    hard = [("news", "a\x1eb"), ("news", "\x1aR \x1aS \x1a"), ("news", "\x1a\x1e\x1aS\x1e")]
    sinks.write_markdown(spark.createDataFrame(hard, "kind string, answer string"), path)
    assert rows(sinks.read_markdown(spark, path)) == sorted(hard)


def test_registry_json_parts(spark):
    df = spark.range(25).selectExpr("id % 2 AS owner", "id", "concat('u', id) AS url", "true AS enable", "'n' AS name")
    docs = sinks.registry_json(df, "owner", "id", ["enable"], ["name"], part_rows=10).collect()
    assert sorted((d["owner"], d["part"], d["parts"]) for d in docs) == [(0, 0, 2), (0, 1, 2), (1, 0, 2), (1, 1, 2)]
    body = json.loads(next(d["body"] for d in docs if d["owner"] == 1 and d["part"] == 0))
    assert [c["info"]["id"] for c in body["connections"]] == list(range(1, 21, 2))
    assert body["connections"][0] == {"url": "u1", "config": {"enable": True}, "info": {"id": 1, "name": "n"}}


def test_registry_json_with_text_keys_and_the_other_shape(spark):
    df = spark.createDataFrame([("o", k, True, True) for k in "cab"], "owner string, id string, enable boolean, enabled boolean")
    docs = sinks.registry_json(df, "owner", "id", ["enable"], [], name="servers", part_rows=2).orderBy("part").collect()
    assert [len(json.loads(d["body"])["servers"]) for d in docs] == [2, 1]
    assert json.loads(docs[1]["body"]) == {"servers": [{"enabled": True, "config": {"enable": True}}]}


def test_posts_replace_lists_when_whole(spark):
    path = folder()

    def post(number, listed, owners=None, take=None, part_rows=1):
        df = spark.createDataFrame(listed, "owner int, name string")
        of = owners and spark.createDataFrame([(o,) for o in owners], "owner int")
        parts = r.post_parts(df, "owner", "name", F.struct("name"), part_rows, of).withColumn("post", F.lit(number))
        sinks.append_parts(parts if take is None else parts.where(F.col("part").isin(*take)), path)
        return rows(sinks.newest_posts(spark.read.parquet(path), "owner"))

    first = [(1, "a"), (1, "b"), (2, "c"), (None, "lost")]
    assert post(1, first) == post(1, first) == [(1, "a"), (1, "b"), (2, "c")]
    assert post(2, [(1, "x"), (1, "y"), (1, "z")], take=[2, 0]) == [(1, "a"), (1, "b"), (2, "c")]
    assert post(2, [(1, "x"), (1, "y"), (1, "z")], take=[1]) == [(1, "x"), (1, "y"), (1, "z"), (2, "c")]
    assert post(3, [(1, "q")], owners=[1, 2]) == [(1, "q")]


def test_counter_report(spark):
    report = (
        "Mach: header 1.\nPages active:    12.\nno colon\nPages active: 15...\na: b: 3.\n"
        "Pages free: n/a\n  Pages wired down : 7\nPages speculative:\t1.5.\n:9")
    df = spark.createDataFrame([(1, report), (2, "only header: 5."), (3, None)], "report_id bigint, report string")
    assert rows(reports.read_counters(df)) == [
        (1, "", 9), (1, "Pages active", 15), (1, "Pages wired down", 7)]


def test_memory_summary_with_missing_counters(spark):
    counters = spark.createDataFrame([(1, "Pages active", 65536), (1, "Pages free", 5)], "report_id bigint, key string, value bigint")
    totals = spark.createDataFrame([(1, 16 * 1024**3), (2, 8 * 1024**3)], "report_id bigint, total_bytes bigint")
    assert rows(models.memory_summary(counters, totals)) == [(1, 16.0, 1.0, 15.0), (2, 8.0, 0.0, 8.0)]


def test_memory_within_the_row(spark):
    df = spark.createDataFrame(
        [(1, "head\nPages active: 65536.\nPages free: 5.", 16 * 1024**3), (2, "head", 8 * 1024**3), (3, None, 8 * 1024**3)],
        "report_id bigint, report string, total_bytes bigint")
    assert rows(models.memory_of_reports(df)) == [(1, 16.0, 1.0, 15.0), (2, 8.0, 0.0, 8.0), (3, 8.0, 0.0, 8.0)]


def test_column_report_and_files(spark):
    path = folder()
    with open(f"{path}/report.txt", "w") as f:
        f.write("NAME ID SIZE\nllama:3b  abc  2.0 GB  2 weeks ago\nshort x")
    got = reports.read_columns(reports.read_reports(spark, path)).select("line_no", "name", "size")
    assert rows(got) == [(2, "llama:3b", "2.0 GB"), (3, "short", " ")]


def test_key_must_begin_the_line(spark):
    lines = spark.createDataFrame(
        [(1, "API_KEY=a=b"), (2, "#API_KEY=x"), (3, "MY_API_KEY=y"), (4, "API_KEY_2=z"), (5, "none")], "n int, line string")
    assert rows(reports.read_kv(lines, "API_KEY")) == [(1, "API_KEY", "a=b")]
    assert len(rows(reports.read_kv(lines))) == 4


def test_catalog_payloads(spark):
    body = json.dumps({"models": [
        {"name": "llama3.2:3b", "model": "llama3.2:3b", "size": 2_000_000_000, "modified_at": "t", "digest": "d",
         "details": {"format": "gguf", "family": "llama", "families": [], "parameter_size": "3B", "quantization_level": ""}},
        {"name": "test:model", "size": 1_073_741_824}]})
    df = spark.createDataFrame([(1, body), (2, '{"models": []}'), (3, "oops")], "server bigint, payload string")
    flat = payloads.read_model_catalog(df)
    assert rows(models.model_rows(flat)) == [(1, "llama3.2:3b", "1.9 GB"), (1, "test:model", "1 GB")]
    servers = df.select("server")
    assert rows(models.model_count(servers, flat)) == [(1, 2), (2, 0), (3, 0)]


def test_loaded_models_default_size(spark):
    df = spark.createDataFrame([(1, '{"models":[{"name":"a"},{"name":"b","size_vram":5}]}'), (2, "{}")], "s int, payload string")
    assert rows(payloads.read_loaded_models(df)) == [(1, "a", 0), (1, "b", 5)]


def test_overlay_keeps_adds_and_overrides(spark):
    base = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "name string, v int, w string")
    over = spark.createDataFrame([("b", None, "y"), ("c", 3, None)], "name string, v int, w string")
    assert sorted(map(tuple, r.overlay(base, over, "name").collect())) == [("a", 1, None), ("b", 2, "y"), ("c", 3, None)]


def test_container_state(spark):
    df = spark.createDataFrame([("running",), ("exited",), ("",), (None,)], "s string")
    ok, shown = r.container_state(F.col("s"))
    assert [tuple(x) for x in df.select(ok, shown).collect()] == [
        (True, "ok"), (False, "exited"), (False, "not found"), (False, "not found")]


def test_engines(spark):
    engines = r.read_engines(spark.createDataFrame(
        [("g", False, ["general", "news"]), ("y", True, None), ("v", None, ["videos"])],
        "name string, disabled boolean, categories array<string>"))
    assert sorted(x[0] for x in r.enabled_engines(engines).select("name").collect()) == ["g", "v"]
    assert sorted(x[0] for x in r.engines_for(engines, "general").select("name").collect()) == ["g", "y"]
    hits = spark.createDataFrame([(1, "g"), (2, "y"), (3, "v"), (4, "zz")], "id int, engine string")
    assert rows(r.results_in_category(hits, engines, "news").select("id")) == [(1,)]

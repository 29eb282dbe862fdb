"""Search operators on hand-made rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthline.functions import text
from hearthline.operators import search as s
from hearthline.operators import word_index
from hearthline.sources.payloads import damaged_payloads, read_captures, read_search_results

PAYLOAD = """{"results": [
 {"title": "One", "content": " body ", "url": "u1", "engine": "e1", "publishedDate": "d1", "length": "1:00"},
 {"content": "", "url": "u2", "engine": "e2"},
 {"title": null, "url": "u3"}]}"""


def payloads(spark):
    return spark.createDataFrame(
        [(1, "q1", PAYLOAD), (2, "q2", "{}"), (3, "q3", '{"results": ['), (4, "q4", None)],
        "query_id bigint, q string, payload string")


def answers(spark, kind):
    return {r["query_id"]: r["answer"] for r in s.search(kind, payloads(spark)).collect()}


def test_academic_layout(spark):
    assert answers(spark, "academic")[1] == (
        "## Academic results for: q1\n\n"
        "**One**\n*via e1*\nbody\nSource: u1\n\n"
        "**No title**\n*via e2*\nSource: u2\n\n"
        "**No title**\n*via *\nSource: u3\n")


def test_news_hides_engine_without_date(spark):
    assert answers(spark, "news")[1] == (
        "## News results for: q1\n\n"
        "**One**\n*d1 — via e1*\nbody\nSource: u1\n\n"
        "**No title**\nSource: u2\n\n"
        "**No title**\nSource: u3\n")


def test_video_layout(spark):
    assert answers(spark, "video")[1] == (
        "## Video results for: q1\n\n"
        "**One**\n*e1 — 1:00*\nbody\nLink: u1\n\n"
        "**No title**\n*e2*\nLink: u2\n\n"
        "**No title**\n**\nLink: u3\n")


def test_no_results_and_damage_give_messages(spark):
    got = answers(spark, "video")
    assert got[2] == "No video results found for: q2"
    assert got[3] == got[4] == "Video search failed: the answer is no JSON object"


def test_captured_files_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(PAYLOAD)
    (tmp_path / "b.json").write_text("{}")
    files = read_captures(spark, str(tmp_path))
    assert files.count() == 2 and read_search_results(files).count() == 3
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "c.txt").write_text("{}\n" + PAYLOAD.replace("\n", " ") + "\n")
    lines = read_captures(spark, str(tmp_path / "lines"), per_line=True)
    assert lines.count() == 2 and read_search_results(lines).count() == 3


def test_scan_and_damaged(spark):
    rows = read_search_results(payloads(spark)).orderBy("pos").collect()
    assert [(r["query_id"], r["pos"], r["url"]) for r in rows] == [(1, 1, "u1"), (1, 2, "u2"), (1, 3, "u3")]
    assert sorted(r[0] for r in damaged_payloads(payloads(spark)).select("query_id").collect()) == [3, 4]


def test_at_most_six_in_received_order(spark):
    rows = spark.range(40).selectExpr("id % 3 AS query_id", "100 - id AS pos")
    got = s.top_results(rows).groupBy("query_id").agg(F.sort_array(F.collect_list("pos"))).collect()
    want = {k: sorted(100 - i for i in range(40) if i % 3 == k)[:6] for k in range(3)}
    assert {r[0]: r[1] for r in got} == want


def test_row_and_payload_forms_agree(spark):
    hits = read_search_results(payloads(spark))
    for kind in ("academic", "news", "video"):
        rendered = s.render_results(s.top_results(hits), kind).collect()
        assert {r[0]: r[1] for r in rendered} == {1: answers(spark, kind)[1]}


def test_keyword_search_by_brute_force(spark):
    import re

    docs = ["alpha beta gamma", "beta gamma delta beta", "ab cd ef", "Gamma, DELTA; alpha!", ""]
    asked = ["gamma beta", "delta alpha beta gamma", "none here", ""]
    words = lambda t: {w for w in re.split("[^a-z]+", t.lower()) if len(w) > 3}
    want = set()
    for q, text in enumerate(asked):
        scored = [(-len(words(text) & words(d)), i) for i, d in enumerate(docs)]
        want |= {(q, i, -n) for n, i in sorted(x for x in scored if x[0])[:2]}
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, q string")
    assert {(r["query_id"], r["doc_id"], r["score"]) for r in s.keyword_search(q, d, 2).collect()} == want


def plain_hits(docs, asked, k):
    """Scores of all pairs; rows with equal ids are one document."""
    import re

    words = lambda t: {w for w in re.split("[^a-z]+", (t or "").lower()) if len(w) > 3}
    want, held = set(), {}
    for i, t in docs:
        if i is not None:
            held[i] = held.get(i, set()) | words(t)
    for q, question in asked:
        scores = {i: n for i, own in held.items() if (n := len(words(question) & own))}
        for pos, (n, i) in enumerate(sorted((-n, i) for i, n in scores.items())[:k]):
            want.add((q, i, -n, pos + 1))
    return want


@pytest.mark.parametrize("list_rows", [5, 10**6])
def test_keyword_search_with_frequent_words_and_ties(spark, list_rows):
    """Frequent and rare words, many ties, long and empty texts, missing and equal ids; lists in parts and whole."""
    rng = random.Random(4)
    letters = "abcdefgh"
    vocabulary = ["".join(rng.choice(letters) for _ in range(4 + i % 3)) for i in range(120)]

    def prose(n):
        return " ".join(vocabulary[min(int(rng.expovariate(0.06)), 119)] for _ in range(n))

    docs = [(i, prose(rng.choice([0, 3, 8, 20, 60]))) for i in range(400)]
    docs += [(400, " ".join(vocabulary)), (401, None), (None, " ".join(vocabulary)), (7, prose(40)), (3, docs[3][1])]
    asked = [(i, prose(rng.choice([0, 1, 2, 5, 12, 30]))) for i in range(60)] + [(60, None), (61, "nothing here")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(asked, "query_id bigint, q string")
    for k in (1, 6):
        got = s.keyword_search(q, d, k, list_rows)
        assert {(r["query_id"], r["doc_id"], r["score"], r["pos"]) for r in got.collect()} == plain_hits(docs, asked, k)
    assert s.keyword_search(q, d.limit(0)).count() == s.keyword_search(q.limit(0), d).count() == 0


def test_hits_by_groups_equal_those_by_pairs(spark, monkeypatch):
    """Above ``pairs`` entries no pair of query and document is stored; ties, missing and equal ids as before."""
    rng = random.Random(6)
    vocabulary = ["word" + a + b for a in "abcdefgh" for b in "abcde"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 2, 9, 40])))) for i in range(300)]
    docs += [(300, None), (None, " ".join(vocabulary)), (7, " ".join(vocabulary[:9])), (3, docs[3][1])]
    asked = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 12])))) for i in range(50)] + [(50, None), (51, "nothing here")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame(asked, "query_id bigint, q string").select("query_id", text.tokens(F.col("q")).alias("words"))
    twice = q.unionByName(q.where("query_id % 3 = 0")).unionByName(q.limit(5).withColumn("query_id", F.lit(None).cast("bigint")))
    index = word_index.build(d)
    monkeypatch.setattr(word_index, "ENTRIES", 500)
    stored = []
    monkeypatch.setattr(word_index, "candidates", lambda *a: stored.append(a))
    for longest in (100, 2):  # with and without a score that is known in front
        got = word_index.best_hits(twice, index, 4, longest, pairs=0)
        assert {(r["query_id"], r["doc_id"], r["score"], r["pos"]) for r in got.collect()} == plain_hits(docs, asked, 4)
    assert not stored


def test_a_group_is_read_once_and_queries_pass_it_in_batches():
    """A task holds its documents and one batch of queries: hits of a batch are out before the next is taken."""
    kinds = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("terms", pa.list_(pa.int64())), ("floor", pa.int64())])
    words = {i: [j for j in range(20) if (i * 7 + j * j) % 5 < 2 or j == i] for i in range(20)}
    docs = [{"doc_id": i, "terms": own} for i, own in words.items()]
    asked = [{"query_id": i, "terms": sorted({i % 20, 3, 900 - i}), "floor": 2 if i % 2 else None} for i in range(60)]
    rows, taken = docs + asked, []

    def batches():  # the second one has documents and queries
        for a in range(0, len(rows), 15):
            taken.append(a)
            yield pa.RecordBatch.from_pylist(rows[a : a + 15], kinds)

    got, places = [], []
    for part in word_index._scored_group(batches(), 2):
        got += [tuple(r.values()) for r in part.to_pylist()]
        places.append(len(taken))
    want = []
    for q in asked:
        scores = sorted((-len(set(q["terms"]) & set(own)), i) for i, own in words.items())
        want += [(q["query_id"], i, -n) for n, i in scores[:2] if -n >= (q["floor"] or 1)]
    assert got == want and places == [2, 3, 4, 5, 6]
    assert not list(word_index._scored_group(iter([pa.RecordBatch.from_pylist(asked, kinds)]), 2))


def test_queries_and_documents_are_not_grouped_together(spark, monkeypatch):
    """Above ``pairs`` entries no task takes a whole group of queries, and documents move once."""
    d = spark.range(50).selectExpr("id AS doc_id", "concat('some words here ', if(id % 2 = 0, 'even', 'odds')) AS text")
    q = spark.range(20).selectExpr("id AS query_id", "array('even', 'here') AS words")
    monkeypatch.setattr(word_index, "ENTRIES", 40)
    got = word_index.best_hits(q, word_index.build(d), 3, pairs=0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and plan.count("MapInArrow") == 1
    assert sorted((r["query_id"], r["doc_id"], r["score"], r["pos"]) for r in got.collect()) == [
        (i, 2 * j, 2, j + 1) for i in range(20) for j in range(3)]


def test_frequent_lists_are_not_read(spark, sf_dir):
    """Candidates are far fewer than the pairs that share a word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("words"))
    index = word_index.build(docs)
    ranked = word_index.by_rarity(asked, index)
    shared = word_index.candidates(ranked, ranked.select("query_id", F.lit(1).alias("floor")).distinct(), index).count()
    known = word_index.floors(ranked, index, 6)
    assert word_index.candidates(ranked, known, index).count() < shared / 2


def test_dedup_counts_and_engines(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "a", "x"), (5, "b", "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, engine string")
    got = s.dedup_results(df, s.text_key(F.col("text")), "id", "engine").collect()
    assert sorted((r["id"], r["first_engine"], r["engines"], r["copies"]) for r in got) == [
        (1, "x", "x,y", 3), (3, "x", "x", 2)]


def test_dedup_keeps_one_row_per_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = s.dedup_results(docs, s.text_key(F.col("text")), "doc_id", "source")
    assert found.count() == docs.select("text").distinct().count()
    assert found.agg(F.sum("copies")).first()[0] == docs.count()


def test_url_key(spark):
    urls = ["http://www.A.com/Path/", "https://a.com/Path#x", "https://a.com/path", "http://a.com"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in df.select(s.url_key(F.col("u"))).collect()]
    assert got == ["a.com/Path", "a.com/Path", "a.com/path", "a.com"]


def test_grounding_takes_the_newest_user_turn(spark):
    chat = spark.createDataFrame(
        [(1, 0, "user", "alpha words"), (1, 1, "assistant", "beta words"), (1, 2, "user", "beta topic"),
         (2, 0, "user", "nothing"), (3, 0, "system", "alpha")],
        "conv_id bigint, turn bigint, role string, content string")
    docs = spark.createDataFrame(
        [(7, "beta text", "T7", "u7", "e"), (8, "alpha text", "T8", "u8", "e")],
        "doc_id bigint, text string, title string, url string, engine string")
    want = {
        1: "## Academic results for: beta topic\n\n**T7**\n*via e*\nbeta text\nSource: u7\n",
        2: "No academic results found for: nothing"}
    for list_rows in (1, 1000):
        got = s.web_grounding(chat, docs, list_rows=list_rows).collect()
        assert {r[0]: r[1] for r in got} == want


def test_grounding_of_repeated_documents_and_many_answers(spark, monkeypatch):
    """All rows of an id are shown; a document of many answers is rendered from copies; no task lists an answer's texts."""
    monkeypatch.setattr(s, "ANSWERS_PER_COPY", 4)
    chat = spark.createDataFrame(
        [(i, 0, "user", "alpha beta") for i in range(30)] + [(30, 0, "user", None), (None, 0, "user", "beta"), (31, 0, "user", "gamma")],
        "conv_id bigint, turn bigint, role string, content string")
    docs = spark.createDataFrame(
        [(7, "beta", "T7", "u7", "e"), (8, "alpha beta", "T8", "u8", "e"), (7, "alpha", "A7", "u7", "e"),
         (8, None, None, "u9", None), (9, "delta", "T9", "u9", "e"), (None, "alpha beta", "T", "u", "e")],
        "doc_id bigint, text string, title string, url string, engine string")
    monkeypatch.setattr(s, "ANSWER_BYTES", 500)
    found = s.web_grounding(chat, docs, k=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[query_id" in plan and "ObjectHashAggregate(keys=[query_id" not in plan
    assert "REPARTITION_BY_NUM" in plan  # parts grow in number with the answers
    body = "\n".join([
        "**A7**\n*via e*\nalpha\nSource: u7\n", "**T7**\n*via e*\nbeta\nSource: u7\n",
        "**No title**\n*via *\nSource: u9\n", "**T8**\n*via e*\nalpha beta\nSource: u8\n"])
    want = {i: f"## Academic results for: alpha beta\n\n{body}" for i in range(30)}
    want |= {30: None, None: "No academic results found for: beta", 31: "No academic results found for: gamma"}
    rows = found.collect()
    assert {r[0]: r[1] for r in rows} == want and len(rows) == len(want)

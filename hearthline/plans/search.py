"""Search answers, ranking and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import fixed
from hearthline.operators import search as s
from hearthline.operators import vectors
from hearthline.plans import views as v
from hearthline.plans.views import C, check
from hearthline.session import cut_lineage, fresh_dir
from hearthline.sources import payloads, sinks

K = fixed.RESULTS_PER_ANSWER
NL = "chr(10)"

# --- checks -------------------------------------------------------------------
# The layout of one result per kind, as SQL.
_TITLE = "'**' || coalesce(title, 'No title') || '**'"
_CONTENT = f"nullif(regexp_replace(content, '{v.OUTER_SPACE}', '', 'g'), '')"
_SECOND = {
    "academic": "'*via ' || engine || '*'",
    "news": "CASE WHEN coalesce(published, '') <> '' THEN '*' || published || ' — via ' || engine || '*' END",
    "video": "'*' || concat_ws(' — ', nullif(engine, ''), nullif(length, '')) || '*'",
}


def block_sql(kind: str) -> str:
    link = fixed.KINDS[kind]["link"]
    return f"concat_ws({NL}, {_TITLE}, {_SECOND[kind]}, {_CONTENT}, '{link}: ' || url || {NL})"


def answer_sql(kind: str) -> str:
    title = fixed.KINDS[kind]["title"]
    return (
        f"'## {title} results for: ' || q || {NL} || {NL} ||"
        f" string_agg({block_sql(kind)}, {NL} ORDER BY pos)"
    )


def answers_sql(kind: str) -> str:
    """Answer or empty message per captured payload."""
    noun, title = fixed.KINDS[kind]["noun"], fixed.KINDS[kind]["title"]
    return (
        f"SELECT p.page_id AS query_id, p.title AS q, coalesce(a.answer, CASE WHEN p.page_id % 11 = 5 THEN"
        f" '{title} search failed: {fixed.DAMAGED}' END,"
        f" 'No {noun} results found for: ' || p.title) AS answer FROM pages_parsed p LEFT JOIN"
        f" (SELECT query_id, {answer_sql(kind)} AS answer FROM hits WHERE pos <= {K}"
        " GROUP BY query_id, q) a ON p.page_id = a.query_id"
    )


WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z]+'), lambda t: length(t) > 3))"
SCORED = (
    "qw AS (SELECT query_id, unnest(" + WORDS.format("q") + ") AS word FROM asked),"
    " dw AS (SELECT doc_id, unnest(" + WORDS.format("text") + ") AS word FROM documents),"
    " scored AS (SELECT query_id, doc_id, count(*) AS score FROM dw JOIN qw USING (word) GROUP BY 1, 2),"
    " ranked AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS pos"
    f" FROM scored QUALIFY pos <= {K})"
)


# --- queries ------------------------------------------------------------------


def search_results_scan(spark, sf_dir):
    return payloads.read_search_results(v.search_payloads(spark, sf_dir))


def damaged_payloads(spark, sf_dir):
    return payloads.damaged_payloads(v.search_payloads(spark, sf_dir)).select("query_id")


def search_filter(spark, sf_dir):
    return s.search_filter(v.results(spark, sf_dir), "news")


def top_results(spark, sf_dir):
    return s.top_results(v.results(spark, sf_dir)).select("query_id", "pos", "rank", "url")


def result_block(spark, sf_dir):
    kinds = [s.row_block(kind).alias(kind) for kind in fixed.KINDS]
    return v.results(spark, sf_dir).select("pos", *kinds)


def render_results(spark, sf_dir):
    """Flagship: filter, first six per query, layout, ordered text per query."""
    found = s.search_filter(v.results(spark, sf_dir), fixed.KINDS["news"]["category"])
    return s.render_results(s.top_results(found), "news")


def search_table(spark, sf_dir):
    found = v.results(spark, sf_dir)
    return s.search_table("video", found.select("query_id", "q").distinct(), found)


def search_answer(kind):
    return lambda spark, sf_dir: s.search(kind, v.search_payloads(spark, sf_dir))


def empty_message(spark, sf_dir):
    b = v.table(spark, sf_dir, "benchmark")
    return b.select("item_id", *[s.empty_message(kind, C("text")).alias(kind) for kind in fixed.KINDS])


def empty_result_message(spark, sf_dir):
    asked = v.pages_parsed(spark, sf_dir).select(C("page_id").alias("query_id"), C("title").alias("q"))
    hits = payloads.read_search_results(v.search_payloads(spark, sf_dir))
    dated = hits.where(C("published").isNotNull())
    return s.with_empty_message(asked, dated, "news")


def result_dedup(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = s.dedup_results(docs, s.text_key(C("text")), "doc_id", "source")
    return found.withColumn("dedup_key", F.lower(F.hex("dedup_key")))


def result_dedup_url(spark, sf_dir):
    return s.dedup_results(v.results(spark, sf_dir), s.url_key(C("url")), "pos", "engine")


def distinct_engines(spark, sf_dir):
    return s.distinct_engines(v.results(spark, sf_dir))


def distinct_engines_merged(spark, sf_dir):
    """Engines and hosts per category from stored sketches per category and language:
    whether the estimates are within eight hundredths, five times their error."""
    rows = v.results(spark, sf_dir)
    stored = cut_lineage(s.engine_sketches(rows), "sketches")
    exact = rows.groupBy("category").agg(F.count_distinct("engine").alias("e"), F.count_distinct("query_id").alias("h"))
    both = s.merged_engines(stored, "category").join(exact, "category")
    return both.select("category", *[(F.abs(C(a) - C(b)) <= C(b) * 0.08).alias(a) for a, b in (("engines", "e"), ("hosts", "h"))])


def _docs(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "text",
        F.concat(F.lit("Document "), "doc_id").alias("title"),
        F.concat(F.lit("https://"), "source", F.lit("/"), "doc_id").alias("url"),
        C("source").alias("engine"),
    )


def keyword_search(spark, sf_dir):
    asked = v.table(spark, sf_dir, "benchmark").select(C("item_id").alias("query_id"), C("text").alias("q"))
    return s.keyword_search(asked, v.table(spark, sf_dir, "documents").select("doc_id", "text"))


def web_grounding(spark, sf_dir):
    talk = v.table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    return s.web_grounding(talk, _docs(spark, sf_dir))


def markdown_report(spark, sf_dir):
    """All kinds written as text folders and read back."""
    captured = v.search_payloads(spark, sf_dir)
    each = F.array(*[
        F.struct(F.lit(kind).alias("kind"),
                 s.answer_payload(kind, C("q"), C("payload")).alias("answer"))
        for kind in fixed.KINDS
    ])
    path = fresh_dir(spark, "markdown")
    sinks.write_markdown(captured.select(F.inline(each)), path)
    return sinks.read_markdown(spark, path)


def embedding_knn(spark, sf_dir):
    """The six vectors nearest to the middle of each label."""
    e = v.table(spark, sf_dir, "embeddings")
    hits = vectors.knn(vectors.centroids(e), e, K)
    return hits.select("query_id", "pos", "vec_id", "similarity")


def embedding_neighbours(spark, sf_dir):
    """Every vector as a query, over cells around pivots."""
    e = v.table(spark, sf_dir, "embeddings")
    asked = e.select(C("vec_id").alias("query_id"), "embedding")
    hits = vectors.knn(asked, e, K, query_block=256, vector_block=1_000, pivots=8)
    return hits.select("query_id", "pos", "vec_id", "similarity")


_RANK_VECTORS = (
    " pairs AS (SELECT query_id, vec_id, round(list_dot_product(q, x) / sqrt(list_dot_product(q, q))"
    " / sqrt(list_dot_product(x, x)), 9) AS similarity FROM asked, corpus),"
    " ranked AS (SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)"
    " AS INTEGER) AS pos, vec_id, similarity FROM pairs)"
    f" SELECT * FROM ranked WHERE pos <= {K}"
)
_CORPUS = "WITH corpus AS (SELECT vec_id, cast(label AS BIGINT) AS label, cast(embedding AS DOUBLE[]) AS x FROM embeddings),"

QUERIES = {
    "search_results_scan": (search_results_scan, check("SELECT * FROM hits", "hits")),
    "damaged_payloads": (damaged_payloads,
        "SELECT page_id AS query_id FROM pages WHERE page_id % 11 = 5"),
    "search_filter": (search_filter, check(
        "SELECT * FROM results WHERE category = 'news' AND language = 'en'", "results")),
    "top_results": (top_results, check(
        "SELECT query_id, pos, cast(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS rank, url"
        f" FROM results QUALIFY rank <= {K}", "results")),
    "result_block": (result_block, check(
        "SELECT pos, " + ", ".join(f"{block_sql(k)} AS {k}" for k in fixed.KINDS) + " FROM results",
        "results")),
    "render_results": (render_results, check(
        ", top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM results"
        f" WHERE category = 'news' AND language = 'en' QUALIFY rank <= {K})"
        f" SELECT query_id, {answer_sql('news')} AS answer FROM top GROUP BY query_id, q", "results")),
    "search_table": (search_table, check(
        ", top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM results"
        f" WHERE category = 'videos' AND language = 'en' QUALIFY rank <= {K}),"
        f" a AS (SELECT query_id, {answer_sql('video')} AS answer FROM top GROUP BY query_id, q)"
        " SELECT query_id, coalesce(answer, 'No video results found for: ' || query_id) AS answer"
        " FROM (SELECT DISTINCT query_id FROM results) LEFT JOIN a USING (query_id)", "results")),
    "search_academic": (search_answer("academic"), check(answers_sql("academic"), "hits")),
    "search_news": (search_answer("news"), check(answers_sql("news"), "hits")),
    "search_videos": (search_answer("video"), check(answers_sql("video"), "hits")),
    "empty_message": (empty_message,
        "SELECT item_id, " + ", ".join(
            f"'No {x['noun']} results found for: ' || text AS {k}" for k, x in fixed.KINDS.items())
        + " FROM benchmark"),
    "empty_result_message": (empty_result_message, check(
        ", n AS (SELECT query_id, count(*) AS hits FROM hits WHERE published IS NOT NULL GROUP BY 1)"
        " SELECT page_id AS query_id, coalesce(n.hits, 0) AS hits, CASE WHEN n.hits IS NULL THEN"
        " 'No news results found for: ' || title END AS message FROM pages_parsed"
        " LEFT JOIN n ON page_id = n.query_id", "hits")),
    "result_dedup": (result_dedup,
        "SELECT sha256(text) AS dedup_key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS first_engine,"
        " array_to_string(list_sort(list(DISTINCT source)), ',') AS engines, count(*) AS copies"
        " FROM documents GROUP BY text"),
    "result_dedup_url": (result_dedup_url, check(
        ", bare AS (SELECT *, regexp_replace(url, '^[a-zA-Z]+://(www\\.)?|#.*$', '', 'g') AS b FROM results),"
        " keyed AS (SELECT *, regexp_replace(lower(regexp_extract(b, '^[^/?]*')) ||"
        " regexp_replace(b, '^[^/?]*', ''), '/+$', '') AS k FROM bare)"
        " SELECT k AS dedup_key, min(pos) AS pos, arg_min(engine, pos) AS first_engine,"
        " array_to_string(list_sort(list(DISTINCT engine)), ',') AS engines, count(*) AS copies"
        " FROM keyed GROUP BY k", "results")),
    "distinct_engines": (distinct_engines, check(
        "SELECT category, language, count(DISTINCT engine) AS engines, count(DISTINCT query_id) AS hosts"
        " FROM results GROUP BY 1, 2", "results")),
    "distinct_engines_merged": (distinct_engines_merged, check(
        "SELECT DISTINCT category, true AS engines, true AS hosts FROM results", "results")),
    "keyword_search": (keyword_search,
        "WITH asked AS (SELECT item_id AS query_id, text AS q FROM benchmark), " + SCORED
        + " SELECT query_id, doc_id, score, pos FROM ranked"),
    "web_grounding": (web_grounding,
        "WITH asked AS (SELECT conv_id AS query_id, arg_max(text, turn) AS q FROM conversations"
        " WHERE role = 'user' GROUP BY 1), " + SCORED +
        ", shown AS (SELECT query_id, q, pos, 'Document ' || d.doc_id AS title, text AS content,"
        " 'https://' || source || '/' || d.doc_id AS url, source AS engine, '' AS published, '' AS length"
        " FROM ranked JOIN documents d USING (doc_id) JOIN asked USING (query_id)),"
        f" full_text AS (SELECT query_id, {answer_sql('academic')} AS context FROM shown GROUP BY query_id, q)"
        " SELECT query_id AS conv_id, coalesce(context, 'No academic results found for: ' || q) AS context"
        " FROM asked LEFT JOIN full_text USING (query_id)"),
    "markdown_report": (markdown_report, check(
        " UNION ALL ".join(
            f"SELECT '{k}' AS kind, answer FROM ({answers_sql(k)})" for k in fixed.KINDS), "hits")),
    "embedding_knn": (embedding_knn,
        _CORPUS + " axes AS (SELECT label, unnest(x) AS a, generate_subscripts(x, 1) AS i FROM corpus),"
        " means AS (SELECT label, i, cast(sum(cast(round(a * 1000000) AS BIGINT)) AS DOUBLE)"
        " / count(*) / 1000000 AS m FROM axes GROUP BY 1, 2),"
        " asked AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM means GROUP BY 1),"
        + _RANK_VECTORS),
    "embedding_neighbours": (embedding_neighbours,
        _CORPUS + " asked AS (SELECT vec_id AS query_id, x AS q FROM corpus)," + _RANK_VECTORS),
}

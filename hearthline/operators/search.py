"""Search results: filter, rank, deduplicate and render as model context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline import fixed
from hearthline.functions import text
from hearthline.operators import word_index
from hearthline.session import cut_lineage
from hearthline.sources.payloads import is_damaged, search_array

K = fixed.RESULTS_PER_ANSWER
#: Answers that are rendered from one copy of a document's text.
ANSWERS_PER_COPY = 1_000
#: Bytes of answers that are put together in one task.
ANSWER_BYTES = 128 << 20


def search_filter(results: DataFrame, category: str, language: str = fixed.LANGUAGE) -> DataFrame:
    return results.where((F.col("category") == category) & (F.col("language") == language))


def top_results(results: DataFrame, k: int = K, query: str = "query_id") -> DataFrame:
    """First k results per query in received order.

    The rank limit is applied in the map tasks first, so a hot query sends at
    most k rows per task to its reducer.
    """
    rank = F.row_number().over(W.partitionBy(query).orderBy("pos"))
    return results.withColumn("rank", rank).where(F.col("rank") <= k)


def result_block(
    kind: str, title: Column, content: Column, url: Column, engine: Column,
    published: Column, length: Column,
) -> Column:
    """One result as lines of Markdown, in the layout of its kind."""
    title = text.with_default(title, fixed.NO_TITLE)
    content = text.strip_ws(text.with_default(content, ""))
    url, engine, published, length = (
        text.with_default(c, "") for c in (url, engine, published, length)
    )
    # Second line of each kind; a null line is left out.
    second = {
        "academic": F.concat(F.lit("*via "), engine, F.lit("*")),
        "news": F.when(
            text.truthy(published),
            F.concat(F.lit("*"), published, F.lit(fixed.SEPARATOR + "via "), engine, F.lit("*")),
        ),
        "video": F.concat(F.lit("*"), text.join_nonempty(engine, length), F.lit("*")),
    }[kind]
    return F.concat_ws(
        "\n",
        F.concat(F.lit("**"), title, F.lit("**")),
        second,
        F.nullif(content, F.lit("")),
        F.concat(F.lit(fixed.KINDS[kind]["link"] + ": "), url, F.lit("\n")),
    )


def row_block(kind: str) -> Column:
    return result_block(
        kind, *[F.col(c) for c in ("title", "content", "url", "engine", "published", "length")]
    )


def header(kind: str, q: Column) -> Column:
    return F.concat(F.lit(f"## {fixed.KINDS[kind]['title']} results for: "), q, F.lit("\n"))


def empty_message(kind: str, q: Column) -> Column:
    return F.concat(F.lit(f"No {fixed.KINDS[kind]['noun']} results found for: "), q)


def failed_message(kind: str) -> Column:
    return F.lit(f"{fixed.KINDS[kind]['title']} search failed: {fixed.DAMAGED}")


def render_results(hits: DataFrame, kind: str, query: str = "query_id", q: str = "q") -> DataFrame:
    """One answer per query from already limited hits (``top_results``)."""
    blocks = F.array_sort(F.collect_list(F.struct("pos", row_block(kind).alias("block"))))
    answers = hits.groupBy(query).agg(F.first(q).alias(q), blocks.alias("blocks"))
    body = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n")
    return answers.select(
        query, F.concat(header(kind, F.col(q)), F.lit("\n"), body).alias("answer")
    )


def answer_payload(kind: str, q: Column, payload: Column, k: int = K) -> Column:
    """The answer for one captured payload, built inside its row."""
    found = F.slice(search_array(payload), 1, k)
    blocks = F.transform(
        found,
        lambda r: result_block(
            kind, r["title"], r["content"], r["url"], r["engine"], r["publishedDate"], r["length"]
        ),
    )
    full = F.concat(header(kind, q), F.lit("\n"), F.array_join(blocks, "\n"))
    return (
        F.when(F.size(found) > 0, full)
        .when(is_damaged(payload), failed_message(kind))
        .otherwise(empty_message(kind, q))
    )


def search(kind: str, payloads: DataFrame, q: str = "q", k: int = K) -> DataFrame:
    """Captured answers of one kind → rendered text; a projection, no shuffle."""
    keep = [c for c in payloads.columns if c != "payload"]
    return payloads.select(
        *keep, answer_payload(kind, F.col(q), F.col("payload"), k).alias("answer")
    )


def search_table(kind: str, queries: DataFrame, results: DataFrame, k: int = K) -> DataFrame:
    """Answers of one kind from flat results: filter, first k, layout, one text
    per query, and the fixed message for a query without results."""
    found = search_filter(results, fixed.KINDS[kind]["category"])
    answers = render_results(top_results(found, k), kind)
    return queries.join(answers, "query_id", "left").select(
        "query_id", F.coalesce("answer", empty_message(kind, F.col("q"))).alias("answer")
    )


def with_empty_message(
    queries: DataFrame, hits: DataFrame, kind: str, query: str = "query_id", q: str = "q"
) -> DataFrame:
    """Hit count per query, and the fixed message where there is none."""
    counts = hits.groupBy(query).agg(F.count(F.lit(1)).alias("hits"))
    n = F.coalesce("hits", F.lit(0))
    return queries.join(counts, query, "left").select(
        query, n.alias("hits"), F.when(n == 0, empty_message(kind, F.col(q))).alias("message")
    )


def dedup_results(results: DataFrame, key: Column, order: str, engine: str) -> DataFrame:
    """One row per distinct result: the first one, all its engines, its copies.

    One shuffle, and only key, order and engine reach it. Copies are combined in
    the map tasks, so a group of copies of any size arrives as one row per task,
    which holds no more than the distinct engines. A result without a key is no
    copy of another.
    """
    own = F.when(key.isNull() | (F.length(key) == 0), F.col(order))
    return results.groupBy(key.alias("dedup_key"), own.alias("keyless")).agg(
        F.min(order).alias(order),
        F.min_by(engine, order).alias("first_engine"),
        F.array_join(F.array_sort(F.collect_set(engine)), ",").alias("engines"),
        F.count(F.lit(1)).alias("copies"),
    ).drop("keyless")


def text_key(c: Column) -> Column:
    """32 bytes that stand for a whole text."""
    return F.unhex(F.sha2(c, 256))


def url_key(url: Column) -> Column:
    """URL without scheme, ``www.``, fragment and trailing slash; lower-case host."""
    bare = F.regexp_replace(url, r"^[a-zA-Z]+://(www\.)?|#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    return F.regexp_replace(F.concat(host, rest), "/+$", "")


def distinct_engines(results: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct engines and hosts per category and language."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return results.groupBy("category", "language").agg(
        count("engine").alias("engines"), count(text.url_host(F.col("url"))).alias("hosts")
    )


def engine_sketches(results: DataFrame) -> DataFrame:
    """Distinct engines and hosts per category and language as sketches, to be stored and
    merged; an estimate from them is off by 1.6 % in two of three cases."""

    def sketch(c: Column) -> Column:  # of hashes, as sketches take no empty text
        return F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)))

    return results.groupBy("category", "language").agg(
        sketch(F.col("engine")).alias("engines"), sketch(text.url_host(F.col("url"))).alias("hosts")
    )


def merged_engines(sketches: DataFrame, *keys: str) -> DataFrame:
    """Estimated numbers of distinct engines and hosts per ``keys``."""
    return sketches.groupBy(*keys).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("engines", "hosts")])


def keyword_search(
    queries: DataFrame, docs: DataFrame, k: int = K, list_rows: int = word_index.LIST_ROWS
) -> DataFrame:
    """Documents per query by shared distinct words, ties by id, best k.

    ``queries`` has (query_id, q), ``docs`` has (doc_id, text). Exact, over an index of
    the words that are asked for (``word_index``).
    """
    asked = queries.select("query_id", text.tokens(F.col("q")).alias("words")).where(F.size("words") > 0)
    asked = cut_lineage(asked, "asked")
    wanted = cut_lineage(asked.select(F.explode("words").alias("word")).distinct(), "wanted")
    return word_index.best_hits(asked, word_index.build(docs, wanted, list_rows), k)


def latest_user_turn(chat: DataFrame) -> DataFrame:
    """What each conversation asks now: its newest user message."""
    return (
        chat.where(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.max_by("content", "turn").alias("q"))
    )


def web_grounding(
    chat: DataFrame,
    docs: DataFrame,
    kind: str = "academic",
    k: int = K,
    list_rows: int = word_index.LIST_ROWS,
) -> DataFrame:
    """Context block per conversation: the newest user turn and its best hits.

    ``docs`` has (doc_id, text, title, url, engine).
    """
    asked = cut_lineage(latest_user_turn(chat).withColumnRenamed("conv_id", "query_id"))
    # At most k short rows per conversation; stored, so that their size is known.
    hits = cut_lineage(keyword_search(asked, docs, k, list_rows).select("query_id", "doc_id", "pos"), "hits")
    blocks = _spread_blocks(hits, docs, kind)
    # A value per place and not a list: rows are sorted on disk where memory ends, and a task
    # holds the texts of one answer.
    places = [F.max(F.when(F.col("pos") == i + 1, F.col("block"))) for i in range(k)]
    bodies = blocks.groupBy("query_id").agg(F.concat_ws("\n", *places).alias("body"))
    full = F.concat(header(kind, F.col("q")), F.lit("\n"), F.col("body"))
    return asked.join(bodies, "query_id", "left").select(
        F.col("query_id").alias("conv_id"),
        F.when(F.col("body").isNull(), empty_message(kind, F.col("q")))
        .otherwise(full)
        .alias("context"),
    )


def _spread_blocks(hits: DataFrame, docs: DataFrame, kind: str) -> DataFrame:
    """(query_id, pos, block): each hit (query_id, doc_id, pos) with the text of its document,
    of all rows with its id. A document of many answers is copied, so that no task reads them
    all. Dealt by query, in as many parts as the answers are large."""
    counts = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("answers"))
    shown = cut_lineage(counts.withColumn("copies", F.ceil(F.col("answers") / ANSWERS_PER_COPY)), "shown")
    rows = docs.withColumnRenamed("text", "content").withColumns({"published": F.lit(""), "length": F.lit("")})
    lines = F.array_join(F.array_sort(F.collect_list(row_block(kind))), "\n")
    texts = cut_lineage(rows.join(shown, "doc_id").groupBy("doc_id", "answers", "copies").agg(lines.alias("block")), "texts")
    copies = texts.select("doc_id", "block", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    placed = hits.join(shown, "doc_id").withColumn("copy", F.pmod(F.xxhash64("query_id"), "copies") + 1)
    blocks = copies.join(placed.hint("merge"), ["doc_id", "copy"]).select("query_id", "pos", "block")
    total = texts.agg(F.sum(F.octet_length("block") * F.col("answers"))).first()[0] or 0
    usual, needed = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ANSWER_BYTES)
    return blocks.repartition(needed, "query_id") if needed > usual else blocks.repartition("query_id")

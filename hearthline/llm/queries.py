"""Queries of the operators over the shared tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import chat_parts, decontam, hmm, language, near_dup, pieces, prefix_free, quality_lines, reshard, secret_grammar, va_clusters, warc_derive, word_runs
from hearthline.session import prepare

#: Model file of the piece vocabulary, read on the driver; None takes the installed public one.
PIECE_MODEL: str | None = None


def piece_vocabulary(path: str | None = None) -> pieces.Vocabulary:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.load(path)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and whether they decode to the text."""
    return pieces.round_trip(_table(spark, sf_dir, "documents"), piece_vocabulary(PIECE_MODEL))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    parts = rows.unionByName(added).select("conv_id", "turn", "role", chat_parts.text_part(F.col("text")).alias("parts"))
    return chat_parts.digests(chat_parts.format_conversations(parts))


_OP4_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, length(role) + length(replace(replace(role, '\', '\b'), '<', '\l')) - length(role)
        + length(replace(replace(text, '\', '\b'), '<', '\l')) + 19 AS shown FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivative records of all pages, taken as responses."""
    return warc_derive.derive(warc_derive.responses_of(_table(spark, sf_dir, "pages")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every benchmark item that a text covers by half or more."""
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tiles", "longest", "covered", "item_words", "coverage")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_grammar.scan(_table(spark, sf_dir, "documents"))


def op9_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, checksum and place of every row, read back from the shards' files."""
    rows = reshard.reshard(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return rows.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(_table(spark, sf_dir, "documents"))


def op11_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 200-byte strings that also start elsewhere."""
    return prefix_free.remove_repeats(_table(spark, sf_dir, "documents"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every text, with a stretch repeated in every tenth."""
    return word_runs.runs(_table(spark, sf_dir, "documents"))


def op13_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_clusters.clusters(_table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """The rounds one after another, every vector against every centroid."""

    def nearest(n: int) -> str:
        distance = "list_sum([(k.v[i] - c.v[i]) * (k.v[i] - c.v[i]) for i in range(1, 65)])"
        return (
            f"a{n} AS MATERIALIZED (SELECT k.pos, min(struct_pack(d := CAST({distance} AS BIGINT), c := c.c)) AS best"
            f" FROM kept k, c{n} c GROUP BY k.pos)"
        )

    def moved(n: int) -> str:
        return (
            f"s{n} AS (SELECT best.c AS c, i, sum(k.v[i]) AS s, count(*) AS m FROM a{n} JOIN kept k USING (pos),"
            f" range(1, 65) r(i) GROUP BY 1, 2), f{n} AS (SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY i) AS v FROM s{n} GROUP BY c),"
            f" c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce([CAST(x AS BIGINT) for x in f.v], o.v) AS v FROM c{n} o LEFT JOIN f{n} f ON o.c = f.c)"
        )

    steps = ", ".join(f"{nearest(n)}, {moved(n)}" for n in range(va_clusters.ROUNDS)) + ", " + nearest(va_clusters.ROUNDS)
    last = f"{va_clusters.ROUNDS}"
    return (
        "WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS pos, vec_id,"
        " [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),"
        " c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v"
        f" FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {va_clusters.CENTROIDS})), {steps}"
        f" SELECT k.vec_id, CAST(best.c AS INT) AS cluster, best.d AS distance,"
        " CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a{last} a JOIN kept k USING (pos) JOIN c{last} f ON f.c = best.c"
    )


QUERIES = {
    "op1_sentencepiece": (op1_sentencepiece, None),
    "op2_language": (op2_language, None),
    "op3_near_dup": (op3_near_dup, None),
    "op4_chat": (op4_chat, _OP4_SQL),
    "op5_warc": (op5_warc, None),
    "op6_decontaminate": (op6_decontaminate, None),
    "op7_quality": (op7_quality, None),
    "op8_secrets": (op8_secrets, None),
    "op9_reshard": (op9_reshard, None),
    "op10_language_model": (op10_language_model, None),
    "op11_prefix_free": (op11_prefix_free, None),
    "op12_word_runs": (op12_word_runs, None),
    "op13_va_clusters": (op13_va_clusters, _op13_sql()),
}

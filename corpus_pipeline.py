"""A corpus from raw documents to token ids, in five stages.

Each stage takes all that its predecessor kept and returns documents again, but for
the last, which returns token ids. Every stage is written as Parquet below the folder
in ``spark.checkpoint.dir`` and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import decontam, language, near_dup, pieces, queries, secret_grammar
from hearthline.session import cut_lineage, prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is known; texts without letters and those that fit none go."""
    model = language.train(docs.where(~language.in_fold(5)))
    known = language.predict(docs.select(*COLUMNS), model, COLUMNS)
    return known.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= language.MIN_SCORE)).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows without an id stay only where their group has no other; of repeated rows one
    stays. Documents without words are linked with nothing and all stay.
    """
    rows = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    best = near_dup.representatives(docs).withColumnRenamed("doc_id", "kept_id").withColumnRenamed("text_key", "kept_key")
    best = cut_lineage(best, "representatives")
    chosen = rows.join(best, rows["doc_id"].eqNullSafe(best["kept_id"]) & (rows["text_key"] == best["kept_key"])).select(*rows.columns, "copies")
    alone = chosen.where("copies = 1").select(*COLUMNS)
    repeated = chosen.where("copies > 1").groupBy("doc_id", "text_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    wordless = docs.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)
    return alone.union(repeated).union(wordless)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than half of every benchmark item; rows are told apart by id and text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.contaminated(docs, benchmark).select("row_key").distinct()
    return docs.select(*COLUMNS).withColumn("row_key", decontam.row_key()).join(found, "row_key", "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts give way to the name of their kind."""
    found = secret_grammar.find(docs.select(*COLUMNS), secret_grammar.train(docs), COLUMNS, redact=True)
    changed = F.col("spans") != ""
    return found.withColumns(
        {"text": F.when(changed, F.col("redacted")).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars"))}
    ).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    return pieces.round_trip(docs, queries.piece_vocabulary(queries.PIECE_MODEL))


STAGES = [
    ("language ID", by_language),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("pieces", to_pieces),
]

#: The stages learn models and search by hashes, which SQL does not express; tests hold them against planted cases and, near duplicates, brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

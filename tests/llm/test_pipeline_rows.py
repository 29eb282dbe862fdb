"""Rows of the pipeline's stages: missing and repeated ids, repeated rows, texts without words, empty tables."""

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (words(x) for x in "abcd")
    rows = [(1, a), (None, a), (None, b), (None, b), (5, c), (7, d), (7, d)]
    kept = corpus_pipeline.without_near_duplicates(spark, table(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, b), (1, a), (5, c), (7, d)]


def test_rows_with_one_id_are_told_apart(spark):
    a, near, b = words("a"), words("a", 39), words("b")
    rows = [(1, a), (1, b), (1, near), (2, a), (3, None), (4, " "), (3, None)]
    kept = corpus_pipeline.without_near_duplicates(spark, table(spark, rows), "").collect()
    # Of the group (a, near) the row of id 1 with the smaller hash of its text stays.
    assert sum(r.text in (a, near) for r in kept) == 1
    rest = sorted((r.doc_id, r.text or "") for r in kept if r.text not in (a, near))
    assert rest == [(1, b), (3, ""), (3, ""), (4, " ")]
    assert corpus_pipeline.without_near_duplicates(spark, table(spark, []), "").count() == 0


def test_clean_rows_that_share_an_id_with_a_contaminated_one_stay(spark, tmp_path):
    item, clean = words("q", 60), words("c", 60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(8, f"x {item} y"), (8, clean), (42, clean), (None, f"z {item}"), (None, None), (None, clean)]
    kept = corpus_pipeline.without_benchmark(spark, table(spark, rows).withColumn("row_key", F.lit("own")), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, clean), (8, clean), (42, clean)]
    assert corpus_pipeline.without_benchmark(spark, table(spark, []), str(tmp_path)).count() == 0

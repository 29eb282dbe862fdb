"""Re-runnable writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators.registry import PART_ROWS, post_parts

RECORD_END = "\x1e"


_ESCAPE = "\x1a"


def append_parts(parts: DataFrame, path: str) -> None:
    """Log parts of posted lists (owner, post, part, parts, entries).

    A later post of an owner has a greater number. A part is one row, so it never
    spans two batches, and ``newest_posts`` reads a part that was logged twice once.
    """
    parts.write.mode("append").parquet(path)


def whole_posts(logged: DataFrame, owner: str) -> DataFrame:
    """(owner, post): per owner the newest post all of whose parts have come."""
    return (
        logged.groupBy(owner, "post")
        .agg(F.count_distinct("part").alias("_come"), F.max("parts").alias("_due"))
        .where("_come = _due")
        .groupBy(owner)
        .agg(F.max("post").alias("post"))
    )


def newest_posts(logged: DataFrame, owner: str) -> DataFrame:
    """Per owner the entries of the newest post all of whose parts have come.

    Owners that never posted keep nothing, an empty post leaves no row, and until
    a post is whole the one before it stays. Rows without an owner are left out.
    """
    kept = logged.join(whole_posts(logged, owner), [owner, "post"], "left_semi")
    return kept.dropDuplicates([owner, "post", "part"]).select(owner, F.inline("entries"))


def write_registry(rows: DataFrame, path: str, owner: str) -> None:
    """Post registry rows in one go: each owner's list replaces the stored one.

    Owners without rows here keep theirs, so a list cannot be emptied and must not
    be spread over several calls (``append_parts`` takes both). Posting twice changes
    nothing. The rebalance hint gathers an owner's rows into few files and still
    splits an owner that is too big for one task.
    """
    (
        rows.hint("rebalance", F.col(owner))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(owner)
        .parquet(path)
    )


def write_markdown(answers: DataFrame, path: str, kind: str = "kind", text: str = "answer") -> None:
    """Answers as text, one folder per kind; answers hold newlines, so a record
    separator ends each one; a separator inside an answer is escaped."""
    own = F.replace(F.replace(F.col(text), F.lit(_ESCAPE), F.lit(_ESCAPE + "S")), F.lit(RECORD_END), F.lit(_ESCAPE + "R"))
    (
        answers.select(kind, own.alias(text))
        .write.mode("overwrite")
        .option("lineSep", RECORD_END)
        .partitionBy(kind)
        .text(path)
    )


def read_markdown(spark, path: str, kind: str = "kind", text: str = "answer") -> DataFrame:
    stored = spark.read.schema(f"value string, {kind} string").option("lineSep", RECORD_END)
    own = F.replace(F.replace(F.col("value"), F.lit(_ESCAPE + "R"), F.lit(RECORD_END)), F.lit(_ESCAPE + "S"), F.lit(_ESCAPE))
    return stored.text(path).select(kind, own.alias(text))


def registry_json(
    rows: DataFrame,
    owner: str,
    order: str,
    config: list[str],
    info: list[str],
    part_rows: int = PART_ROWS,
    name: str = "connections",
) -> DataFrame:
    """Registry rows as JSON documents ``{name: [connection, …]}``, ready to post.

    An owner's list comes in numbered parts of at most ``part_rows`` connections by
    rank, with the number of parts beside each; the stored list is to be replaced
    when all are there. Without ``info`` a connection has no such object.
    """
    flat = [c for c in rows.columns if c not in {owner, order, *config, *info}]
    nested = [F.struct(*config).alias("config")]
    if info:
        nested.append(F.struct(order, *info).alias("info"))
    parts = post_parts(rows, owner, order, F.struct(*flat, *nested), part_rows)
    return parts.select(owner, "part", "parts", F.to_json(F.struct(F.col("entries").alias(name))).alias("body"))

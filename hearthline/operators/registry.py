"""Lookups, overlays and inventories over service, engine and model registries.

A stored registry needs no broadcast hint: Catalyst broadcasts it while its
measured size is below ``spark.sql.autoBroadcastJoinThreshold``, and above it
shuffles, where adaptive execution splits skewed keys. A computed one is counted
first (``sizes.small_side``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import fixed
from hearthline.functions.text import truthy
from hearthline.operators import sequence
from hearthline.operators.sizes import small_side

#: Most entries in one part of a posted list.
PART_ROWS = 1000


def first_row(df: DataFrame, *order: str) -> DataFrame:
    """The first row in a total order; each task keeps one row."""
    return df.orderBy(*order).limit(1)


def key_lookup(keys: DataFrame, users: DataFrame, role: str) -> DataFrame:
    """The first key held by a user of ``role``.

    ``keys`` has (key, user_id), ``users`` has (id, role).
    """
    held = keys.join(users.where(F.col("role") == role), keys["user_id"] == users["id"])
    return first_row(held.select("key", "user_id", "role"), "key")


def registry_lookup(ids: DataFrame, registry: DataFrame, key: str = "id") -> DataFrame:
    """The registry row for each id; an unknown id stays with status 404.

    Ids in ``registry`` must be distinct, or rows multiply.
    """
    known = registry.withColumn("_known", F.lit(True))
    return (
        ids.join(known, key, "left")
        .withColumn("status", F.when(F.col("_known").isNull(), 404).otherwise(200))
        .drop("_known")
    )


def unknown_ids(ids: DataFrame, registry: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(registry, key, "left_anti")


def with_override(
    registry: DataFrame, overrides: DataFrame, column: str, default: str, key: str = "id"
) -> DataFrame:
    """Override beats registry value beats literal default."""
    over = overrides.select(key, F.col(column).alias("_over"))
    return (
        registry.join(over, key, "left")
        .withColumn(column, F.coalesce("_over", column, F.lit(default)))
        .drop("_over")
    )


def overlay(defaults: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Local settings over defaults; unlisted rows stay, new rows are added."""
    columns = [c for c in defaults.columns if c != key]
    over = overrides.select(key, *[F.col(c).alias("_o_" + c) for c in columns])
    return defaults.join(over, key, "full_outer").select(
        key, *[F.coalesce("_o_" + c, c).alias(c) for c in columns]
    )


def inventory_check(expected: DataFrame, actual: DataFrame, key: str = "id") -> DataFrame:
    """Every expected id with its observed state; missing ones keep a null."""
    return expected.join(actual, key, "left")


def container_state(state: Column) -> tuple[Column, Column]:
    """(ok, shown text) for an observed state."""
    ok = F.coalesce(state == "running", F.lit(False))
    shown = F.when(ok, "ok").when(truthy(state), state).otherwise("not found")
    return ok, shown


def inventory_missing(listed: DataFrame, monitored: DataFrame) -> DataFrame:
    """Listed but not monitored; each side is made distinct in the map tasks first."""
    return listed.distinct().subtract(monitored.distinct())


def inventory_common(listed: DataFrame, monitored: DataFrame) -> DataFrame:
    return listed.distinct().intersect(monitored.distinct())


def read_engines(rows: DataFrame) -> DataFrame:
    """Engine rows with a missing flag as enabled and missing categories as general."""
    return rows.select(
        "name",
        F.coalesce("disabled", F.lit(False)).alias("disabled"),
        F.coalesce("categories", F.array(F.lit("general"))).alias("categories"),
    )


def enabled_engines(engines: DataFrame) -> DataFrame:
    return engines.where(~F.col("disabled"))


def engines_for(engines: DataFrame, *categories: str) -> DataFrame:
    """Engines that serve at least one of the categories."""
    wanted = F.array(*[F.lit(c) for c in categories])
    return engines.where(F.arrays_overlap("categories", wanted))


def results_in_category(results: DataFrame, engines: DataFrame, category: str) -> DataFrame:
    """Results whose engine is enabled and serves the category."""
    serving = (
        enabled_engines(engines)
        .select("name", F.explode("categories").alias("served"))
        .where(F.col("served") == category)
        .select(F.col("name").alias("engine"))
    )
    return results.join(small_side(serving), "engine", "left_semi")


def with_position(
    registry: DataFrame, owner: str, order: str, rows_per_chunk: int = sequence.ROWS_PER_CHUNK
) -> DataFrame:
    """Index from 0 in each owner's list, and the card delay that follows from it."""
    placed = sequence.in_order(registry, [owner], [order], rows_per_chunk).running_count(F.lit(True), "_at")
    index = F.col("_at") - 1
    return placed.done().select(
        *registry.columns,
        index.alias("position"),
        (index * fixed.CARD_STAGGER_MS).alias("delay_ms"),
    )


def post_parts(
    rows: DataFrame,
    owner: str,
    order: str,
    entry: Column,
    part_rows: int = PART_ROWS,
    owners: DataFrame | None = None,
    rows_per_chunk: int = sequence.ROWS_PER_CHUNK,
) -> DataFrame:
    """Each owner's list by rank in numbered parts: owner, part, parts, entries.

    A part holds at most ``part_rows`` entries, whatever the key. An owner in
    ``owners`` without rows posts an empty list. Rows without an owner post nothing.
    Ranks and sizes come from one scan, and parts are gathered where ranks were given.
    """
    named = rows.where(F.col(owner).isNotNull())
    placed = sequence.in_order(named, [owner], [order], rows_per_chunk).running_count(F.lit(True), "_at", "_size").done()
    part = F.floor((F.col("_at") - 1) / part_rows).cast("int")
    parts = F.ceil(F.col("_size") / part_rows).cast("int")
    cut = placed.groupBy(owner, part.alias("part")).agg(
        F.max(parts).alias("parts"), F.array_sort(F.collect_list(F.struct("_at", entry.alias("entry")))).alias("placed")
    )
    filled = cut.select(owner, "part", "parts", F.transform("placed", lambda e: e["entry"]).alias("entries"))
    if owners is None:
        return filled
    silent = owners.select(owner).where(F.col(owner).isNotNull()).distinct().join(named.select(owner), owner, "left_anti")
    none = F.from_json(F.lit("[]"), filled.schema["entries"].dataType)
    return filled.unionByName(
        silent.select(owner, F.lit(0).alias("part"), F.lit(1).alias("parts"), none.alias("entries"))
    )

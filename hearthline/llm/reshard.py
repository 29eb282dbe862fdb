"""Resharding by minimum-cost flow.

Rows lie in old shards by hash. From the old shards' bytes and equal new capacities
a flow is solved that moves the fewest bytes. It becomes block transfers: each old
shard is a line of rows in hash order, cut where the flow ends, so a transfer is a
range of hashes and the rows need no join to find their shard. Only shards that gain
or lose rows are written anew.

A row's size is its text's UTF-8 bytes plus 8; a null text has none. Repeated rows
are numbered, so each has a hash of its own and any number of them can be parted; null
ids are spread by their text. Further columns of the input are carried into the files,
whatever their names, but for those named shard or slot, which give way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.session import cut_lineage, fresh_dir

OLD_SHARDS = 16
NEW_SHARDS = 24
#: Hash ranges per old shard whose sizes are gathered: OLD_SHARDS * BLOCKS rows, whatever the table.
BLOCK_BITS = 10
#: Text bytes per written file.
FILE_BYTES = 128 << 20
#: Copies of a row that one task makes.
CHUNK = 10000


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost) -> list[list[int]]:
    """Flow from sources to sinks, all supply sent, by successive shortest paths."""
    n, m = len(supply), len(capacity)
    start, end = n + m, n + m + 1
    arcs: list[list[int]] = []  # from, to, room, cost; arc k ^ 1 is the way back
    leaving: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, price: int) -> int:
        for x, y, r, p in ((a, b, room, price), (b, a, 0, -price)):
            leaving[x].append(len(arcs))
            arcs.append([x, y, r, p])
        return len(arcs) - 2

    for i, x in enumerate(supply):
        arc(start, i, x, 0)
    for j, x in enumerate(capacity):
        arc(n + j, end, x, 0)
    used = [[arc(i, n + j, min(supply[i], capacity[j]), cost(i, j)) for j in range(m)] for i in range(n)]
    while True:
        best, came = [math.inf] * (n + m + 2), [-1] * (n + m + 2)
        best[start] = 0
        queue = [start]
        while queue:
            later = []
            for x in queue:
                for k in leaving[x]:
                    _, y, room, price = arcs[k]
                    if room and best[x] + price < best[y]:
                        best[y], came[y] = best[x] + price, k
                        later.append(y)
            queue = later
        if best[end] == math.inf:
            break
        path, x = [], end
        while x != start:
            path.append(came[x])
            x = arcs[came[x]][0]
        room = min(arcs[k][2] for k in path)
        for k in path:
            arcs[k][2] -= room
            arcs[k ^ 1][2] += room
    return [[arcs[used[i][j] ^ 1][2] for j in range(m)] for i in range(n)]


@dataclass
class Plan:
    """flow[i][j]: bytes from old shard i to new shard j; cuts: per old shard (first order key, new shard)."""

    flow: list[list[int]]
    cuts: list[list[tuple[int, int]]]
    total: int

    @property
    def moved(self) -> int:
        return sum(x for i, row in enumerate(self.flow) for j, x in enumerate(row) if i != j)

    @property
    def affected(self) -> list[int]:
        old, new = len(self.flow), len(self.flow[0])
        gains = [any(self.flow[i][j] for i in range(old) if i != j) for j in range(new)]
        loses = [any(self.flow[j][k] for k in range(new) if k != j) if j < old else False for j in range(new)]
        return [j for j in range(new) if gains[j] or loses[j]]


def _order_key(number: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64("name", number), 1)


def placed(docs: DataFrame, old_shards: int = OLD_SHARDS) -> DataFrame:
    """Rows of ``docs`` as a column ``doc``, with size, old_shard, and the place in it (order_key, block).

    Rows that share id and text are gathered by content, with their number in the map
    tasks already, and numbered. Without such rows nothing but the keys is shuffled.
    """
    name = F.xxhash64("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    rows = docs.select(F.struct(*(c for c in docs.columns if c not in ("shard", "slot"))).alias("doc"), name.alias("name"))
    ties = cut_lineage(rows.groupBy("name").count().where("count > 1").select("name"), "ties")
    zero = F.lit(0).cast("long")
    if ties.isEmpty():
        rows = rows.select("doc", _order_key(zero).alias("order_key"))
    else:
        again = rows.join(ties, "name", "left_semi").groupBy("doc", "name").agg(F.count("*").alias("copies"))
        # Numbers in two steps, so that the copies of a frequent row are made in many tasks.
        dealt = again.withColumn("first", F.explode(F.sequence(zero, F.col("copies") - 1, F.lit(CHUNK).cast("long")))).repartition("name", "first")
        numbered = dealt.withColumn("number", F.explode(F.sequence("first", F.least(F.col("first") + CHUNK, "copies") - 1)))
        numbered = cut_lineage(numbered.select("doc", _order_key(F.col("number")).alias("order_key")), "numbered")
        rows = rows.join(ties, "name", "left_anti").select("doc", _order_key(zero).alias("order_key")).union(numbered)
    return rows.withColumns(
        {
            "size": (F.coalesce(F.octet_length("doc.text"), F.lit(0)) + 8).cast("long"),
            "old_shard": F.pmod("order_key", F.lit(old_shards)).cast("int"),
            "block": F.shiftright("order_key", 63 - BLOCK_BITS).cast("int"),
        }
    )


def plan(rows: DataFrame, old_shards: int, new_shards: int) -> Plan:
    """Solve the transfers of ``rows`` (as made by ``placed``)."""
    keys = rows.select("old_shard", "block", "order_key", "size")
    sizes = keys.groupBy("old_shard", "block").agg(F.sum("size").alias("size")).orderBy("old_shard", "block").collect()
    supply = [0] * old_shards
    for row in sizes:
        supply[row.old_shard] += row["size"]
    total = sum(supply)
    capacity = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    flow = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    order = [[j for j in sorted(range(new_shards), key=lambda j, i=i: (j != i, j)) if flow[i][j]] for i in range(old_shards)]
    # Where each cut lies: the block, and bytes from the block's start.
    wanted, passed = [], [0] * old_shards
    ends = [[sum(flow[i][j] for j in order[i][: k + 1]) for k in range(len(order[i]) - 1)] for i in range(old_shards)]
    for row in sizes:
        i, low = row.old_shard, passed[row.old_shard]
        passed[i] += row["size"]
        wanted += [(i, row.block, k, end - low) for k, end in enumerate(ends[i]) if low <= end < passed[i]]
    cuts = [[(0, order[i][0] if order[i] else i % new_shards)] for i in range(old_shards)]
    if wanted:
        spark = rows.sparkSession
        # At most one row per cut: fewer than old_shards * new_shards.
        small = F.broadcast(spark.createDataFrame(wanted, "old_shard int, block int, cut int, rest long"))
        line = Window.partitionBy("old_shard", "block").orderBy("order_key")
        inside = keys.join(F.broadcast(small.select("old_shard", "block").distinct()), ["old_shard", "block"], "left_semi").groupBy(
            "old_shard", "block", "order_key"
        ).agg(F.sum("size").alias("size"))
        middle = F.sum("size").over(line) - F.col("size") / 2
        found = (
            inside.withColumn("middle", middle).join(small, ["old_shard", "block"]).groupBy("old_shard", "cut", "block")
            .agg(F.min(F.when(F.col("middle") > F.col("rest"), F.col("order_key"))).alias("at")).collect()
        )
        for row in sorted(found, key=lambda r: (r.old_shard, r.cut)):
            at = row["at"] if row["at"] is not None else (row.block + 1) << (63 - BLOCK_BITS)
            cuts[row.old_shard].append((at, order[row.old_shard][row.cut + 1]))
    return Plan(flow, cuts, total)


def assigned(rows: DataFrame, moves: Plan) -> DataFrame:
    """``rows`` with shard and slot; every shard's slots are gapless from 0."""
    spark = rows.sparkSession
    firsts = F.array(*(F.array(*(F.lit(at).cast("long") for at, _ in own)) for own in moves.cuts))
    targets = F.array(*(F.array(*(F.lit(j) for _, j in own)) for own in moves.cuts))
    passed = F.size(F.filter(F.get(firsts, F.col("old_shard")), lambda at: at <= F.col("order_key")))
    rows = rows.withColumn("shard", F.get(F.get(targets, F.col("old_shard")), passed - 1))
    counts = rows.groupBy("shard", "old_shard", "block").count().orderBy("shard", "old_shard", "block").collect()
    offsets, filled = [], {}
    for row in counts:
        offsets.append((row.shard, row.old_shard, row.block, filled.get(row.shard, 0)))
        filled[row.shard] = filled.get(row.shard, 0) + row["count"]
    # A block lies in one shard, but for those that are cut: OLD_SHARDS * BLOCKS rows and a few.
    table = F.broadcast(spark.createDataFrame(offsets, "shard int, old_shard int, block int, before long"))
    files = max(1, math.ceil(moves.total / max(len(filled), 1) / FILE_BYTES))
    part = F.col("shard") * files + F.pmod("block", F.lit(files))
    line = Window.partitionBy("part", "shard", "old_shard", "block").orderBy("order_key", "doc.doc_id")
    return (
        rows.join(table, ["shard", "old_shard", "block"]).withColumn("part", part)
        .repartition(max(1, len(filled) * files), "part")
        .withColumn("slot", F.col("before") + F.row_number().over(line) - 1).drop("before", "part")
    )


def reshard(docs: DataFrame, path: str | None = None, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """Rewrite the affected shards below ``path`` (one folder per shard) and return all rows with shard and slot."""
    spark = docs.sparkSession
    rows = placed(docs, old_shards)
    moves = plan(rows, old_shards, new_shards)
    if not moves.total:
        return docs.drop("shard", "slot").withColumns({"slot": F.lit(0).cast("long"), "shard": F.lit(0)}).limit(0)
    path = path or fresh_dir(spark, "shards")
    columns = [*(c for c in docs.columns if c not in ("shard", "slot")), "slot", "shard"]
    whole = assigned(rows, moves).select("doc.*", "slot", "shard")
    affected = moves.affected
    whole.where(F.col("shard").isin(affected)).write.partitionBy("shard").parquet(path)
    written = spark.read.schema(whole.schema).parquet(path).select(*columns)
    if len(affected) == new_shards:
        return written
    return written.union(whole.where(~F.col("shard").isin(affected)))

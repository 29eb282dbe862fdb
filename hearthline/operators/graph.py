"""Service dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.session import cut_lineage


def dependency_closure(edges: DataFrame) -> DataFrame:
    """All direct and indirect dependencies (svc, dep) with their least depth.

    Known distances double each round: a shortest path longer than ``reach``
    starts with a shortest path of exactly ``reach`` steps. So a graph of depth d
    takes log2(d) rounds, each stored in the shared folder, and cycles end because a pair never gets a second row.
    """
    pairs = cut_lineage(
        edges.select("svc", "dep").distinct().withColumn("depth", F.lit(1))
    )
    reach = 1
    while (pairs.agg(F.max("depth")).first()[0] or 0) >= reach:
        first = pairs.where(F.col("depth") == reach).select(
            "svc", F.col("dep").alias("via"), F.col("depth").alias("d1")
        )
        second = pairs.select(F.col("svc").alias("via"), "dep", F.col("depth").alias("d2"))
        longer = first.join(second, "via").select(
            "svc", "dep", (F.col("d1") + F.col("d2")).alias("depth")
        )
        pairs = cut_lineage(
            pairs.unionByName(longer).groupBy("svc", "dep").agg(F.min("depth").alias("depth"))
        )
        reach *= 2
    return pairs


def _both_ways(edges: DataFrame) -> DataFrame:
    """The edges left when nodes that nothing depends on, or that depend on nothing, go
    again and again: those on cycles and between them."""
    n = edges.count()
    while n:
        left = edges.join(edges.select(F.col("dep").alias("svc")).distinct(), "svc", "left_semi")
        edges = cut_lineage(left.join(edges.select(F.col("svc").alias("dep")).distinct(), "dep", "left_semi").select("svc", "dep"), "cycles")
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def _until_stable(rows: DataFrame, step, measure) -> DataFrame:
    """``step`` again and again, stored each time, until ``measure`` of the rows stays."""
    rows = cut_lineage(rows, "round")
    now, before = measure(rows), None
    while now != before:
        rows = cut_lineage(step(rows), "round")
        now, before = measure(rows), now
    return rows


def _least_reached(edges: DataFrame) -> DataFrame:
    """(svc, least): the first name among all nodes that a node on or between cycles leads to.

    A node also takes what its least one has, so the way covered doubles each round.
    """
    start = edges.select("svc", F.least("svc", "dep").alias("least")).groupBy("svc").agg(F.min("least").alias("least"))

    def step(known: DataFrame) -> DataFrame:
        of = known.select(F.col("svc").alias("via"), F.col("least").alias("further"))
        over_edges = edges.join(of, edges["dep"] == of["via"]).select("svc", F.col("further").alias("least"))
        jumped = known.join(of, known["least"] == of["via"]).select("svc", F.col("further").alias("least"))
        return known.unionByName(over_edges).unionByName(jumped).groupBy("svc").agg(F.min("least").alias("least"))

    def total(known: DataFrame):
        return known.agg(F.sum(F.xxhash64("svc", "least").cast("decimal(38,0)"))).first()[0]

    return _until_stable(start, step, total)


def components(edges: DataFrame) -> DataFrame:
    """(svc, component): each service with the first name of its cycle, its own if on none.

    Services that depend on each other, directly or not, are one component. Nodes off
    cycles are peeled away first, so the rest is as small as the cycles are. There a node
    is of the component of the least node it leads to if that one leads back; what
    remains goes round again. Steps are stored in the shared folder.
    """
    known = cut_lineage(edges.select("svc", "dep").where("svc IS NOT NULL AND dep IS NOT NULL").distinct(), "edges")
    left = _both_ways(known.where("svc <> dep"))
    found = []
    while not left.isEmpty():
        least = _least_reached(left)
        to = least.withColumnsRenamed({"svc": "dep", "least": "of"})
        inside = cut_lineage(left.join(least, "svc").join(to, "dep").where("least = of").select("svc", "dep", "least"), "inside")

        def onward(reached: DataFrame, inside: DataFrame = inside) -> DataFrame:
            return reached.unionByName(inside.join(reached, "svc", "left_semi").select(F.col("dep").alias("svc"), F.col("least").alias("component"))).distinct()

        roots = least.where("svc = least").select("svc", F.col("least").alias("component"))
        done = _until_stable(roots, onward, DataFrame.count)
        found.append(done)
        rest = left.join(done, "svc", "left_anti").join(done.select(F.col("svc").alias("dep")), "dep", "left_anti")
        left = _both_ways(cut_lineage(rest.select("svc", "dep"), "rest"))
    nodes = known.select("svc").unionByName(known.select(F.col("dep").alias("svc"))).distinct()
    if not found:
        return nodes.withColumn("component", F.col("svc"))
    return nodes.join(reduce(DataFrame.unionByName, found), "svc", "left").withColumn("component", F.coalesce("component", "svc"))


def condensed(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(svc, dep) between components: what is left has no cycle."""
    of = members.select(F.col("svc").alias("dep"), F.col("component").alias("to"))
    both = edges.select("svc", "dep").join(members, "svc").join(of, "dep").where("component <> to")
    return both.select(F.col("component").alias("svc"), F.col("to").alias("dep")).distinct()


def hit_by_outage(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(svc, depth): what stops working when ``failed`` (svc) does, and over how many steps.

    Only services that are hit are ever held, each once; all pairs of the closure are
    never made. Failed services have depth 0. One stored round per step.
    """
    edges = cut_lineage(edges.select("svc", "dep").distinct(), "edges")
    hit = cut_lineage(failed.select("svc").distinct().withColumn("depth", F.lit(0)), "hit")
    depth, last = 0, hit
    while not last.isEmpty():
        depth += 1
        above = edges.join(last.select(F.col("svc").alias("dep")), "dep", "left_semi").select("svc").distinct()
        last = cut_lineage(above.join(hit, "svc", "left_anti").withColumn("depth", F.lit(depth)), "hit")
        hit = hit.unionByName(last)
    return hit

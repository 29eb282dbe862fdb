"""Registries, engines, inventories and the dependency graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators import graph
from hearthline.operators import registry as r
from hearthline.plans import views as v
from hearthline.plans.views import C, check
from hearthline.session import cut_lineage, fresh_dir
from hearthline.sources import sinks
from hearthline.sources.posts import PostedLists


def _engines(spark, sf_dir):
    return r.read_engines(v.engines(spark, sf_dir))


def _listed(df):
    return df.withColumn("categories", F.array_join("categories", ","))


def engine_registry_scan(spark, sf_dir):
    return _listed(_engines(spark, sf_dir))


def engine_enabled(spark, sf_dir):
    return r.enabled_engines(_engines(spark, sf_dir)).select("name")


def engine_in_category(spark, sf_dir):
    return _listed(r.engines_for(_engines(spark, sf_dir), "general", "science")).select("name", "categories")


def results_in_category(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select("doc_id", C("source").alias("engine"), "lang")
    return r.results_in_category(d, _engines(spark, sf_dir), "news")


def admin_key_lookup(spark, sf_dir):
    keys = v.table(spark, sf_dir, "orders").select(C("o_orderkey").alias("key"), C("o_custkey").alias("user_id"))
    users = v.table(spark, sf_dir, "customer").select(C("c_custkey").alias("id"), C("c_mktsegment").alias("role"))
    return r.key_lookup(keys, users, "BUILDING")


def first_row(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return r.first_row(o, "o_orderdate", "o_orderkey")


def _asked_ids(spark, sf_dir):
    """Nation ids of customers; those of every tenth customer are unknown."""
    shift = F.when(C("c_custkey") % 10 == 0, 100).otherwise(0)
    return v.table(spark, sf_dir, "customer").select("c_custkey", (C("c_nationkey") + shift).alias("id"))


def _nations(spark, sf_dir):
    return v.table(spark, sf_dir, "nation").select(C("n_nationkey").alias("id"), C("n_name").alias("name"))


ASKED_SQL = (
    "WITH asked AS (SELECT c_custkey, c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END AS id"
    " FROM customer) "
)


def registry_lookup(spark, sf_dir):
    return r.registry_lookup(_asked_ids(spark, sf_dir), _nations(spark, sf_dir))


def unknown_ids(spark, sf_dir):
    return r.unknown_ids(_asked_ids(spark, sf_dir), _nations(spark, sf_dir))


def url_override(spark, sf_dir):
    services = v.table(spark, sf_dir, "customer").select(
        C("c_custkey").alias("id"),
        F.when(C("c_acctbal") >= 0, F.concat(F.lit("http://registry/"), "c_name")).alias("url"),
    )
    overrides = v.table(spark, sf_dir, "supplier").select(
        (C("s_suppkey") * 7).alias("id"), F.concat(F.lit("http://override/"), "s_name").alias("url")
    )
    return r.with_override(services, overrides, "url", "http://localhost:8080")


def settings_overlay(spark, sf_dir):
    defaults = v.table(spark, sf_dir, "part").select(
        C("p_partkey").alias("id"), C("p_name").alias("name"), C("p_size").alias("size")
    )
    overrides = v.table(spark, sf_dir, "supplier").select(
        (C("s_suppkey") * 37).alias("id"), C("s_name").alias("name"), F.lit(None).cast("int").alias("size")
    )
    return r.overlay(defaults, overrides, "id")


def _newest_state(spark, sf_dir):
    """State of each customer's newest order; combined in the map tasks."""
    state = F.when(C("o_orderstatus") == "O", "running").when(C("o_orderstatus") == "F", "exited").otherwise("")
    newest = F.max(F.struct("o_orderdate", "o_orderkey", state.alias("state")))
    return (
        v.table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("id"))
        .agg(newest.alias("s")).select("id", "s.state")
    )


def _expected(spark, sf_dir):
    """Customers and, without orders, suppliers above them."""
    c = v.table(spark, sf_dir, "customer").select(C("c_custkey").alias("id"))
    s = v.table(spark, sf_dir, "supplier").select((C("s_suppkey") + 1_000_000_000_000).alias("id"))
    return c.unionByName(s)


STATES_SQL = (
    "WITH states AS (SELECT o_custkey AS id, CASE arg_max(o_orderstatus, (o_orderdate, o_orderkey))"
    " WHEN 'O' THEN 'running' WHEN 'F' THEN 'exited' ELSE '' END AS state FROM orders GROUP BY 1),"
    " expected AS (SELECT c_custkey AS id FROM customer UNION ALL"
    " SELECT s_suppkey + 1000000000000 FROM supplier) "
)


def inventory_check(spark, sf_dir):
    return r.inventory_check(_expected(spark, sf_dir), _newest_state(spark, sf_dir))


def container_state(spark, sf_dir):
    checked = r.inventory_check(_expected(spark, sf_dir), _newest_state(spark, sf_dir))
    ok, shown = r.container_state(C("state"))
    return checked.select("id", ok.alias("ok"), shown.alias("shown"))


def inventory_missing(spark, sf_dir):
    seen = v.table(spark, sf_dir, "orders").select(C("o_custkey").alias("id"))
    return r.inventory_missing(_expected(spark, sf_dir), seen)


def inventory_common(spark, sf_dir):
    seen = v.table(spark, sf_dir, "orders").select(C("o_custkey").alias("id"))
    return r.inventory_common(_expected(spark, sf_dir), seen)


def registry_order(spark, sf_dir):
    s = v.table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    return r.with_position(s, "s_nationkey", "s_suppkey")


def registry_order_hot(spark, sf_dir):
    """Customers by name in the lists of three owners, cut into chunks."""
    c = v.table(spark, sf_dir, "customer").select((C("c_custkey") % 3).alias("owner"), "c_name")
    return r.with_position(c, "owner", "c_name", rows_per_chunk=v.HOT_CHUNK // 5)


def registry_overwrite(spark, sf_dir):
    """Post all suppliers per nation; then shorter lists for even nations, some of them
    empty, twice under one number; put the log together; then a post that never becomes whole."""
    s = v.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    entry = F.struct("s_suppkey", "s_name", "s_acctbal")

    def parts(number: int, rows: DataFrame, owners: DataFrame | None = None, part_rows: int = 10) -> DataFrame:
        return r.post_parts(rows, "s_nationkey", "s_suppkey", entry, part_rows, owners).withColumn("post", F.lit(number))

    even = s.where(C("s_nationkey") % 2 == 0)
    first = parts(1, s)
    lists = PostedLists(spark, fresh_dir(spark, "registry"), "s_nationkey", first.schema)
    lists.append(first, "console", 1)
    shorter = parts(2, even.where(C("s_acctbal") > 0), even)
    for _ in range(2):
        lists.append(shorter, "console", 2)
    lists.compact()
    lists.append(parts(3, s, part_rows=1).where(C("part") > 0), "console", 3)
    lists.expire()
    return lists.read()


def registry_json_body(spark, sf_dir):
    s = v.table(spark, sf_dir, "supplier").select(
        C("s_nationkey").alias("owner"),
        C("s_suppkey").alias("id"),
        F.concat(F.lit("http://host/"), "s_suppkey").alias("url"),
        F.lit("bearer").alias("auth_type"),
        (C("s_acctbal") > 0).alias("enable"),
        C("s_name").alias("name"),
    )
    return sinks.registry_json(s, "owner", "id", ["enable"], ["name"], part_rows=10)


def _dependencies(spark, sf_dir) -> DataFrame:
    """Order → customer → nation → region, and supplier → nation."""
    def edges(name: str, a: str, a_key: str, b: str, b_key: str) -> DataFrame:
        return v.table(spark, sf_dir, name).select(
            F.concat(F.lit(a), a_key).alias("svc"), F.concat(F.lit(b), b_key).alias("dep")
        )

    return reduce(DataFrame.unionByName, [
        edges("orders", "order ", "o_orderkey", "customer ", "o_custkey"),
        edges("customer", "customer ", "c_custkey", "nation ", "c_nationkey"),
        edges("supplier", "supplier ", "s_suppkey", "nation ", "s_nationkey"),
        edges("nation", "nation ", "n_nationkey", "region ", "n_regionkey"),
    ])


def _with_cycles(spark, sf_dir) -> DataFrame:
    """The same, and each region depends on its first nation, which depends on it."""
    first = v.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n"))
    back = first.select(F.concat(F.lit("region "), "n_regionkey").alias("svc"), F.concat(F.lit("nation "), "n").alias("dep"))
    return _dependencies(spark, sf_dir).unionByName(back)


def dependency_closure(spark, sf_dir):
    return graph.dependency_closure(_dependencies(spark, sf_dir))


def dependency_cycles(spark, sf_dir):
    return graph.components(_with_cycles(spark, sf_dir))


def dependency_condensed(spark, sf_dir):
    edges = _with_cycles(spark, sf_dir)
    return graph.condensed(edges, cut_lineage(graph.components(edges), "members"))


def hit_by_outage(spark, sf_dir):
    """All that stops when regions 1 and 3 do."""
    failed = v.table(spark, sf_dir, "region").where(C("r_regionkey").isin(1, 3)).select(F.concat(F.lit("region "), "r_regionkey").alias("svc"))
    return graph.hit_by_outage(_with_cycles(spark, sf_dir), failed)


def registry_json_models(spark, sf_dir):
    """The other document of the setup: lists under a name of their own, without details."""
    s = v.table(spark, sf_dir, "supplier").select(
        C("s_nationkey").alias("owner"), C("s_suppkey").alias("id"), F.concat(F.lit("http://host/"), "s_suppkey").alias("url"), (C("s_acctbal") > 0).alias("enable"))
    return sinks.registry_json(s, "owner", "id", ["enable"], [], part_rows=10, name="models")


EDGES_SQL = (
    "edges AS (SELECT 'order ' || o_orderkey AS svc, 'customer ' || o_custkey AS dep FROM orders"
    " UNION SELECT 'customer ' || c_custkey, 'nation ' || c_nationkey FROM customer"
    " UNION SELECT 'supplier ' || s_suppkey, 'nation ' || s_nationkey FROM supplier"
    " UNION SELECT 'nation ' || n_nationkey, 'region ' || n_regionkey FROM nation)"
)
# The only cycles are those of a region and its first nation, whose name comes first.
CYCLES_SQL = (
    "firsts AS (SELECT 'region ' || n_regionkey AS svc, 'nation ' || min(n_nationkey) AS dep FROM nation GROUP BY n_regionkey),"
    " looped AS (SELECT * FROM edges UNION SELECT * FROM firsts),"
    " members AS (SELECT svc, coalesce(f.dep, svc) AS component FROM (SELECT svc FROM looped UNION SELECT dep FROM looped) n"
    " LEFT JOIN firsts f USING (svc))"
)

QUERIES = {
    "engine_registry_scan": (engine_registry_scan, check(
        "SELECT name, disabled, array_to_string(categories, ',') AS categories FROM engines", "engines")),
    "engine_enabled": (engine_enabled, check("SELECT name FROM engines WHERE NOT disabled", "engines")),
    "engine_in_category": (engine_in_category, check(
        "SELECT name, array_to_string(categories, ',') AS categories FROM engines"
        " WHERE list_contains(categories, 'general') OR list_contains(categories, 'science')", "engines")),
    "results_in_category": (results_in_category, check(
        "SELECT doc_id, source AS engine, lang FROM documents WHERE source IN"
        " (SELECT name FROM engines WHERE NOT disabled AND list_contains(categories, 'news'))", "engines")),
    "admin_key_lookup": (admin_key_lookup,
        "SELECT o_orderkey AS key, o_custkey AS user_id, c_mktsegment AS role FROM orders JOIN customer"
        " ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderkey LIMIT 1"),
    "first_row": (first_row,
        "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1"),
    "registry_lookup": (registry_lookup, ASKED_SQL +
        "SELECT id, c_custkey, n_name AS name, CASE WHEN n_name IS NULL THEN 404 ELSE 200 END AS status"
        " FROM asked LEFT JOIN nation ON id = n_nationkey"),
    "unknown_ids": (unknown_ids, ASKED_SQL +
        "SELECT id, c_custkey FROM asked WHERE id NOT IN (SELECT n_nationkey FROM nation)"),
    "url_override": (url_override,
        "SELECT c_custkey AS id, coalesce('http://override/' || s_name, CASE WHEN c_acctbal >= 0 THEN"
        " 'http://registry/' || c_name END, 'http://localhost:8080') AS url FROM customer"
        " LEFT JOIN supplier ON c_custkey = s_suppkey * 7"),
    "settings_overlay": (settings_overlay,
        "SELECT coalesce(p_partkey, s_suppkey * 37) AS id, coalesce(s_name, p_name) AS name, p_size AS size"
        " FROM part FULL JOIN supplier ON p_partkey = s_suppkey * 37"),
    "inventory_check": (inventory_check, STATES_SQL +
        "SELECT id, state FROM expected LEFT JOIN states USING (id)"),
    "container_state": (container_state, STATES_SQL +
        "SELECT id, coalesce(state = 'running', false) AS ok, CASE WHEN state = 'running' THEN 'ok'"
        " WHEN coalesce(state, '') <> '' THEN state ELSE 'not found' END AS shown"
        " FROM expected LEFT JOIN states USING (id)"),
    "inventory_missing": (inventory_missing, STATES_SQL +
        "SELECT id FROM expected EXCEPT SELECT o_custkey FROM orders"),
    "inventory_common": (inventory_common, STATES_SQL +
        "SELECT id FROM expected INTERSECT SELECT o_custkey FROM orders"),
    "registry_order": (registry_order,
        "SELECT *, position * 70 AS delay_ms FROM (SELECT s_nationkey, s_suppkey, s_name,"
        " row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS position FROM supplier)"),
    "registry_order_hot": (registry_order_hot,
        "SELECT *, position * 70 AS delay_ms FROM (SELECT c_custkey % 3 AS owner, c_name,"
        " row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_name) - 1 AS position FROM customer)"),
    "registry_overwrite": (registry_overwrite,
        "SELECT s_suppkey, s_name, s_acctbal, s_nationkey FROM supplier WHERE s_nationkey % 2 = 1"
        " OR s_acctbal > 0"),
    "registry_json_body": (registry_json_body,
        "SELECT s_nationkey AS owner, CAST(place // 10 AS INTEGER) AS part,"
        " CAST((any_value(n) + 9) // 10 AS INTEGER) AS parts, '{\"connections\":[' || string_agg("
        "'{\"url\":\"http://host/' || s_suppkey || '\",\"auth_type\":\"bearer\",\"config\":{\"enable\":' ||"
        " (s_acctbal > 0) || '},\"info\":{\"id\":' || s_suppkey || ',\"name\":\"' || s_name || '\"}}',"
        " ',' ORDER BY s_suppkey) || ']}' AS body FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n,"
        " row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier) GROUP BY 1, 2"),
    "registry_json_models": (registry_json_models,
        "SELECT s_nationkey AS owner, CAST(place // 10 AS INTEGER) AS part, CAST((any_value(n) + 9) // 10 AS INTEGER) AS parts,"
        " '{\"models\":[' || string_agg('{\"url\":\"http://host/' || s_suppkey || '\",\"config\":{\"enable\":' ||"
        " (s_acctbal > 0) || '}}', ',' ORDER BY s_suppkey) || ']}' AS body FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n,"
        " row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier) GROUP BY 1, 2"),
    "dependency_cycles": (dependency_cycles,
        f"WITH {EDGES_SQL}, {CYCLES_SQL} SELECT svc, component FROM members"),
    "dependency_condensed": (dependency_condensed,
        f"WITH {EDGES_SQL}, {CYCLES_SQL} SELECT DISTINCT a.component AS svc, b.component AS dep FROM looped e JOIN members a USING (svc)"
        " JOIN members b ON e.dep = b.svc WHERE a.component <> b.component"),
    "hit_by_outage": (hit_by_outage,
        f"WITH RECURSIVE {EDGES_SQL}, {CYCLES_SQL}, hit AS (SELECT 'region ' || r_regionkey AS svc, 0 AS depth FROM region"
        " WHERE r_regionkey IN (1, 3) UNION SELECT e.svc, depth + 1 FROM hit JOIN looped e ON e.dep = hit.svc WHERE depth < 6)"
        " SELECT svc, min(depth) AS depth FROM hit GROUP BY 1"),
    "dependency_closure": (dependency_closure,
        f"WITH RECURSIVE {EDGES_SQL}, closure AS (SELECT svc, dep, 1 AS depth FROM edges UNION"
        " SELECT c.svc, e.dep, c.depth + 1 FROM closure c JOIN edges e ON c.dep = e.svc)"
        " SELECT svc, dep, min(depth) AS depth FROM closure GROUP BY 1, 2"),
}

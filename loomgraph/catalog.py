"""Every graph query by name, over the star-schema tables, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import bridge
from loomgraph.functions import ids, routes
from loomgraph.plans import http, packages, usages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, and its twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- packages (Q1-Q3, G10) ----------------------------------------------------------------------------------------------------


@query(
    f"""WITH {bridge.SUPPLY_SQL},
bad AS (SELECT package, string_agg(version, ',' ORDER BY version) AS versions FROM (SELECT DISTINCT package, version FROM uses) GROUP BY package HAVING count(*) > 1)
SELECT 'main' AS workspace, package, versions, s_name AS project, version, tfm, is_direct FROM uses JOIN bad USING (package)"""
)
def version_conflicts(spark, sf_dir):
    return packages.version_conflicts(bridge.supply_graph(spark, sf_dir))


@query(
    f"""WITH {bridge.SUPPLY_SQL}
SELECT 'main' AS workspace, 'Project:' || replace(s.s_name, '#', '~0023') || '@project' AS project_id, s.s_name AS project, 'F,O' AS target_frameworks, package, version, is_direct, tfm,
       'Package:' || replace(package, ' ', '~0020') || '@' || replace(version, '#', '~0023') AS package_id
FROM supplier s LEFT JOIN uses ON uses.s_name = s.s_name"""
)
def list_dependencies(spark, sf_dir):
    return packages.list_dependencies(bridge.supply_graph(spark, sf_dir))


@query(
    f"""WITH {bridge.SUPPLY_SQL}
SELECT 'main' AS workspace, 'Project:' || replace(s.s_name, '#', '~0023') || '@project' AS project_id, s.s_name AS project, 'F,O' AS target_frameworks, package, version, is_direct, tfm,
       'Package:' || replace(package, ' ', '~0020') || '@' || replace(version, '#', '~0023') AS package_id
FROM supplier s LEFT JOIN uses ON uses.s_name = s.s_name WHERE s.s_name = 'Supplier#000000003'"""
)
def list_dependencies_of_project(spark, sf_dir):
    return packages.list_dependencies(bridge.supply_graph(spark, sf_dir), project="SRC/supplier#000000003.csproj")


_API = "SELECT DISTINCT namespace, type, method, signature FROM api WHERE r_name = 'ASIA'"


@query(f"WITH {bridge.CONTAINMENT_SQL} {_API}")
def describe_api(spark, sf_dir):
    return packages.describe_api(bridge.containment_graph(spark, sf_dir), "ASIA", "1")


@query(f"WITH {bridge.CONTAINMENT_SQL} {_API}")
def describe_api_for_framework(spark, sf_dir):
    return packages.describe_api(bridge.containment_graph(spark, sf_dir), "ASIA", "1", tfm="F")


@query(
    f"""WITH {bridge.CONTAINMENT_SQL},
asia AS (SELECT DISTINCT namespace, type, method, signature FROM api WHERE r_name = 'ASIA'),
kept AS (SELECT namespace, type, CASE WHEN regexp_matches(method, 'Line[12]$') THEN method END AS method, CASE WHEN regexp_matches(method, 'Line[12]$') THEN signature END AS signature FROM asia
         WHERE regexp_matches(method, 'Line[12]$') OR regexp_matches(type, 'Line[12]$'))
SELECT DISTINCT n.namespace, type, method, signature FROM (SELECT DISTINCT namespace FROM asia) n LEFT JOIN kept ON kept.namespace = n.namespace"""
)
def describe_api_filtered(spark, sf_dir):
    return packages.describe_api(bridge.containment_graph(spark, sf_dir), "ASIA", "1", pattern="Line[12]$")


# -- graph primitives (G1-G9) -------------------------------------------------------------------------------------------------


def _shown(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "kind", "fqn", "version")


@query("SELECT 'Assembly:' || n_name || '@1' AS id, 'Assembly' AS kind, n_name AS fqn, '1' AS version FROM nation WHERE n_name = 'NATION_7'")
def get_node(spark, sf_dir):
    return _shown(bridge.containment_graph(spark, sf_dir).node("Assembly:NATION_7@1"))


@query("SELECT 'Type:Order' || o_orderkey || '@1' AS id, 'Type' AS kind, 'Order' || o_orderkey AS fqn, '1' AS version FROM orders WHERE regexp_matches(CAST(o_orderkey AS VARCHAR), '7$')")
def find_nodes(spark, sf_dir):
    return _shown(bridge.containment_graph(spark, sf_dir).find("Type", F.col("fqn").rlike("7$")))


@query("SELECT 'Package:' || r_name || '@1' AS from_id, 'Assembly:' || n_name || '@1' AS to_id, 'Contains' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def get_edges(spark, sf_dir):
    return bridge.containment_graph(spark, sf_dir).find_edges(from_id="Package:EUROPE@1", kind="Contains").select("from_id", "to_id", "kind")


@query("SELECT 'Namespace:' || replace(c_name, '#', '~0023') || '@1' AS id, 'Namespace' AS kind, c_name AS fqn, '1' AS version FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def neighbors_out(spark, sf_dir):
    return _shown(bridge.containment_graph(spark, sf_dir).neighbors("Assembly:NATION_3@1", "outgoing", "Contains"))


@query("SELECT 'Package:' || r_name || '@1' AS id, 'Package' AS kind, r_name AS fqn, '1' AS version FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name = 'NATION_3'")
def neighbors_in(spark, sf_dir):
    return _shown(bridge.containment_graph(spark, sf_dir).neighbors("Assembly:NATION_3@1", "incoming"))


@query(
    """SELECT 'Namespace:' || replace(c_name, '#', '~0023') || '@1' AS id, 'Namespace' AS kind, c_name AS fqn, '1' AS version FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'
UNION ALL SELECT 'Package:' || r_name || '@1', 'Package', r_name, '1' FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name = 'NATION_3'"""
)
def neighbors_both(spark, sf_dir):
    return _shown(bridge.containment_graph(spark, sf_dir).neighbors("Assembly:NATION_3@1", "both"))


@query("SELECT 'Namespace:' || replace(c_name, '#', '~0023') || '@1' AS id, 'Namespace' AS kind, c_name AS fqn, '1' AS version FROM customer WHERE starts_with(lower(c_name), 'customer#00000001')")
def prefix_search(spark, sf_dir):
    return _shown(bridge.containment_graph(spark, sf_dir).by_name_prefix(" CUSTOMER#00000001 "))


@query(
    """SELECT DISTINCT 'Method:Order' || l_orderkey || '.Line' || l_linenumber || '@1' AS id, 'Method' AS kind, 'Order' || l_orderkey || '.Line' || l_linenumber AS fqn, '1' AS version FROM lineitem"""
)
def attribute_key_search(spark, sf_dir):
    return _shown(bridge.containment_graph(spark, sf_dir).by_attribute(" signature "))


@query(
    """SELECT replace(r_name, ' ', '~0020') AS r_name, n_name, count(DISTINCT c_custkey) AS namespaces, count(DISTINCT o_orderkey) AS types
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"""
)
def containment_counts(spark, sf_dir):
    g = bridge.containment_graph(spark, sf_dir)
    flat = g.contained(g.find("Package"), ("Assembly", "Namespace", "Type"))
    return flat.groupBy(F.regexp_extract("id", "^Package:(.*)@", 1).alias("r_name"), F.col("assembly_fqn").alias("n_name")).agg(F.countDistinct("namespace_id").alias("namespaces"), F.countDistinct("type_id").alias("types"))


# -- usages (Q4, Q5, S19, S20) --------------------------------------------------------------------------------------------------


@query(f"WITH {bridge.USAGE_SQL} SELECT workspace, symbol_id, usage, from_id, enclosing, file, start_line, start_col, end_line, end_col FROM places WHERE l_partkey = 17")
def find_usages(spark, sf_dir):
    g = bridge.usage_graph(spark, sf_dir)
    return usages.find_usages(g, usages.symbols(g, symbol_id="Method:Part17@1"))


@query(f"WITH {bridge.USAGE_SQL} SELECT workspace, symbol_id, usage, from_id, enclosing, file, start_line, start_col, end_line, end_col FROM places WHERE l_partkey = 40 AND workspace = 'BUILDING'")
def find_usages_by_name(spark, sf_dir):
    g = bridge.usage_graph(spark, sf_dir)
    return usages.find_usages(g, usages.symbols(g, kind="method", full_name="Part40", version="1", workspaces=["BUILDING"]), ["building"])


@query(f"WITH {bridge.USAGE_SQL} SELECT workspace, symbol_id, usage, count(*) AS places, count(DISTINCT from_id) AS sources, count(DISTINCT file) AS files FROM places GROUP BY ALL")
def usage_counts(spark, sf_dir):
    g = bridge.usage_graph(spark, sf_dir)
    wanted = g.nodes.where(F.col("fqn").startswith("Part")).select(F.col("id").alias("symbol_id")).distinct()
    return usages.find_usages(g, wanted).groupBy("workspace", "symbol_id", "usage").agg(F.count(F.lit(1)).alias("places"), F.countDistinct("from_id").alias("sources"), F.countDistinct("file").alias("files"))



_SUGGEST = f"""WITH {bridge.USAGE_SQL}, {bridge.LINES_SQL},
scored AS (
  SELECT p.*, excerpt, ticks AS recency, CASE WHEN length(excerpt) > 0 THEN length(excerpt) ELSE greatest(1, end_col - start_col + 1) END AS brevity
  FROM places p LEFT JOIN excerpts e ON e.file = p.file AND e.start_line = p.start_line AND e.end_line = p.end_line JOIN files f ON f.file = p.file WHERE usage = 'Calls' AND l_partkey PART),
grouped AS (
  SELECT workspace, from_id, file, start_line, start_col, coalesce(excerpt, '') AS ek, count(*) AS occurrence, min({{'d': -diversity, 's': symbol_id}}) AS best, min(excerpt) AS excerpt, min(recency) AS recency, min(brevity) AS brevity, min(enclosing) AS enclosing
  FROM scored GROUP BY workspace, from_id, file, start_line, start_col, end_line, end_col, coalesce(excerpt, ''))
SELECT occurrence, from_id, start_line, start_col, workspace, best.s AS symbol_id, file, excerpt, CAST(recency AS BIGINT) AS recency, CAST(-best.d AS INTEGER) AS diversity, CAST(brevity AS INTEGER) AS brevity, enclosing,
       'frequency=' || occurrence || '; recencyTicks=' || recency || '; diversity=' || -best.d || '; brevity=' || brevity AS rank_reason
FROM grouped ORDER BY occurrence DESC, recency DESC, -best.d DESC, brevity, workspace, file, start_line, start_col, from_id LIMIT MOST"""


@query(_SUGGEST.replace("PART)", "= 17)").replace("MOST", "5"))
def suggest_usage(spark, sf_dir):
    g = bridge.usage_graph(spark, sf_dir)
    return usages.suggest_usage(g, usages.symbols(g, symbol_id="Method:Part17@1"), bridge.source_lines(spark, sf_dir), bridge.source_files(spark, sf_dir))


@query(_SUGGEST.replace("PART)", ">= 0)").replace("MOST", "25"))
def suggest_usage_overall(spark, sf_dir):
    g = bridge.usage_graph(spark, sf_dir)
    wanted = g.nodes.where(F.col("fqn").startswith("Part")).select(F.col("id").alias("symbol_id")).distinct()
    return usages.suggest_usage(g, wanted, bridge.source_lines(spark, sf_dir), bridge.source_files(spark, sf_dir), most=25)


# -- http (Q6, Q7, F8-F10) --------------------------------------------------------------------------------------------------------


@query(f"WITH {bridge.HTTP_SQL} SELECT 'main' AS workspace, CASE role WHEN 'Producer' THEN 'HttpEndpoint' ELSE 'HttpCallSite' END || ':Page' || page_id || '@1' AS node_id, role, method, path FROM routes")
def http_index(spark, sf_dir):
    return http.http_index(bridge.http_graph(spark, sf_dir))


@query(
    f"""WITH {bridge.HTTP_SQL}
SELECT 'main' AS workspace, CASE role WHEN 'Producer' THEN 'HttpEndpoint' ELSE 'HttpCallSite' END || ':Page' || page_id || '@1' AS node_id, role, method, path, 'Method:Handler' || page_id || '@1' AS source,
       CASE role WHEN 'Producer' THEN template ELSE u END AS written, 'pages/' || page_id % 10 || '.ts' AS file, CAST(page_id % 100 + 1 AS INTEGER) AS line, 3 AS col
FROM routes WHERE method = 'GET' AND path = '/en/{{id}}'"""
)
def trace_http(spark, sf_dir):
    return http.trace_http(bridge.http_graph(spark, sf_dir), "get ", "https://any.example.org/EN/{id:int}/?x=1")


@query(
    f"""WITH {bridge.HTTP_SQL}
SELECT method, path, count(*) FILTER (role = 'Producer') AS producers, count(*) FILTER (role = 'Consumer') AS consumers FROM routes GROUP BY method, path HAVING producers > 0 AND consumers > 0"""
)
def matched_routes(spark, sf_dir):
    index = http.http_index(bridge.http_graph(spark, sf_dir))
    n = lambda role: F.sum((F.col("role") == role).cast("long"))
    return index.groupBy("method", "path").agg(n("Producer").alias("producers"), n("Consumer").alias("consumers")).where("producers > 0 and consumers > 0")


@query(f"SELECT page_id, {routes.normal_path_sql('url')} AS route FROM pages")
def route_normalize(spark, sf_dir):
    return bridge.table(spark, sf_dir, "pages").select("page_id", routes.normal_path(F.col("url")).alias("route"))


# -- identifiers (F1, F2) ---------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'Package:' || replace(p_name, ' ', '~0020') || '@' || replace(p_brand, '#', '~0023') AS id FROM part")
def node_id_encode(spark, sf_dir):
    return bridge.table(spark, sf_dir, "part").select("p_partkey", ids.node_id("Package", F.col("p_name"), F.col("p_brand")).alias("id"))


@query("SELECT p_partkey, 'Package' AS kind, replace(p_name, ' ', '~0020') AS fqn, replace(p_brand, '#', '~0023') AS version FROM part")
def node_id_parse(spark, sf_dir):
    made = bridge.table(spark, sf_dir, "part").select("p_partkey", ids.node_id("Package", F.col("p_name"), F.col("p_brand")).alias("id"))
    return made.select("p_partkey", ids.parse(F.col("id")).alias("p")).select("p_partkey", "p.kind", "p.fqn", "p.version")



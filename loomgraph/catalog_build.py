"""The build side by name: merging, reconciling, change detection, scanners, statistics; each with its DuckDB twin.

Scanners run over files that the queries make up from the tables, so that they meet every row of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import bridge
from loomgraph.catalog import query
from loomgraph.functions.attributes import canonical_key
from loomgraph.functions.ids import node_id, short_hash
from loomgraph.functions.routes import url_template
from loomgraph.operators import changes, merge, reconcile
from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans import usages
from loomgraph.sources import csharp, openapi, postman, requests, script, solution, symbols
from loomgraph.streaming import changes as stream_changes
from loomgraph.streaming import statistics

# -- merging (A6-A8, A3, A11, A20) ------------------------------------------------------------------------------------------------


def _fragments(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every order line is found by the provider of its number: nodes for parts, edges from orders to parts."""
    line = bridge.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    seq = F.col("l_orderkey") * 1000 + F.col("l_suppkey")
    part, order = F.concat(F.lit("Part"), F.col("l_partkey").cast("string")), F.concat(F.lit("Order"), F.col("l_orderkey").cast("string"))
    extra = lambda df, *keep: df.select(*keep, F.col("l_linenumber").alias("provider_ord"), seq.alias("seq"))
    one, none = F.lit("1"), F.lit(None).cast(bridge.REFS_DDL)
    nodes = extra(
        line, F.lit("main").alias("workspace"), node_id("Method", part, one).alias("id"), F.lit("Method").alias("kind"), part.alias("fqn"), one.alias("version"), part.alias("display_name"),
        F.create_map(F.lit("order"), F.col("l_orderkey").cast("string"), F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("attributes"), none.alias("source_refs"),
    )
    edges = extra(
        line, F.lit("main").alias("workspace"), node_id("Method", order, one).alias("from_id"), node_id("Method", part, one).alias("to_id"), F.lit("Calls").alias("kind"),
        F.create_map(F.lit("flag"), bridge.json_text(F.col("l_returnflag")), F.lit("status"), bridge.json_text(F.col("l_linestatus"))).alias("attributes"), none.alias("source_refs"),
    )
    return nodes, edges


@query("SELECT 'Method:Part' || l_partkey || '@1' AS id, max({'n': l_linenumber * 1000000000000 + l_orderkey * 1000 + l_suppkey, 'a': 'order=' || l_orderkey || '|supplier=' || l_suppkey}).a AS attributes FROM lineitem GROUP BY l_partkey")
def merge_nodes(spark, sf_dir):
    return merge.merge_nodes(_fragments(spark, sf_dir)[0]).select("id", canonical_key(F.col("attributes")).alias("attributes"))


@query("""SELECT DISTINCT 'Method:Order' || l_orderkey || '@1' AS from_id, 'Method:Part' || l_partkey || '@1' AS to_id, 'Calls' AS kind, 'flag="' || l_returnflag || '"|status="' || l_linestatus || '"' AS attributes FROM lineitem""")
def merge_edges(spark, sf_dir):
    return merge.merge_edges(_fragments(spark, sf_dir)[1]).select("from_id", "to_id", "kind", canonical_key(F.col("attributes")).alias("attributes"))


@query(
    """SELECT 'Method:Order' || l_orderkey || '@1' AS from_id, 'Method:Part' || l_partkey || '@1' AS to_id, 'Calls' AS kind,
min({'n': l_linenumber * 1000000000000 + l_orderkey * 1000 + l_suppkey, 'a': 'flag="' || l_returnflag || '"|status="' || l_linestatus || '"'}).a AS attributes FROM lineitem GROUP BY l_orderkey, l_partkey"""
)
def distinct_edges(spark, sf_dir):
    return merge.distinct_edges(_fragments(spark, sf_dir)[1]).select("from_id", "to_id", "kind", canonical_key(F.col("attributes")).alias("attributes"))


@query(
    f"""WITH {bridge.USAGE_SQL}, spots AS (SELECT from_id, symbol_id AS to_id, usage AS kind, file, start_line, start_col FROM places)
SELECT from_id, to_id, kind, count(*) AS n, count(DISTINCT file) AS files, count(DISTINCT (file, start_line, start_col)) AS spans FROM spots GROUP BY ALL"""
)
def usage_edges(spark, sf_dir):
    g = bridge.usage_graph(spark, sf_dir)
    wanted = g.nodes.where(F.col("fqn").startswith("Part")).select(F.col("id").alias("symbol_id")).distinct()
    sites = usages.find_usages(g, wanted).select("from_id", F.col("symbol_id").alias("to_id"), F.col("usage").alias("kind"), "file", F.struct("start_line", "start_col", "end_line", "end_col").alias("span"))
    sums = merge.usage_edges(sites)
    spans = F.aggregate("source_refs", F.lit(0), lambda n, r: n + F.size(r["spans"]))
    return sums.select("from_id", "to_id", "kind", F.col("count").alias("n"), F.size("source_refs").cast("long").alias("files"), spans.cast("long").alias("spans"))


@query(
    f"""WITH {bridge.HTTP_SQL}
SELECT CASE role WHEN 'Producer' THEN 'HttpEndpoint' ELSE 'HttpCallSite' END AS kind, count(*) AS n FROM routes WHERE page_id % 10 NOT IN (1, 4) GROUP BY 1
UNION ALL SELECT 'Method', count(*) FROM routes UNION ALL SELECT CASE role WHEN 'Producer' THEN 'HandlesRoute' ELSE 'CallsRoute' END, count(*) FROM routes WHERE page_id % 10 NOT IN (1, 4) GROUP BY 1"""
)
def owned_removal(spark, sf_dir):
    g = bridge.http_graph(spark, sf_dir)
    changed = spark.createDataFrame([("PAGES/1.ts",), ("pages/4.ts",)], "file string")
    return merge.counters(*merge.remove_owned(g.nodes, g.edges, changed)).select("kind", "n")


@query(
    f"""WITH {bridge.SUPPLY_SQL}
SELECT 'nodes' AS part, 'Project' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 'nodes', 'Package', count(DISTINCT (p_name, p_type, p_size, p_brand)) FROM part UNION ALL SELECT 'edges', 'DependsOn', count(*) FROM uses"""
)
def graph_counters(spark, sf_dir):
    g = bridge.supply_graph(spark, sf_dir)
    return merge.counters(g.nodes, g.edges)


# -- reconciliation (A9, A10) -------------------------------------------------------------------------------------------------------


def _endpoints(spark, sf_dir) -> PropertyGraph:
    """Every page is an endpoint of its path; source and version by its number, a summary that sources agree on or not."""
    pages = bridge.table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*", ""), "[0-9]+", "{id:int}")
    pages = pages.select("page_id", path.alias("path"), F.element_at(F.array(F.lit("openapi"), F.lit("project-api"), F.lit("v3")), (F.col("page_id") % 3 + 1).cast("int")).alias("version"))
    name = F.concat(F.lit("Page"), F.col("page_id").cast("string"))
    text = bridge.json_text
    nodes = pages.select(
        F.lit("main").alias("workspace"), node_id("HttpEndpoint", name, F.col("version")).alias("id"), F.lit("HttpEndpoint").alias("kind"), name.alias("fqn"), "version", name.alias("display_name"),
        F.create_map(F.lit("httpMethod"), F.lit('"GET"'), F.lit("routeTemplate"), text(F.lower("path")), F.lit("summary"), text(F.concat(F.lit("s"), (F.col("page_id") % 2).cast("string")))).alias("attributes"),
        F.array(F.struct(F.concat(F.lit("f"), (F.col("page_id") % 5).cast("string")).alias("file"), F.array().cast("array<struct<start_line:int,start_col:int,end_line:int,end_col:int>>").alias("spans"))).alias("source_refs"),
    )
    edges = pages.select(
        F.lit("main").alias("workspace"), F.concat(F.lit("Method:Handler"), (F.col("page_id") % 7).cast("string"), F.lit("@1")).alias("from_id"), node_id("HttpEndpoint", name, F.col("version")).alias("to_id"), F.lit("HandlesRoute").alias("kind"),
        F.create_map(F.lit("n"), F.col("page_id").cast("string")).alias("attributes"), F.lit(None).cast(bridge.REFS_DDL).alias("source_refs"),
    )
    return PropertyGraph(nodes, edges)


_ENDS = r"""
raw AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '[0-9]+', '{id:int}', 'g')) AS template, ['openapi', 'project-api', 'v3'][page_id % 3 + 1] AS version FROM pages),
ends AS (SELECT *, 'HttpEndpoint:Page' || page_id || '@' || version AS id, regexp_replace(replace(template, '{id:int}', '{id}'), '/+$', '') AS route, 's' || page_id % 2 AS summary, 'f' || page_id % 5 AS file,
         CASE version WHEN 'project-api' THEN 'static' ELSE version END AS source FROM raw),
canon AS (SELECT route, arg_min(id, CASE WHEN version = 'openapi' THEN '0' ELSE '1' END || id) AS canonical, count(*) AS size FROM ends GROUP BY route)"""


@query(
    f"""WITH {_ENDS}
SELECT canonical AS id, count(DISTINCT file) AS files, CASE WHEN count(DISTINCT summary) = 1 THEN 1 ELSE count(DISTINCT source) END + CASE WHEN count(DISTINCT template) = 1 THEN 1 ELSE count(DISTINCT source) END + 1 AS attributes
FROM ends JOIN canon USING (route) GROUP BY canonical"""
)
def reconcile_nodes(spark, sf_dir):
    return reconcile.reconcile_nodes(_endpoints(spark, sf_dir).nodes).select("id", F.size("source_refs").cast("long").alias("files"), F.size("attributes").cast("long").alias("attributes"))


@query(
    f"""WITH {_ENDS}, many AS (SELECT * FROM ends JOIN canon USING (route) WHERE size > 1),
v AS (SELECT canonical, id, source, 'summary' AS name, '"' || summary || '"' AS value FROM many UNION ALL SELECT canonical, id, source, 'routeTemplate', '"' || template || '"' FROM many UNION ALL SELECT canonical, id, source, 'httpMethod', '"GET"' FROM many),
n AS (SELECT canonical, name, count(DISTINCT value) = 1 AS agree FROM v GROUP BY ALL)
SELECT DISTINCT canonical, name, value FROM v JOIN n USING (canonical, name) WHERE agree
UNION ALL SELECT canonical, name || ':' || source, arg_max(value, id) FROM v JOIN n USING (canonical, name) WHERE NOT agree GROUP BY canonical, name, source"""
)
def reconcile_attributes(spark, sf_dir):
    return reconcile.merged_attributes(_endpoints(spark, sf_dir).nodes).select("canonical", "name", "value")


@query(f"WITH {_ENDS} SELECT DISTINCT 'Method:Handler' || page_id % 7 || '@1' AS from_id, canonical AS to_id, 'HandlesRoute' AS kind FROM ends JOIN canon USING (route)")
def reconcile_edges(spark, sf_dir):
    g = _endpoints(spark, sf_dir)
    return reconcile.reconcile_edges(g.nodes, g.edges).select("from_id", "to_id", "kind")


# -- changes (J11, S18, W5-W7) --------------------------------------------------------------------------------------------------------


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents as files: some missing in either, some changed."""
    docs = bridge.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "source", "de", "project", "fr", "dependency", "es", "http-spec")]), F.col("lang"))
    key = F.concat(kind, F.lit(":docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("key")
    hashed = lambda t: F.sha2(t.cast("binary"), 256).alias("sha256")
    new = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))
    return docs.where("doc_id % 10 <> 0").select(key, hashed(F.col("text"))), docs.where("doc_id % 7 <> 0").select(key, hashed(new))


_CHANGES = """
k AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'source' WHEN 'de' THEN 'project' WHEN 'fr' THEN 'dependency' ELSE 'http-spec' END AS kind FROM documents),
changed AS (SELECT kind, 'docs/' || doc_id || '.txt' AS rel_path, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change
            FROM k WHERE NOT (doc_id % 10 = 0 AND doc_id % 7 = 0) AND (doc_id % 10 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0))"""


@query(f"WITH {_CHANGES} SELECT kind, rel_path, change FROM changed")
def changed_files(spark, sf_dir):
    return changes.changed_files(*_snapshots(spark, sf_dir))


@query(f"WITH {_CHANGES} SELECT DISTINCT kind FROM changed")
def changed_kinds(spark, sf_dir):
    return changes.changed_kinds(changes.changed_files(*_snapshots(spark, sf_dir)))


_READS = ", ".join(f"('{k}', '{p}')" for k, p in changes.PROVIDERS)


@query(f"WITH {_CHANGES} SELECT DISTINCT provider_id FROM changed JOIN (VALUES {_READS}) r(kind, provider_id) USING (kind) WHERE change = 'deleted' AND kind <> 'source'")
def provider_selection(spark, sf_dir):
    return changes.providers_to_run(changes.changed_files(*_snapshots(spark, sf_dir)).where("change = 'deleted' and kind <> 'source'"))


_NAMES = ("src/App.cs", "web/app.tsx", "obj/project.assets.json", "Directory.Build.props", "api/openapi.yaml", "readme.md", "x/Y.CSPROJ", "calls.http", "bin/swagger.json", "c.postman_collection.json", "packages.lock.json")


@query(
    f"""WITH p AS (SELECT doc_id, {list(_NAMES)}[doc_id % {len(_NAMES)} + 1] AS path FROM documents)
SELECT doc_id, path, {[None if x is None else x for x in ("source", "source", "dependency", "project", "http-spec", "", "project", "http-spec", "", "http-spec", "dependency")]}[doc_id % {len(_NAMES)} + 1] AS kind FROM p"""
)
def classify_files(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    return bridge.table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).select("doc_id", "path", F.coalesce(changes.classify(F.col("path")), F.lit("")).alias("kind"))


# -- scanners (S4-S6, S13-S16, S19) -----------------------------------------------------------------------------------------------------


def _scripts(spark, sf_dir) -> DataFrame:
    """A script for each page, with a fetch, a fetch of a template and two axios calls of its url."""
    q = F.col("url")
    text = F.concat(F.lit("// calls\nfetch('"), q, F.lit("', { method: 'put' })\nfetch(`"), q, F.lit("/${x}`); axios.get(\""), q, F.lit("\")\nAXIOS.Post(`/a/${b}/"), F.col("page_id").cast("string"), F.lit("`)"))
    return bridge.dealt(spark, sf_dir, "pages", "page_id", "url").select(F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".ts")).alias("file"), text.alias("text"))


@query(
    """WITH f AS (SELECT 'web/' || page_id || '.ts' AS file, page_id, url FROM pages)
SELECT file, 2 AS line_no, 'PUT' AS method, url AS url_template, 'high' AS confidence FROM f
UNION ALL SELECT file, 3, 'GET', url || '/{var}', 'medium' FROM f UNION ALL SELECT file, 3, 'GET', url, 'high' FROM f UNION ALL SELECT file, 4, 'POST', '/a/{var}/' || page_id, 'medium' FROM f"""
)
def js_scan(spark, sf_dir):
    return script.scan(_scripts(spark, sf_dir))


@query("SELECT left(sha256('web/' || page_id || '.ts'), 8) AS version, count(*) AS n FROM pages, range(4) GROUP BY page_id")
def js_call_sites(spark, sf_dir):
    # by file: among very many files some share the eight digits of their hash
    return script.nodes(script.scan(_scripts(spark, sf_dir))).groupBy("version", F.col("source_refs")[0]["file"].alias("file")).agg(F.count(F.lit(1)).alias("n")).select("version", "n")


@query("SELECT page_id, regexp_replace(url, '[0-9]+', '{var}', 'g') AS template FROM pages")
def url_templates(spark, sf_dir):
    marked = F.regexp_replace("url", "([0-9]+)", r"\${n$1}")
    return bridge.table(spark, sf_dir, "pages").select("page_id", url_template(marked).alias("template"))


@query(
    """SELECT 'c' || conv_id AS file, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block, turn AS line_no FROM conversations"""
)
def request_blocks(spark, sf_dir):
    lines = bridge.table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("line_no"), F.when(F.col("role") == "user", "### next").otherwise("text").alias("text"))
    return requests.blocks(lines).select("file", "block", "line_no")


@query(
    """SELECT 'r' || page_id AS file, CAST(2 AS BIGINT) AS block, 7 AS line_no, 'POST' AS method, url || '/{user}' AS url_template, 'call' || page_id AS name, 'application/json' AS accept FROM pages
UNION ALL SELECT 'r' || page_id, 1, 3, 'GET', url, 'first', NULL FROM pages"""
)
def http_file_scan(spark, sf_dir):
    text = F.concat(F.lit("###\n# @name first\nGET "), F.col("url"), F.lit("\n\nbody: no header\n### call"), F.col("page_id").cast("string"), F.lit("\npost "), F.col("url"), F.lit("/{{user}}\nAccept: text/html\nACCEPT: application/json\n\n{}"))
    files = bridge.table(spark, sf_dir, "pages").select(F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("file"), text.alias("text"))
    return requests.scan(script.lines(files)).select("file", "block", "line_no", "method", "url_template", "name", F.try_element_at("headers", F.lit("Accept")).alias("accept"))


@query(
    """SELECT r_name AS collection, n_name AS folder, c_name AS name, 'GET' AS method, '/customers/' || c_custkey || '/{part}' AS url_template FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, '', 'Health', 'POST', '/health' FROM region"""
)
def postman_tree(spark, sf_dir):
    c, n, r = (bridge.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    url = F.concat(F.lit("{{base}}/customers/"), F.col("c_custkey").cast("string"), F.lit("/{{part}}"))
    leaf = c.select("c_nationkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.lit("get").alias("method"), F.struct(url.alias("raw")).alias("url")).alias("request"))).alias("j"))
    folder = leaf.groupBy("c_nationkey").agg(F.array_join(F.collect_list("j"), ",").alias("items")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", F.concat(F.lit('{"name":"'), F.col("n_name"), F.lit('","item":['), F.col("items"), F.lit("]}")).alias("j"))
    top = folder.groupBy("n_regionkey").agg(F.array_join(F.collect_list("j"), ",").alias("items")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    health = '{"name":"Health","request":{"method":"POST","url":"{{base}}/health"}}'
    text = F.concat(F.lit('{"info":{"name":"'), F.col("r_name"), F.lit('"},"variable":[{"key":"base","value":"https://host:1"}],"item":[' + health + ","), F.col("items"), F.lit("]}"))
    return postman.scan(top.select(F.col("r_name").alias("file"), text.alias("text"))).select("collection", "folder", "name", "method", "url_template")


def _specifications(spark, sf_dir) -> DataFrame:
    """A specification for each customer: two operations, schemas in a response, a request and (which does not count) a parameter."""
    k = F.col("c_custkey").cast("string")
    get = F.concat(F.lit('"get":{"operationId":"get'), k, F.lit('","summary":"Reads","tags":["x","'), F.col("c_mktsegment"), F.lit('"],"parameters":[{"schema":{"$ref":"#/components/schemas/Key"}}],"responses":{"200":{"schema":{"$ref":"#/components/schemas/C'), k, F.lit('"}}}}'))
    text = F.concat(F.lit('{"openapi":"3.0.0","paths":{"/c'), k, F.lit('/{id}":{'), get, F.lit(',"delete":{"responses":{}},"parameters":[]}}}'))
    return bridge.dealt(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(F.concat(F.lit("api/openapi"), k, F.lit(".json")).alias("file"), text.alias("text"))


@query(
    """SELECT 'GET' AS method, '/c' || c_custkey || '/{id}' AS path, 'get' || c_custkey AS operation_id, 'Reads' AS summary, c_mktsegment || ',' || 'x' AS tags, 'C' || c_custkey AS schema_refs FROM customer
UNION ALL SELECT 'DELETE', '/c' || c_custkey || '/{id}', NULL, NULL, NULL, '' FROM customer"""
)
def openapi_operations(spark, sf_dir):
    return openapi.scan(_specifications(spark, sf_dir)).select("method", "path", "operation_id", "summary", "tags", "schema_refs")


@query(
    """SELECT s_name || '.slnx' AS file, 'src/P' || s_suppkey || '.csproj' AS project_path FROM supplier
UNION ALL SELECT s_name || '.sln', 'src/Q' || s_suppkey || '.csproj' FROM supplier"""
)
def solution_projects(spark, sf_dir):
    s = bridge.table(spark, sf_dir, "supplier").select("s_name", F.col("s_suppkey").cast("string").alias("k"))
    xml = s.select(F.concat("s_name", F.lit(".slnx")).alias("file"), F.concat(F.lit('<Solution><Folder Name="/src/"><Project Path="src/P'), "k", F.lit('.csproj"/><Project Path="docs/x.md"/></Folder></Solution>')).alias("text"))
    sln = s.select(F.concat("s_name", F.lit(".sln")).alias("file"), F.concat(F.lit('Microsoft\r\nProject("{A}") = "Q", "src\\Q'), "k", F.lit('.csproj", "{B}"\r\nEndProject\r\nProject("{C}") = "d", "docs", "{D}"')).alias("text"))
    return solution.projects(xml.unionByName(sln))


@query(
    """SELECT s_name AS project, 'Pkg.' || s_suppkey AS package, '1.' || s_nationkey AS version, 'net10.0' AS tfm, true AS is_direct, 'pkg/' || s_suppkey AS path FROM supplier
UNION ALL SELECT s_name, 'Deep', '2.0', 'net10.0', false, 'deep' FROM supplier"""
)
def package_dependencies(spark, sf_dir):
    k, v = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    ident = F.concat(F.lit('"Pkg.'), k, F.lit("/1."), v, F.lit('":'))
    text = F.concat(
        F.lit('{"targets":{"net10.0":{'), ident, F.lit('{"type":"package"},"Deep/2.0":{"type":"package"},"Own/1.0":{"type":"project"}}},"libraries":{'), ident, F.lit('{"type":"package","path":"pkg/'), k,
        F.lit('","files":["lib/a.dll"]},"Deep/2.0":{"type":"package","path":"deep","files":[]},"Own/1.0":{"type":"project","path":"own"}},"project":{"frameworks":{"net10.0":{"dependencies":{"pkg.'), k, F.lit('":{"target":"Package","version":"[1.0, )"}}}}},"packageFolders":{"/nuget/":{}}}'),
    )
    return solution.dependencies(bridge.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("project"), text.alias("text")))


@query(
    f"""WITH {bridge.USAGE_SQL}, {bridge.LINES_SQL}, asked AS (SELECT DISTINCT file, start_line, end_line FROM places)
SELECT a.file AS file, a.start_line AS start_line, excerpt FROM asked a LEFT JOIN excerpts e ON e.file = a.file AND e.start_line = a.start_line AND e.end_line = a.end_line"""
)
def source_excerpt(spark, sf_dir):
    g = bridge.usage_graph(spark, sf_dir)
    wanted = g.nodes.where(F.col("fqn").startswith("Part")).select(F.col("id").alias("symbol_id")).distinct()
    places = usages.find_usages(g, wanted).select("file", "start_line", "end_line").distinct()
    return usages.excerpts(places, bridge.source_lines(spark, sf_dir)).select("file", "start_line", "excerpt")


# -- streams, as batches (A4, W3, W11) --------------------------------------------------------------------------------------------------


@query("SELECT event_type AS tool, count(*) AS calls, min(ts) AS first_called, max(ts) AS last_called FROM events GROUP BY event_type")
def tool_statistics(spark, sf_dir):
    s = statistics.summarize(bridge.table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.col("ts").alias("called_at")))
    return s.select("tool", "calls", "first_called", "last_called")


@query(
    """WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM e)
SELECT CAST(user_id AS VARCHAR) AS workspace, epoch_us(min(ts)) AS started, count(*) AS events, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS paths FROM s GROUP BY user_id, island"""
)
def debounce_batches(spark, sf_dir):
    events = bridge.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("workspace"), "ts", F.col("event_type").alias("path"))
    return stream_changes.debounce(events, "10 minutes").select("workspace", F.unix_micros("started").alias("started"), "events", "paths")


@query("SELECT page_id, left(sha256(url), 8) AS hash FROM pages")
def short_hashes(spark, sf_dir):
    return bridge.table(spark, sf_dir, "pages").select("page_id", short_hash(F.col("url")).alias("hash"))


# -- C# (S8-S12) -------------------------------------------------------------------------------------------------------------------------


def _sources(spark, sf_dir) -> DataFrame:
    """A C# file for each customer: a controller, mapped routes, client calls with a text, a constant of another file and a format, and uses of a known type."""
    n = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    text = F.concat(
        F.lit('using X;\nnamespace Shop;\n[Route("api/[controller]")]\npublic sealed class '), n, F.lit('Controller : ShopController\n{\n    // [HttpPut("no")]\n    [HttpGet("{id:int}")]\n    [ProducesResponseType(404)] [ProducesResponseType(typeof(X), 200)]\n    public IActionResult Read(int id) { return Ok(); }\n    [HttpPost] private void Hidden() { }\n}\n'),
        F.lit("public class Client"), n, F.lit('\n{\n    public Task Send(string s)\n    {\n        app.MapPost("'), n, F.lit('/{x:guid}", Client'), n, F.lit('.Send);\n        app.MapGet(s, () => 1);\n        var part = new Part'), n, F.lit('();\n        part.Ship(s);\n        http.PutAsync(Routes.Base + "/'), n, F.lit('");\n        http.DeleteAsync(string.Format("/d/{0}/'), n, F.lit('", s));\n        return http.GetAsync($"/api/{s}/'), n, F.lit('");\n    }\n}\n'),
    )
    base = spark.createDataFrame([("src/App/Base.cs", 'namespace Shop;\npublic class ShopController : ControllerBase { }\npublic static class Routes { const string Root = "/v1"; public const string Base = Root + "/b"; }\n')], "file string, text string")
    return bridge.dealt(spark, sf_dir, "customer", "c_custkey").select(F.concat(F.lit("src/App/"), n, F.lit(".cs")).alias("file"), text.alias("text")).unionByName(base)


_HTTP_SCAN = """
k AS (SELECT 'C' || c_custkey AS n, 'src/App/C' || c_custkey || '.cs' AS file FROM customer),
found AS (
SELECT n, file, 'controller' AS scanner, 'GET' AS method, '/api/' || lower(n) || '/{id}' AS route, 'Shop.' || n || 'Controller.Read(int)' AS source, 'high' AS confidence, 7 AS line FROM k
UNION ALL SELECT n, file, 'minimal-api', 'POST', '/' || n || '/{x}', 'Shop.Client' || n || '.Send(string)', 'high', 16 FROM k
UNION ALL SELECT n, file, 'minimal-api', 'GET', '/unknown', 'lambda:17', 'low', 17 FROM k
UNION ALL SELECT n, file, 'http-client', 'PUT', '/v1/b/' || n, 'Shop.Client' || n || '.Send(string)', 'high', 20 FROM k
UNION ALL SELECT n, file, 'http-client', 'DELETE', '/d/{var}/' || n, 'Shop.Client' || n || '.Send(string)', 'high', 21 FROM k
UNION ALL SELECT n, file, 'http-client', 'GET', '/api/{var}/' || n, 'Shop.Client' || n || '.Send(string)', 'high', 22 FROM k)"""


@query(f"WITH {_HTTP_SCAN} SELECT file, scanner, method, route, source, confidence, line FROM found")
def csharp_http_scan(spark, sf_dir):
    return csharp.scan_http(_sources(spark, sf_dir)).select("file", "scanner", "method", "route", "source", "confidence", "line")


@query(
    """SELECT 'src/App/C' || c_custkey || '.cs' AS file, 'Shop.ClientC' || c_custkey || '.Send(string)' AS source, 'Uses' AS usage, 'Type:PartC' || c_custkey AS symbol_id, 18 AS line, 'medium' AS confidence FROM customer
UNION ALL SELECT 'src/App/C' || c_custkey || '.cs', 'Shop.ClientC' || c_custkey || '.Send(string)', 'Calls', 'Method:Ship', 19, 'medium' FROM customer"""
)
def csharp_usage_scan(spark, sf_dir):
    n = F.concat(F.lit("PartC"), F.col("c_custkey").cast("string"))
    types = bridge.table(spark, sf_dir, "customer").select(F.concat(F.lit("Type:"), n).alias("symbol_id"), F.lit("Type").alias("kind"), n.alias("name"))
    symbols = types.unionByName(spark.createDataFrame([("Method:Ship", "Method", "Ship")], "symbol_id string, kind string, name string"))
    return csharp.scan_uses(_sources(spark, sf_dir), symbols).select("file", "source", "usage", "symbol_id", "line", "confidence")


# -- package symbols (the graph side of S7; J16, J17) ---------------------------------------------------------------------------------------


def _symbols(spark, sf_dir) -> DataFrame:
    """A type for each customer: its base is the customer before it or an outside type, its interfaces its nation's, some with the base already."""
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    return bridge.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("package"), F.lit("1").alias("version"), F.concat("c_mktsegment", F.lit(".Core")).alias("assembly"), F.lit("N").alias("namespace"), F.concat(F.lit("T"), text(key)).alias("type"), F.lit("class").alias("kind"),
        F.when(key % 7 == 0, F.lit("System.Object")).when(key % 4 == 1, F.lit("Ext.Base")).otherwise(F.concat(F.lit("N.T"), text(key - 1))).alias("base"), F.array(F.concat(F.lit("Ext.I"), text(F.col("c_nationkey"))), F.lit("Ext.IAll")).alias("interfaces"),
        F.when(key % 2 == 0, F.array(F.lit("Ext.IAll"))).alias("inherited"), F.array(F.struct(F.lit("Go").alias("name"), F.lit("Go(int)").alias("signature"))).alias("methods"),
    )


@query(
    """WITH t AS (SELECT c_custkey AS k, c_nationkey AS r, 'Type:N.T' || c_custkey || '@1' AS id FROM customer)
SELECT id AS from_id, CASE WHEN k % 4 = 1 THEN 'ExternalRef:Ext.Base@external' WHEN k - 1 IN (SELECT k FROM t) THEN 'Type:N.T' || (k - 1) || '@1' ELSE 'ExternalRef:N.T' || (k - 1) || '@external' END AS to_id, 'Inherits' AS kind FROM t WHERE k % 7 <> 0
UNION ALL SELECT id, 'ExternalRef:Ext.I' || r || '@external', 'Implements' FROM t UNION ALL SELECT id, 'ExternalRef:Ext.IAll@external', 'Implements' FROM t WHERE k % 2 = 1
UNION ALL SELECT id, 'Method:N.T' || k || '.Go~0028int~0029@1', 'Contains' FROM t"""
)
def symbol_relations(spark, sf_dir):
    g = symbols.graph(_symbols(spark, sf_dir))
    return g.edges.where(F.col("from_id").startswith("Type:")).select("from_id", "to_id", "kind")

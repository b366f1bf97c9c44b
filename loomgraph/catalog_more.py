"""Providers, builds, storage and small functions by name, each with its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import bridge, catalog_build, providers
from loomgraph.build import build, update
from loomgraph.catalog import query
from loomgraph.functions import attributes as attr
from loomgraph.functions import ids, paths, routes
from loomgraph.lineage import shared_folder
from loomgraph.operators import changes, merge
from loomgraph.operators.graph import PropertyGraph, dangling, node_order
from loomgraph.plans import http, scope
from loomgraph.sources import solution, store
from loomgraph.streaming import changes as stream_changes
from loomgraph.streaming import statistics

# -- what the providers make of files (U1) ------------------------------------------------------------------------------------------------


def esc(text: str) -> str:
    """DuckDB SQL of a text with the characters escaped that the made-up files have."""
    for c in "~ /{}():@":
        text = f"replace({text}, '{c}', '~{ord(c):04X}')"
    return text


def _code(spark, sf_dir) -> DataFrame:
    """The C# files, with the project that they belong to."""
    project = spark.createDataFrame([("src/App/App.csproj", "<Project/>"), ("Shop.sln", 'Project("{A}") = "App", "src\\App\\App.csproj", "{B}"')], "file string, text string")
    return catalog_build._sources(spark, sf_dir).unionByName(project)


_TOKEN = "project-src/App/App"
_END = f"'HttpEndpoint:' || {esc('method || chr(32) || route')} || '@{_TOKEN.replace('/', '~002F')}'"
_BY = f"'Method:' || {esc('source')} || '@{_TOKEN.replace('/', '~002F')}'"


@query(f"""WITH {catalog_build._HTTP_SCAN} SELECT {_END} AS id, method || ' ' || route AS display_name, '["Shop.' || n || 'Controller","Read",[200,404]]' AS said, file, line FROM found WHERE scanner = 'controller'""")
def controller_nodes(spark, sf_dir):
    nodes, _ = providers.controllers(spark, _code(spark, sf_dir))
    a = F.col("attributes")
    said = F.concat(F.lit("["), F.concat_ws(",", a["controllerType"], a["actionName"], a["responseTypes"]), F.lit("]"))
    return nodes.select("id", "display_name", said.alias("said"), F.col("source_refs")[0]["file"].alias("file"), F.col("source_refs")[0]["spans"][0]["start_line"].alias("line"))


@query(f"""WITH {catalog_build._HTTP_SCAN}, hashed AS (SELECT *, sha256(file) AS h FROM found)
SELECT CASE WHEN source LIKE 'lambda%' THEN 'Method:lambda~0040' || n || '-' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '~003A17@{_TOKEN.replace("/", "~002F")}' ELSE {_BY} END AS from_id, {_END} AS to_id, 'HandlesRoute' AS kind
FROM hashed WHERE scanner IN ('controller', 'minimal-api')""")
def handles_route_edges(spark, sf_dir):
    files = _code(spark, sf_dir)
    return providers.controllers(spark, files)[1].unionByName(providers.minimal_api(spark, files)[1]).select("from_id", "to_id", "kind")


@query(f"""WITH {catalog_build._HTTP_SCAN} SELECT {_END} AS id, 'HttpEndpoint' AS kind, confidence FROM found WHERE scanner = 'minimal-api'
UNION ALL SELECT {_BY}, 'Method', NULL FROM found WHERE scanner = 'minimal-api' AND source LIKE 'Shop%'
UNION ALL SELECT 'Method:lambda~0040' || n || '-' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '~003A17@{_TOKEN.replace("/", "~002F")}', 'Method', NULL FROM (SELECT *, sha256(file) AS h FROM found) WHERE source LIKE 'lambda%'""")
def minimal_api_nodes(spark, sf_dir):
    nodes, _ = providers.minimal_api(spark, _code(spark, sf_dir))
    return nodes.select("id", "kind", attr.text(F.col("attributes"), "confidence").alias("confidence"))


@query(f"""WITH {catalog_build._HTTP_SCAN} SELECT {_BY} AS from_id, 'HttpCallSite:' || {esc("method || ' ' || route || '@' || left(sha256(file || ':' || (line - 1)), 8)")} || '@{_TOKEN.replace("/", "~002F")}' AS to_id, 'CallsRoute' AS kind, line FROM found WHERE scanner = 'http-client'""")
def calls_route_edges(spark, sf_dir):
    edges = providers.client_calls(spark, _code(spark, sf_dir))[1]
    return edges.select("from_id", "to_id", "kind", F.col("source_refs")[0]["spans"][0]["start_line"].alias("line"))


@query(f"""WITH o AS (SELECT 'api/openapi' || c_custkey || '.json' AS f, '/c' || c_custkey || '/{{id}}' AS p, unnest(['GET', 'DELETE']) AS m, c_mktsegment AS s, c_custkey AS k FROM customer)
SELECT 'HttpEndpoint:' || {esc("m || ' ' || p")} || '@openapi' AS id, CASE m WHEN 'GET' THEN '["' || s || '","x"]' END AS tags, CASE m WHEN 'GET' THEN '["C' || k || '"]' END AS schemas FROM o
UNION ALL SELECT 'ExternalRef:' || replace({esc("f || '#' || p || ' ' || m")}, '#', '~0023') || '@openapi', NULL, NULL FROM o""")
def openapi_nodes(spark, sf_dir):
    nodes, _ = providers.specifications(spark, catalog_build._specifications(spark, sf_dir))
    return nodes.select("id", F.try_element_at("attributes", F.lit("tags")).alias("tags"), F.try_element_at("attributes", F.lit("schemaRefs")).alias("schemas"))


@query(f"""WITH o AS (SELECT 'api/openapi' || c_custkey || '.json' AS f, '/c' || c_custkey || '/{{id}}' AS p, unnest(['GET', 'DELETE']) AS m FROM customer)
SELECT 'HttpEndpoint:' || {esc("m || ' ' || p")} || '@openapi' AS from_id, 'ExternalRef:' || replace({esc("f || '#' || p || ' ' || m")}, '#', '~0023') || '@openapi' AS to_id, 'DescribedBy' AS kind FROM o""")
def described_by_edges(spark, sf_dir):
    return providers.specifications(spark, catalog_build._specifications(spark, sf_dir))[1].select("from_id", "to_id", "kind")


def _requests(spark, sf_dir) -> DataFrame:
    """A request file for each page: a title and a name, a body that looks like a request, a relative url, and blocks that have no request."""
    url, k = F.col("url"), F.col("page_id").cast("string")
    text = F.concat(
        F.lit("### List it\n# @name ignored\nGET "), url, F.lit("\nAccept: a\n// no header\naccept: b\nno header\nX: y\n\n###\n#  @NAME second more\n\npost api/p"), k, F.lit("/{{user}} HTTP/1.1\n\nGET /body\n###\n# nothing\n###\njust text\nGET /late\n### Last\nDELETE localhost:5000/x"), k,
    )
    return bridge.table(spark, sf_dir, "pages").select(F.concat(F.lit("calls/"), k, F.lit(".http")).alias("file"), text.alias("text"))


@query(
    """WITH f AS (SELECT 'calls/' || page_id || '.http' AS file, url, page_id AS k FROM pages),
r AS (SELECT file, 0 AS block, 'GET' AS method, url AS u, 'List it' AS name, 3 AS line, '{"Accept":"b"}' AS headers FROM f
UNION ALL SELECT file, 1, 'POST', 'api/p' || k || '/{user}', 'second', 13, NULL FROM f UNION ALL SELECT file, 4, 'DELETE', 'localhost:5000/x' || k, 'Last', 22, NULL FROM f)
SELECT 'HTTP.' || method || '.' || u || '.' || left(sha256(file), 8) || '.' || block AS fqn, left(sha256(file), 8) AS version, method || ' ' || u || ' (' || name || ')' AS display_name, headers, line, file FROM r"""
)
def http_file_nodes(spark, sf_dir):
    nodes, _ = providers.request_files(spark, _requests(spark, sf_dir))
    ref = F.col("source_refs")[0]
    return nodes.select("fqn", "version", "display_name", F.try_element_at("attributes", F.lit("headers")).alias("headers"), ref["spans"][0]["start_line"].alias("line"), ref["file"].alias("file"))


def _collections(spark, sf_dir) -> DataFrame:
    """A collection for each customer: a folder with a request, one of the top level, one without a url."""
    k = F.col("c_custkey").cast("string")
    one = F.concat(F.lit('{"name":"one","request":{"method":"get","url":{"raw":"{{base}}/c/'), k, F.lit('/{{part}}"}}}'))
    text = F.concat(F.lit('{"variable":[{"key":"base","value":"https://h:1"}],"item":[{"name":"F","item":['), one, F.lit(']},{"name":"","request":{"method":"PUT","url":{"path":["x","","'), k, F.lit('"]}}},{"name":"none","request":{"method":"GET"}}]}'))
    return bridge.dealt(spark, sf_dir, "customer", "c_custkey").select(F.concat(F.lit("pm/c"), k, F.lit(".postman_collection.json")).alias("file"), text.alias("text"))


@query(
    """WITH f AS (SELECT 'pm/c' || c_custkey || '.postman_collection.json' AS file, c_custkey AS k FROM customer)
SELECT 'Postman.GET./c/' || k || '/{part}.' || left(sha256(file), 8) || '.one' AS fqn, 'GET /c/' || k || '/{part}' AS display_name, 'c' || k || '.postman_collection' AS collection, 'F' AS folder, 'one' AS name FROM f
UNION ALL SELECT 'Postman.PUT./x/' || k || '.' || left(sha256(file), 8) || '.', 'PUT /x/' || k, 'c' || k || '.postman_collection', NULL, NULL FROM f"""
)
def postman_nodes(spark, sf_dir):
    nodes, _ = providers.collections(spark, _collections(spark, sf_dir))
    a = F.col("attributes")
    return nodes.select("fqn", "display_name", attr.text(a, "collectionName").alias("collection"), attr.text(a, "folderPath").alias("folder"), attr.text(a, "requestName").alias("name"))


@query(
    """WITH f AS (SELECT 'web/' || page_id || '.ts' AS file, url, page_id AS k FROM pages),
r AS (SELECT file, 2 AS line, 'PUT' AS m, url AS u, 'high' AS confidence FROM f UNION ALL SELECT file, 3, 'GET', url || '/{var}', 'medium' FROM f UNION ALL SELECT file, 3, 'GET', url, 'high' FROM f UNION ALL SELECT file, 4, 'POST', '/a/{var}/' || k, 'medium' FROM f)
SELECT 'JS.' || m || '.' || u || '.' || left(sha256(file), 8) || '.' || line AS fqn, left(sha256(file), 8) AS version, m || ' ' || u AS display_name, confidence FROM r"""
)
def script_nodes(spark, sf_dir):
    nodes, _ = providers.scripts(spark, catalog_build._scripts(spark, sf_dir))
    return nodes.select("fqn", "version", "display_name", attr.text(F.col("attributes"), "confidence").alias("confidence"))


def _assets(spark, sf_dir) -> DataFrame:
    """A project for each supplier with two frameworks, and the packages that they come to."""
    k, v = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    ident = F.concat(F.lit('"Pkg.'), k, F.lit("/1."), v, F.lit('":'))
    later = F.concat(F.lit('"Pkg.'), k, F.lit('/2.0":'))
    text = F.concat(
        F.lit('{"targets":{"net10.0":{'), later, F.lit('{"type":"package"}},"net8.0":{'), ident, F.lit('{"type":"package"},"Deep/2.0":{"type":"package"}}},"libraries":{'), ident, F.lit('{"type":"package","path":"pkg/'), k,
        F.lit('","files":["lib/a.dll","a.xml"]},'), later, F.lit('{"type":"package","path":"pkg2","files":["lib/net10.0/b.dll","lib/c.DLL"]},"Deep/2.0":{"type":"package","path":"deep","files":[]}},"project":{"frameworks":{"net8.0":{"dependencies":{"pkg.'), k,
        F.lit('":{"target":"Package","version":"[1.0, )"}}}}},"packageFolders":{"/nuget/":{},"/more":{}}}'),
    )
    home = F.concat(F.lit("p/"), k, F.lit("/"))
    rows = bridge.table(spark, sf_dir, "supplier")
    return rows.select(F.concat(home, F.lit("obj/project.assets.json")).alias("file"), text.alias("text")).unionByName(rows.select(F.concat(home, F.lit("P"), k, F.lit(".csproj")).alias("file"), F.lit("<Project/>").alias("text")))


@query(
    """SELECT 'Project:P' || s_suppkey || '@project' AS from_id, 'Package:Pkg.' || s_suppkey || '@1.' || s_nationkey AS to_id, 'true' AS direct, 'net8.0' AS tfm, '["net10.0","net8.0"]' AS frameworks FROM supplier
UNION ALL SELECT 'Project:P' || s_suppkey || '@project', 'Package:Deep@2.0', 'false', 'net8.0', '["net10.0","net8.0"]' FROM supplier
UNION ALL SELECT 'Project:P' || s_suppkey || '@project', 'Package:Pkg.' || s_suppkey || '@2.0', 'false', 'net10.0', '["net10.0","net8.0"]' FROM supplier"""
)
def project_graph(spark, sf_dir):
    nodes, edges = providers.dotnet()(spark, _assets(spark, sf_dir))
    named = nodes.where("kind = 'Project'").select(F.col("id").alias("from_id"), F.col("attributes")["targetFrameworks"].alias("frameworks"))
    a = F.col("attributes")
    return edges.join(named, "from_id").select("from_id", "to_id", a["isDirect"].alias("direct"), attr.text(a, "tfm").alias("tfm"), "frameworks")


@query(
    """SELECT 'Pkg.' || s_suppkey AS package, '1.' || s_nationkey AS version, '/more/pkg/' || s_suppkey || '/lib/a.dll|/nuget/pkg/' || s_suppkey || '/lib/a.dll' AS dlls FROM supplier
UNION ALL SELECT 'Pkg.' || s_suppkey, '2.0', '/more/pkg2/lib/c.DLL|/more/pkg2/lib/net10.0/b.dll|/nuget/pkg2/lib/c.DLL|/nuget/pkg2/lib/net10.0/b.dll' FROM supplier"""
)
def package_files(spark, sf_dir):
    assets = _assets(spark, sf_dir).where("file like '%.json'").select(F.col("file").alias("project"), "text")
    found = solution.assemblies(assets).distinct().groupBy("package", "version").agg(F.array_sort(F.collect_set("dll")).alias("dlls"))  # the files of one package
    return found.select("package", "version", F.array_join("dlls", "|").alias("dlls"))


@query("SELECT 'P' || l_partkey AS package, max({'n': CAST(year(l_shipdate) AS VARCHAR), 'v': CAST(l_suppkey AS VARCHAR)}).v AS version FROM lineitem GROUP BY l_partkey")
def last_versions(spark, sf_dir):
    line = bridge.table(spark, sf_dir, "lineitem")
    return merge.last_version(line.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("package"), F.col("l_suppkey").cast("string").alias("version"), F.year("l_shipdate").cast("string").alias("tfm_ord")))


# -- builds (W5-W9, K2, S21) -----------------------------------------------------------------------------------------------------------------


def _hashes(files: DataFrame) -> DataFrame:
    return files.select(F.concat_ws(":", changes.classify(F.col("file")), "file").alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).where("key like '%:%'")


def _room(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/graph-{uuid.uuid4().hex}"


_INCREMENTAL = f"""
before AS (SELECT 'web/' || page_id || '.ts' AS file, page_id AS k, url FROM pages WHERE page_id % 5 <> 0),
later AS (SELECT 'web/' || page_id || '.ts' AS file, page_id AS k, CASE WHEN page_id % 3 = 0 THEN url || '/new' ELSE url END AS u FROM pages WHERE page_id % 7 <> 0)"""


@query(f"""WITH {_INCREMENTAL} SELECT 'JS.GET.' || u || '.' || left(sha256(file), 8) || '.1' AS fqn, file FROM later
UNION ALL SELECT 'HTTP.GET.' || url || '.' || left(sha256('a/' || page_id || '.http'), 8) || '.0', 'a/' || page_id || '.http' FROM pages""")
def incremental_graph(spark, sf_dir):
    """The graph after files were added, changed and deleted, from the cached fragments of what needs no new run."""
    pages = bridge.table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".ts")).alias("file"))
    calls = pages.select(F.concat(F.lit("a/"), F.col("page_id").cast("string"), F.lit(".http")).alias("file"), F.concat(F.lit("GET "), F.col("url")).alias("text"))
    fetch = lambda u: F.concat(F.lit("fetch('"), u, F.lit("')")).alias("text")
    old = pages.where("page_id % 5 <> 0").select("file", fetch(F.col("url"))).unionByName(calls)
    new = pages.where("page_id % 7 <> 0").select("file", fetch(F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/new"))).otherwise(F.col("url")))).unionByName(calls)
    some = [p for p in providers.standard() if p.id in ("js-fetch-callsite", "http-file-callsite")]
    room = _room(spark)
    first = build(spark, some, old, cache=room)
    graph = update(spark, some, first, _hashes(old), _hashes(new), new, cache=room)
    return graph.nodes.select("fqn", F.col("source_refs")[0]["file"].alias("file"))


@query(
    f"""WITH {catalog_build._HTTP_SCAN}, asked AS (SELECT * FROM found WHERE n = 'C7' AND scanner = 'controller')
SELECT 'Producer' AS role, {_END} AS node_id, {_BY} AS source, route AS written, file, line FROM asked
UNION ALL SELECT 'Consumer', 'HttpCallSite:' || {esc("'JS.GET./api/c7/{id}.' || left(sha256('web/page.ts'), 8) || '.1'")} || '@' || left(sha256('web/page.ts'), 8), NULL, '/api/c7/{{id}}', 'web/page.ts', 1 FROM asked"""
)
def built_trace(spark, sf_dir):
    """From files to an answer: all eight providers over a workspace, then who serves and calls a route."""
    page = spark.createDataFrame([("web/page.ts", "fetch('/api/c7/{id}')")], "file string, text string")
    graph = build(spark, providers.standard(), _code(spark, sf_dir).unionByName(page))
    return http.trace_http(graph, "GET", "/API/C7/{id:int}", match_on="coalesce").select("role", "node_id", "source", "written", "file", "line")


@query(f"WITH {catalog_build._CHANGES} SELECT DISTINCT rel_path AS file FROM changed")
def changed_file_set(spark, sf_dir):
    found = changes.changed_files(*catalog_build._snapshots(spark, sf_dir))
    return changes.changed_set(found.where("kind = 'source'"), found, found.where("change = 'added'"))


_PLACES = ("src/A.cs", "web/bin/b.ts", "obj/project.assets.json", "x/obj/y.cs", "node_modules/z.js", "api/swagger.yml", "notes.txt", "X.CSPROJ", ".git/c.cs", "q.rest")
_KINDS = ("source", "", "dependency", "", "", "http-spec", "", "project", "", "http-spec")


@query(f"""WITH p AS (SELECT doc_id, text, {list(_PLACES)}[doc_id % 10 + 1] AS path, {list(_KINDS)}[doc_id % 10 + 1] AS kind FROM documents)
SELECT kind || ':' || doc_id || '/' || path AS key, kind, doc_id || '/' || path AS rel_path, sha256(coalesce(text, '')) AS sha256 FROM p WHERE kind <> ''""")
def workspace_hashes(spark, sf_dir):
    path = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("doc_id") % 10 + 1).cast("int")))
    files = bridge.table(spark, sf_dir, "documents").select(path.alias("rel_path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return changes.input_hashes(files)


_WATCHED = ("src/A.cs", "bin/A.cs", ".graph/n.json", "App.slnx", "notes.md", "x/openapi/a.txt", "App.SLN", "a.http", "node_modules/m.ts", "b.tsx")


@query(f"SELECT doc_id, {[i in (0, 3, 5, 6, 7, 9) for i in range(10)]}[doc_id % 10 + 1] AS tracked FROM documents")
def tracked_paths(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, _WATCHED)), (F.col("doc_id") % 10 + 1).cast("int"))
    return bridge.table(spark, sf_dir, "documents").select("doc_id", stream_changes.tracked(path, ".graph").alias("tracked"))


# -- storage (S1-S3, S22, S24, K1, K3, J1, J9, T1, T7, F7) ------------------------------------------------------------------------------------


@query(f"""WITH {bridge.SUPPLY_SQL}
SELECT 'nodes' AS part, 'Project' AS kind, 'Project:' || replace(s_name, '#', '~0023') || '@project' AS a, NULL AS b, 'projectPath="src/' || s_name || '.csproj"|targetFrameworks=["O","F"]' AS attributes FROM supplier
UNION ALL SELECT 'edges', 'DependsOn', 'Project:' || replace(s_name, '#', '~0023') || '@project', 'Package:' || replace(package, ' ', '~0020') || '@' || replace(version, '#', '~0023'), 'isDirect=' || is_direct || '|tfm="' || tfm || '"' FROM uses""")
def stored_graph(spark, sf_dir):
    """A graph saved twice and loaded by its pointer: the last version, by kind."""
    room, graph = _room(spark), bridge.supply_graph(spark, sf_dir)
    store.save(PropertyGraph(graph.nodes.limit(0), graph.edges.limit(0)), room, "v1")
    store.save(graph, room, "v2")
    back = store.load(spark, room)
    key = attr.canonical_key(F.col("attributes")).alias("attributes")
    edges = back.edges.where("kind = 'DependsOn'").select(F.lit("edges").alias("part"), "kind", F.col("from_id").alias("a"), F.col("to_id").alias("b"), key)
    return back.find("Project").select(F.lit("nodes").alias("part"), "kind", F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), key).unionByName(edges)


@query(
    f"""WITH {bridge.HTTP_SQL}
SELECT '{{"attributes":{{"httpMethod":"' || method || '","routeTemplate":"' || template || '"}},"displayName":"Page' || page_id || '","id":"HttpEndpoint:Page' || page_id || '@1","kind":"HttpEndpoint","sourceRefs":[{{"file":"pages/' || page_id % 10
|| '.ts","spans":[{{"startLine":' || (page_id % 100 + 1) || ',"startColumn":3,"endLine":' || (page_id % 100 + 1) || ',"endColumn":10}}]}}]}}' AS json FROM routes WHERE role = 'Producer'"""
)
def canonical_json(spark, sf_dir):
    return store.shard_rows(bridge.http_graph(spark, sf_dir).find("HttpEndpoint"), "nodes").select("json")


@query("SELECT 'Assembly:' || n_name || '@1' AS id, row_number() OVER (ORDER BY 'Assembly:' || n_name || '@1') AS place FROM nation")
def ordered_nodes(spark, sf_dir):
    """Nodes in their fixed order, numbered: assemblies, some dozens."""
    graph = bridge.containment_graph(spark, sf_dir)
    rows = PropertyGraph(graph.find("Assembly"), graph.edges).ordered().nodes
    return rows.select("id", F.row_number().over(Window.orderBy(*node_order())).cast("long").alias("place"))


@query("""SELECT page_id, '{"a":"' || page_id || '","b":"x","z":"' || page_id % 3 || '"}' AS json FROM pages""")
def ordered_attributes(spark, sf_dir):
    m = F.create_map(F.lit("z"), (F.col("page_id") % 3).cast("string"), F.lit("a"), F.col("page_id").cast("string"), F.lit("b"), F.lit("x"))
    return bridge.table(spark, sf_dir, "pages").select("page_id", F.to_json(attr.ordered(m)).alias("json"))


@query(f"""WITH {bridge.SUPPLY_SQL} SELECT 'Project:' || replace(s_name, '#', '~0023') || '@project' AS from_id, 'Package:' || replace(package, ' ', '~0020') || '@' || replace(version, '#', '~0023') AS to_id, tfm FROM uses WHERE version LIKE '%1'""")
def dangling_dependencies(spark, sf_dir):
    graph = bridge.supply_graph(spark, sf_dir)
    return dangling(graph.edges, graph.nodes.where("kind <> 'Package' or version not like '%1'")).select("from_id", "to_id", attr.text(F.col("attributes"), "tfm").alias("tfm"))


_CACHED = "wanted AS (SELECT DISTINCT p_name AS package, p_brand AS version FROM part), kept AS (SELECT DISTINCT p_name AS package, p_brand AS version FROM part WHERE p_size % 3 = 0)"


@query(f"WITH {_CACHED} SELECT package, version, 'miss' AS found FROM (SELECT * FROM wanted EXCEPT SELECT * FROM kept) UNION ALL SELECT package, version, 'hit' FROM kept")
def package_cache(spark, sf_dir):
    part = bridge.table(spark, sf_dir, "part").select(F.col("p_name").alias("package"), F.col("p_brand").alias("version"), "p_size")
    cache = store.PackageCache(spark, _room(spark), "package string, version string, type string")
    for rest in (0, 3):  # two lots of packages, read at different times
        lot = part.where(F.col("p_size") % 6 == rest).select("package", "version").distinct()
        cache.add(cache.misses(lot).withColumn("type", F.lit("T")))
    wanted = part.select("package", "version").distinct()
    return cache.misses(wanted).withColumn("found", F.lit("miss")).unionByName(cache.get(wanted).select("package", "version", F.lit("hit").alias("found")))


@query(
    """WITH s AS (SELECT event_type AS tool, CAST(CASE WHEN event_type < 'd' THEN -5 ELSE count(*) END AS BIGINT) AS n, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)
SELECT tool, CAST(greatest(0, n) + (SELECT count(*) FROM events e WHERE e.event_type = tool) AS BIGINT) AS calls, epoch_us(a) AS first_called, epoch_us(b) AS last_called FROM s"""
)
def stored_statistics(spark, sf_dir):
    new = statistics.summarize(bridge.table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("called_at")))
    stored = new.withColumn("calls", F.when(F.col("tool") < "d", F.lit(-5).cast("long")).otherwise(F.col("calls")))
    both = statistics.combine(stored, new)
    return both.select("tool", "calls", F.unix_micros("first_called").alias("first_called"), F.unix_micros("last_called").alias("last_called"))


# -- small functions (F6, F10, F15, F17-F19, F22, F26, F27, Q8) -------------------------------------------------------------------------------


@query("""SELECT page_id, 'POST ' || regexp_replace(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '')), '/+$', '') AS key FROM pages""")
def route_keys(spark, sf_dir):
    return bridge.table(spark, sf_dir, "pages").select("page_id", routes.route_key(F.lit("\tpost \n"), F.col("url")).alias("key"))


@query("SELECT page_id, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS hash FROM (SELECT page_id, sha256(url) AS h FROM pages)")
def file_key_hashes(spark, sf_dir):
    return bridge.table(spark, sf_dir, "pages").select("page_id", ids.file_key_hash(F.col("url")).alias("hash"))


@query("SELECT p_partkey, regexp_replace(p_name || '@' || p_brand || '/' || p_type, '[^a-zA-Z0-9._-]', '_', 'g') AS name FROM part")
def file_names(spark, sf_dir):
    return bridge.table(spark, sf_dir, "part").select("p_partkey", ids.file_name(F.concat(F.col("p_name"), F.lit("@"), F.col("p_brand"), F.lit("/"), F.col("p_type"))).alias("name"))


@query("SELECT s_suppkey, 'project-src/' || s_name AS token, s_name AS workspace FROM supplier")
def project_tokens(spark, sf_dir):
    s = bridge.table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", ids.project_version(F.concat(F.lit("src/"), "s_name", F.lit(".CsProj"))).alias("token"), ids.workspace_name(F.concat(F.lit("/home/x/"), "s_name", F.lit("//"))).alias("workspace"))


def _sql(texts: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]"


_FILES = ("src/a.cs", "/w/Shop/src/b.cs", "/W/shop/c.cs", "/other/d.cs", " x\\y.cs ", "/w/Shop2/e.cs", " ", "/w/Shop/q/../f.cs")
_SHOWN = ("src/a.cs", "src/b.cs", "c.cs", "/other/d.cs", "x/y.cs", "/w/Shop2/e.cs", "", "f.cs")
_WHERE = ("/w/Shop/src/a.cs", "/w/Shop/src/b.cs", "/W/shop/c.cs", "/other/d.cs", "/w/Shop/ x\\y.cs ", "/w/Shop2/e.cs", "", "/w/Shop/f.cs")


@query(f"""WITH f AS (SELECT doc_id, doc_id % 8 + 1 AS i FROM documents)
SELECT doc_id, {_sql(_SHOWN)}[i] AS shown, {_sql(_WHERE)}[i] AS full_path, CASE WHEN i = 7 THEN '' WHEN doc_id % 3 = 0 THEN {_sql(_SHOWN)}[i] ELSE {_sql(_SHOWN)}[i] || ':' || doc_id || ':4' END AS label FROM f""")
def source_paths(spark, sf_dir):
    file = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = bridge.table(spark, sf_dir, "documents").select("doc_id", file.alias("f"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("line"))
    root = F.lit("/w/Shop/")
    shown = paths.relative(root, F.col("f"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("doc_id", empty(shown).alias("shown"), empty(paths.absolute(root, F.col("f"))).alias("full_path"), empty(paths.label(shown, F.col("line"), F.lit(4))).alias("label"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN p_name ELSE p_name || ' ' || p_size END AS name FROM part")
def optional_names(spark, sf_dir):
    text = F.when(F.col("p_size") % 4 == 0, F.lit(" \t\n ")).when(F.col("p_size") % 4 == 1, F.concat(F.lit(" \n"), "p_name", F.lit("\t"))).otherwise(F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string")))
    return bridge.table(spark, sf_dir, "part").select("p_partkey", attr.optional(text).alias("name"))


@query("SELECT p_partkey, 'Type:' || replace(p_name, ' ', '~0020') || '~000Aend~007E@1' AS id, p_partkey % 2 = 1 AS sound FROM part")
def odd_identifiers(spark, sf_dir):
    """White space around a name goes, inside it is escaped; an identifier with a newline behind it is none."""
    made = ids.node_id("Type", F.concat(F.lit("\t\n"), "p_name", F.lit("\nend~ 　")), F.lit(" 1\n"))
    rows = bridge.table(spark, sf_dir, "part").select("p_partkey", made.alias("id"))
    return rows.select("p_partkey", "id", ids.parse(F.when(F.col("p_partkey") % 2 == 1, F.col("id")).otherwise(F.concat("id", F.lit("\n")))).isNotNull().alias("sound"))


@query(f"WITH {bridge.USAGE_SQL} SELECT DISTINCT workspace, from_id FROM places WHERE workspace IN ('BUILDING', 'MACHINERY')")
def scoped_symbols(spark, sf_dir):
    graph = bridge.usage_graph(spark, sf_dir)
    names = scope.resolve(graph.nodes.select("workspace"), [" building", "Machinery"])
    return graph.edges.where(scope.within(names)).select("workspace", "from_id").distinct()

"""Whole and incremental builds with pluggable providers."""

import shutil

from pyspark.sql import functions as F

from loomgraph import providers
from loomgraph.build import Provider, build, fragments, update
from loomgraph.functions.ids import node_id
from loomgraph.operators.changes import classify
from loomgraph.operators import reconcile
from loomgraph.plans import http, packages, usages
from loomgraph.schema import EDGE_DDL, NODE_DDL
from loomgraph.sources import script, store, symbols


def scripts(spark, files):
    return script.nodes(script.scan(files)), spark.createDataFrame([], EDGE_DDL)


def second(spark, files):
    """Finds the same nodes and calls them differently; it comes later, so it wins."""
    nodes, edges = scripts(spark, files)
    return nodes.withColumn("display_name", F.lit("later")), edges


PROVIDERS = [Provider("js-fetch-callsite", scripts), Provider("dotnet", second)]


def frame(spark, **texts):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in texts.items()], "file string, text string")


def hashes(files):
    return files.select(F.concat(classify(F.col("file")), F.lit(":"), "file").alias("key"), F.sha2("text", 256).alias("sha256"))


def test_incremental_equals_whole(spark):
    old = frame(spark, a_ts="fetch('/a')", b_ts="fetch('/b')\nfetch('/c')", d_ts="fetch('/d')")
    new = frame(spark, a_ts="fetch('/a')", b_ts="fetch('/x')", e_ts="axios.get('/e')")
    first = build(spark, PROVIDERS, old)
    changed = update(spark, PROVIDERS, first, hashes(old), hashes(new), new)
    whole = build(spark, PROVIDERS, new)
    shown = lambda g: sorted((r["id"], r["display_name"]) for r in g.nodes.collect())
    assert shown(changed) == shown(whole) and len(shown(whole)) == 3
    assert {d for _, d in shown(whole)} == {"later"}
    assert update(spark, PROVIDERS, first, hashes(old), hashes(old), old) is first
    assert shown(update(spark, PROVIDERS, first, hashes(old).limit(0), hashes(new), new)) == shown(whole)


def test_only_some_providers(spark):
    nodes, _ = fragments(spark, PROVIDERS, frame(spark, a_ts="fetch('/a')"), ["dotnet"])
    assert [r["display_name"] for r in nodes.collect()] == ["later"]
    assert nodes.select(node_id("Type", F.lit("a"), F.lit("1")).alias("x")).first()["x"] == "Type:a@1"


def calls(spark, files):
    """A method for each file, named by its first line; each further line is a name it calls."""
    lines = files.select("file", F.split("text", "\n").alias("l")).select("file", F.col("l")[0].alias("name"), F.expr("slice(l, 2, size(l))").alias("called"))
    span = F.array(F.struct(F.lit(1).alias("start_line"), F.lit(1).alias("start_col"), F.lit(1).alias("end_line"), F.lit(2).alias("end_col")))
    own = F.array(F.struct(F.col("file"), span.alias("spans")))
    bare = F.create_map().cast("map<string,string>")
    main, one = F.lit("main").alias("workspace"), F.lit("1")
    nodes = lines.select(main, node_id("Method", F.col("name"), one).alias("id"), F.lit("Method").alias("kind"), F.col("name").alias("fqn"), one.alias("version"), F.col("name").alias("display_name"), bare.alias("attributes"), own.alias("source_refs"))
    uses = lines.select("file", "name", F.explode("called").alias("to"))
    to = uses.join(lines.select(F.col("name").alias("to")), "to")  # a name that no file gives is not resolved
    edges = to.select(main, node_id("Method", F.col("name"), one).alias("from_id"), node_id("Method", F.col("to"), one).alias("to_id"), F.lit("Calls").alias("kind"), bare.alias("attributes"), own.alias("source_refs"))
    return nodes, edges


def test_edges_from_unchanged_files(spark):
    """An edge from an unchanged file into a changed one stays, goes or comes as in a whole build, also where only another provider reads the change."""
    shown = lambda g: (sorted(r["id"] for r in g.nodes.collect()), sorted((r["from_id"], r["to_id"]) for r in g.edges.collect()))
    providers = [Provider("openapi-spec", scripts), Provider("dotnet", calls)]
    old = frame(spark, a_cs="A\nB\nC", b_cs="B", api_http="H")
    first = build(spark, providers, old)
    assert ("Method:A@1", "Method:B@1") in shown(first)[1]
    for texts in (dict(b_cs="B\nA"), dict(b_cs="C"), dict(b_cs="B", b_csproj="P\nA"), dict(b_cs="B", api_http="H\nA")):
        new = frame(spark, **{"a_cs": "A\nB\nC", "api_http": "H", **texts})
        changed, whole = update(spark, providers, first, hashes(old), hashes(new), new), build(spark, providers, new)
        assert shown(changed) == shown(whole)


SHOP = {
    "Shop.slnx": '<Solution><Project Path="src/Web/Web.csproj"/></Solution>',
    "src/Web/Web.csproj": "<Project/>",
    "src/Web/obj/project.assets.json": '{"targets":{"net10.0":{"Kit/1.0.0":{"type":"package"},"Deep/2.0.0":{"type":"package"}}},"libraries":{"Kit/1.0.0":{"type":"package","path":"kit/1.0.0","files":[]},"Deep/2.0.0":{"type":"package","path":"deep","files":[]}},"project":{"frameworks":{"net10.0":{"dependencies":{"Kit":{"target":"Package","version":"1.0.0"}}}}},"packageFolders":{"/n/":{}}}',
    "src/Web/CartController.cs": 'namespace Shop;\n[ApiController]\n[Route("api/[controller]")]\npublic class CartController : ControllerBase\n{\n    [HttpGet("{id:int}")]\n    public string One(int id) { return _kit.Find(id); }\n    [HttpPost]\n    public void Add() { }\n}\n',
    "src/Web/Program.cs": 'app.MapGet("/health", () => "ok");\n',
    "src/Web/Client.cs": 'namespace Shop;\npublic class Client\n{\n    public Task Load(int id) { return http.GetAsync($"/api/cart/{id}"); }\n}\n',
    "api/openapi.json": '{"openapi":"3.0.0","paths":{"/api/cart/{id}":{"get":{"operationId":"one","summary":"Reads a cart"}},"/api/orders":{"get":{}}}}',
    "calls.http": "### All\nGET https://h/api/orders\n",
    "web/cart.ts": "fetch('/api/orders')\n",
    "shop.postman_collection.json": '{"info":{"name":"S"},"item":[{"name":"o","request":{"method":"GET","url":"https://h/api/orders"}}]}',
    "bin/Skipped.ts": "fetch('/skipped')",
}
SYMBOLS = [("Kit", "1.0.0", "Kit", "Kit", "Finder", "class", None, [], [], [{"name": "Find", "signature": "Find(int)"}]), ("Kit", "2.0.0", "Kit", "Kit", "Finder", "class", None, [], [], [{"name": "Find", "signature": "Find(int)"}])]


def shown(g):
    key = lambda r: (r["from_id"], r["to_id"], r["kind"], sorted(r["attributes"].items()))
    return sorted((r["id"], r["display_name"], sorted(r["attributes"].items()), str(r["source_refs"])) for r in g.nodes.collect()), sorted(map(key, g.edges.collect()))


def test_from_a_folder_to_answers(spark, tmp_path):
    for name, text in SHOP.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = providers.read_files(spark, str(tmp_path))
    assert {r["file"] for r in found.collect()} == set(SHOP)
    known = spark.createDataFrame(SYMBOLS, symbols.SYMBOLS_DDL)
    graph = build(spark, providers.standard(known), found)
    trace = {(r["role"], r["source"], r["written"], r["file"]) for r in http.trace_http(graph, "GET", "/api/cart/{id}").collect()}
    one = "Method:Shop.CartController.One~0028int~0029@project-src~002FWeb~002FWeb"
    assert trace == {("Producer", one, "/api/cart/{id}", "api/openapi.json")} or {(r, s) for r, s, _, _ in trace} == {("Producer", one)}
    merged = graph.nodes.where("kind = 'HttpEndpoint' and version = 'openapi' and fqn = 'GET /api/cart/{id}'").first()
    assert {r["file"] for r in merged["source_refs"]} == {"api/openapi.json", "src/Web/CartController.cs"}
    assert graph.nodes.where("kind = 'HttpEndpoint'").count() == 4  # one, add, health, orders
    sites = {r["display_name"] for r in graph.nodes.where("kind = 'HttpCallSite'").collect()}
    assert sites == {"GET /api/cart/{var}", "GET https://h/api/orders (All)", "GET /api/orders"}
    kinds = {(r["kind"], r["n"]) for r in graph.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds >= {("HandlesRoute", 3), ("CallsRoute", 1), ("DependsOn", 2), ("DescribedBy", 2), ("Calls", 1)}
    uses = [(r["symbol_id"], r["enclosing"]) for r in usages.find_usages(graph, usages.symbols(graph, kind="Method", full_name="Kit.Finder.Find(int)")).collect()]
    assert [s for s, _ in uses] == ["Method:Kit.Finder.Find~0028int~0029@1.0.0"]  # of the version that the project has
    deps = {(r["project"], r["package"], r["version"], r["is_direct"]) for r in packages.list_dependencies(graph).collect()}
    assert deps == {("Web", "Kit", "1.0.0", True), ("Web", "Deep", "2.0.0", False)}


def test_update_with_cached_fragments_equals_a_whole_build(spark, tmp_path):
    """Endpoints of two sources, one of them changed; a file that goes; only the providers that read what changed run."""
    frame = lambda texts: spark.createDataFrame(sorted(texts.items()), "file string, text string")
    ran = []

    def noted(p):
        def collect(spark, files):
            ran.append(p.id)
            return p.collect(spark, files)

        return Provider(p.id, collect)

    some = [noted(p) for p in providers.standard() if p.id in ("dotnet-controller-endpoints", "openapi-spec", "js-fetch-callsite")]
    cache = str(tmp_path / "cache")
    old = {k: v for k, v in SHOP.items() if k in ("src/Web/CartController.cs", "api/openapi.json", "web/cart.ts")}
    graph = build(spark, some, frame(old), cache=cache)
    assert len(ran) == 3
    second = old | {"src/Web/CartController.cs": old["src/Web/CartController.cs"].replace("[HttpPost]", "[HttpPut]")}
    third = {k: v.replace("Reads", "Gives") for k, v in second.items() if k != "web/cart.ts"}
    for before, after, expected in ((old, second, ["dotnet-controller-endpoints", "js-fetch-callsite"]), (second, third, ["dotnet-controller-endpoints", "js-fetch-callsite", "openapi-spec"])):
        ran.clear()
        graph = update(spark, some, graph, hashes(frame(before)), hashes(frame(after)), frame(after), cache=cache)
        assert sorted(ran) == expected
        assert shown(graph) == shown(build(spark, some, frame(after)))
    names = [p.id for p in some]
    assert store.has_fragments(spark, cache, names)
    shutil.rmtree(f"{cache}/providers/openapi-spec")  # one that is missing counts as all
    assert not store.has_fragments(spark, cache, names)


def test_edges_stay_where_there_is_no_endpoint(spark):
    nodes = spark.createDataFrame([("main", "Project:P@project", "Project", "P", "project", "P", {}, [])], NODE_DDL)
    edges = spark.createDataFrame([("main", "Project:P@project", "Package:K@1", "DependsOn", {"tfm": f'"net{v}"'}, []) for v in (8, 9)], EDGE_DDL)
    assert reconcile.reconcile_edges(nodes, edges).count() == 2

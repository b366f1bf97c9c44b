"""Readers, scanners, storage and streams on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import changes
from loomgraph.operators.graph import PropertyGraph
from loomgraph.schema import EDGE_DDL, NODE_DDL
from loomgraph.sources import csharp, openapi, postman, requests, script, solution, store
from loomgraph.streaming import changes as batches
from loomgraph.streaming import statistics


def files(spark, **named):
    return spark.createDataFrame([(k, v) for k, v in named.items()], "file string, text string")


def test_script_calls(spark):
    text = "fetch('/api/users')\n\nfetch(\"/api/u\", { method: \"POST\" })\nfetch(`/api/users/${id}`, {method: 'put'}); axios.Delete('/o/1')\r\n// axios.get(`/i/${x}/d`)\nfetch(url)\nfetch('/mixed\")"
    got = sorted(tuple(r) for r in script.scan(files(spark, a=text)).select("line_no", "method", "url_template", "confidence").collect())
    assert got == [(1, "GET", "/api/users", "high"), (3, "POST", "/api/u", "high"), (4, "DELETE", "/o/1", "high"), (4, "PUT", "/api/users/{var}", "medium"), (5, "GET", "/i/{var}/d", "medium")]
    nodes = script.nodes(script.scan(files(spark, a=text)))
    assert nodes.columns == spark.createDataFrame([], NODE_DDL).columns and nodes.count() == 5


def test_request_file(spark):
    text = "###\n# @name allCarts  and more\nGET https://shop.test/carts\nAccept: a\naccept: b\n\nbody: none\n### Add one\n# @name other\n\nput carts/{{cart}} HTTP/1.1\nX-Key: 1\nno header\nY: 2\n###\nhello\nGET /late\n###\nGETTING /x\n### Bare\nhttps://shop.test/bare"
    found = requests.scan(script.lines(files(spark, a=text)))
    got = [tuple(r) for r in found.orderBy("block").select("block", "line_no", "method", "url_template", "name", "headers").collect()]
    assert got == [(1, 3, "GET", "https://shop.test/carts", "allCarts", {"Accept": "b"}), (2, 11, "PUT", "carts/{cart}", "Add one", {"X-Key": "1"})]
    ids = [r["fqn"] for r in requests.nodes(files(spark, a=text)).orderBy("fqn").collect()]
    assert ids[0].startswith("HTTP.GET.https://shop.test/carts.") and ids[0].endswith(".0") and ids[1].endswith(".1")


def test_postman(spark):
    tree = {"info": {"name": "C"}, "variable": [{"key": "b", "value": "https://h:1"}], "item": [{"name": "U", "item": [{"name": "one", "request": {"method": "get", "url": {"raw": "{{b}}/u/{{id}}"}}}, {"name": "V", "item": [{"name": "two", "request": {"url": {"path": ["a", "b"]}}}]}]}, {"name": "top", "request": {"method": "POST", "url": "{{b}}/h"}}]}
    got = sorted(tuple(r) for r in postman.scan(files(spark, c=json.dumps(tree))).select("folder", "name", "method", "url_template").collect())
    assert got == [("", "top", "POST", "/h"), ("U", "one", "GET", "/u/{id}"), ("U/V", "two", "GET", "/a/b")]
    with pytest.raises(Exception, match="deeper"):
        postman.scan(files(spark, c=json.dumps(tree)), max_depth=2).collect()


def test_openapi(spark):
    doc = {"openapi": "3.0.0", "paths": {"/u": {"get": {"operationId": "all", "tags": ["b", "a"], "responses": {"200": {"$ref": "#/components/schemas/User"}}}, "parameters": []}}}
    got = [tuple(r) for r in openapi.scan(files(spark, a=json.dumps(doc), b="{not json", c="plain: text", d=json.dumps({"paths": {}}))).collect()]
    assert got == [("a", "GET", "/u", "all", None, "a,b", "User")]
    yaml = pytest.importorskip("yaml")
    assert openapi.scan(files(spark, y=yaml.safe_dump(doc))).first()["operation_id"] == "all"


def test_solution_and_assets(spark):
    found = solution.projects(files(spark, **{"a.slnx": '<Solution><Folder Name="/s/"><Project Path="A\\A.csproj"/><Project Path="x.fsproj"/></Folder></Solution>', "b.sln": 'Project("{1}") = "B", "B\\B.csproj", "{2}"\nEndProject'}))
    assert sorted(r["project_path"] for r in found.collect()) == ["A/A.csproj", "B/B.csproj"]
    assets = {"targets": {"net10.0": {"W/1.0.0": {"type": "package"}, "T/1.0.0": {"type": "package"}, "P/1.0.0": {"type": "project"}}}, "libraries": {"W/1.0.0": {"type": "package", "path": "w", "files": ["lib/net10.0/W.dll", "W.xml"]}, "T/1.0.0": {"type": "package", "path": "t", "files": []}}, "project": {"frameworks": {"net10.0": {"dependencies": {"W": {"target": "Package", "version": "1.0.0"}}}}}, "packageFolders": {"/n/": {}}}
    df = spark.createDataFrame([("A", json.dumps(assets))], "project string, text string")
    assert sorted((r["package"], r["version"], r["tfm"], r["is_direct"]) for r in solution.dependencies(df).collect()) == [("T", "1.0.0", "net10.0", False), ("W", "1.0.0", "net10.0", True)]
    assert [r["dll"] for r in solution.assemblies(df).collect()] == ["/n/w/lib/net10.0/W.dll"]


def test_csharp(spark):
    text = 'namespace N;\n[Route("api/[controller]")]\npublic class UsersController : ControllerBase\n{\n [HttpGet]\n [ProducesResponseType(200)]\n [ProducesResponseType(StatusCodes.Status404NotFound)]\n public IActionResult All() { return Ok("}"); }\n // [HttpPut] public void No() { }\n [HttpDelete("{id:int}")] [Route("gone/{id}")]\n public void Drop(int id) { }\n}\nclass C { public Task Go(int i) => h.DeleteAsync("/o/" + i); }\n'
    got = [(r["method"], r["route"], r["source"], r["codes"]) for r in csharp.controller_endpoints(text)]
    assert got == [("GET", "/api/users", "N.UsersController.All()", [200, 404]), ("DELETE", "/api/users/gone/{id}", "N.UsersController.Drop(int)", [])]
    assert [(r["method"], r["route"], r["confidence"], r["source"]) for r in csharp.client_calls(text)] == [("DELETE", "/o/unknown", "medium", "N.C.Go(int)")]
    mapped = csharp.minimal_endpoints('app.MapGet("/h", () => "a, b"); app.MapPost(route, Handler.Do); app.MapPut("/x");')
    assert [(r["method"], r["route"], r["confidence"]) for r in mapped] == [("GET", "/h", "high"), ("POST", "/unknown", "low")]
    rows = csharp.scan_http(files(spark, **{"a.cs": text, "b.Designer.cs": text, "c.cs": "// <auto-generated/>\n" + text, "d.txt": text}))
    assert {r["file"] for r in rows.collect()} == {"a.cs"} and rows.count() == 3
    named = spark.createDataFrame([(n, "class A { }") for n in ("x.g.cs", "a.generated.b.cs", "q.G.z.cs", "AssemblyInfo.cs", "p.cs")] + [("m.cs", "// <AutoGenerated>\nclass A { }")], "file string, text string")
    assert sorted(r["file"] for r in named.where(~csharp.is_generated(F.col("file"), F.col("text"))).collect()) == ["AssemblyInfo.cs", "p.cs"]


@pytest.mark.parametrize(
    ("expression", "expected"),
    [('"/a/" + "b"', ("/a/b", "high")), ('string.Format("/api/{0}/{1}", id, x)', ("/api/{var}/{var}", "high")), ('$"/c/{a.b(1)}/d"', ("/c/{var}/d", "high")), ('"/x/" + id', ("/x/unknown", "medium")), ("id", ("unknown", "low")), ("Other.Url", ("unknown", "low")), ('Other.Url + "/y"', ("unknown/y", "medium")), ("f(x)", ("unknown", "low"))],
)
def test_csharp_urls(expression, expected):
    assert csharp.url_of(expression) == expected


def test_csharp_across_files(spark):
    """Constants, base classes and handlers of other files; what no file has is unknown."""
    one = 'namespace N;\npublic class CartController : Middle\n{\n [HttpGet("[action]")] public int List() => 1;\n}\npublic class Plain : Elsewhere\n{\n [HttpGet] public int No() => 1;\n}\nclass Up { public void Go() { app.MapGet(Names.Path, Jobs.Run); app.MapPut("x", Jobs.Lost); h.GetAsync(Names.Path + "/z"); h.GetAsync(Names.Gone); f.SendAsync(new HttpRequestMessage(m, "/s")); } }\n'
    two = 'namespace N;\npublic class Middle : Top { }\npublic class Top : Controller { }\nstatic class Names { public const string Path = "/p" + "/q"; }\nstatic class Jobs { public static int Run(string s) => 1; }\n'
    got = {(r["scanner"], r["method"], r["route"], r["source"], r["confidence"]) for r in csharp.scan_http(files(spark, **{"a.cs": one, "b.cs": two})).collect()}
    up = "N.Up.Go()"
    assert got == {
        ("controller", "GET", "/list", "N.CartController.List()", "high"), ("minimal-api", "GET", "/p/q", "N.Jobs.Run(string)", "high"), ("minimal-api", "PUT", "/x", None, "high"),
    } | {("http-client", "GET", "/p/q/z", up, "high"), ("http-client", "GET", "unknown", up, "low"), ("http-client", "UNKNOWN", "/s", up, "high")}


def test_hashes_of_a_workspace(spark, tmp_path):
    root = tmp_path / "a+b (1).c"
    for name, text in (("src/A.cs", "a"), ("obj/project.assets.json", "{}"), ("obj/B.cs", "b"), ("readme.md", "r"), ("api/swagger.yml", "s")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = sorted(r["key"] for r in changes.hash_files(spark, str(root)).collect())
    assert got == ["dependency:obj/project.assets.json", "http-spec:api/swagger.yml", "source:src/A.cs"]


@pytest.fixture(scope="module")
def small(spark):
    span = {"start_line": 1, "start_col": 2, "end_line": 3, "end_col": 4}
    nodes = [("main", "Type:A@1", "Type", "A", "1", 'A "q"', {"z": "1.50", "a": '"12"', "l": '["x"]'}, [{"file": "f.cs", "spans": [span]}]), ("main", "Package:P@1", "Package", "P", "1", "P", {}, [])]
    edges = [("main", "Package:P@1", "Type:A@1", "Contains", {"k": "true"}, [])]
    return PropertyGraph(spark.createDataFrame(nodes, NODE_DDL), spark.createDataFrame(edges, EDGE_DDL))


def test_parquet_store(spark, small, tmp_path):
    store.save(small, str(tmp_path / "g"), "v1")
    back = store.load(spark, str(tmp_path / "g"))
    assert sorted(r["id"] for r in back.nodes.collect()) == ["Package:P@1", "Type:A@1"] and back.edges.count() == 1
    assert "PartitionFilters: [isnotnull(kind" in back.find("Type")._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        store.inside("/a/b", "../c")
    empty = store.load(spark, str(tmp_path / "none"))
    assert empty.nodes.count() == 0 and store.manifest(spark, str(tmp_path / "none")).first()["last_build"].year == 1970
    hashes = spark.createDataFrame([("source:a.cs", "x")], "key string, sha256 string")
    store.save(small, str(tmp_path / "g"), "v2", hashes)
    assert store.load_hashes(spark, str(tmp_path / "g")).collect() == hashes.collect() and store.load_hashes(spark, str(tmp_path / "none")).count() == 0
    assert [json.loads(x) for x in store.json_lines(small.nodes.select("id", "version").orderBy("id"))] == [{"id": "Package:P@1", "version": "1"}, {"id": "Type:A@1", "version": "1"}]


def test_large_kinds_get_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 10)
    rows = [("main", f"{k}:n{i}@1", k, f"n{i}", "1", f"n{i}", {}, []) for k, n in (("Type", 95), ("Package", 3)) for i in range(n)]
    graph = PropertyGraph(spark.createDataFrame(rows, NODE_DDL), spark.createDataFrame([], EDGE_DDL))
    store.save(graph, str(tmp_path / "g"), "v")
    count = lambda kind: len(list((tmp_path / "g/v/nodes" / f"kind={kind}").glob("*.parquet")))
    assert count("Type") > 3 >= count("Package") == 1 and store.load(spark, str(tmp_path / "g")).nodes.count() == 98
    with pytest.raises(ValueError, match="too many"):
        store.write_shards(graph, str(tmp_path / "s"), most=50)


def test_json_shards_round_trip(spark, small, tmp_path):
    store.write_shards(small, str(tmp_path / "one"))
    back = store.read_shards(spark, str(tmp_path / "one"))
    store.write_shards(back, str(tmp_path / "two"))
    names = sorted(p.relative_to(tmp_path / "one") for p in (tmp_path / "one").rglob("*.json"))
    assert len(names) == 20  # a file for each kind, empty or not
    for n in names:
        assert (tmp_path / "one" / n).read_bytes() == (tmp_path / "two" / n).read_bytes()
        json.loads((tmp_path / "one" / n).read_text())
    store.export_html(small, str(tmp_path / "g.html"))
    assert "Type:A@1" in (tmp_path / "g.html").read_text()


def test_debounce_and_statistics_as_streams(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("w", t(0), "b.cs"), ("w", t(0.5), "a.cs"), ("w", t(0.9), "a.cs"), ("w", t(5), "c.cs"), ("v", t(0.2), "x.cs"), ("w", t(500), "end"), ("v", t(500), "end")]
    schema = "workspace string, ts timestamp, path string"
    events = spark.createDataFrame(rows, schema)
    batch = batches.debounce(events)
    want = {("w", 3, "a.cs|b.cs"), ("w", 1, "c.cs"), ("v", 1, "x.cs")}
    shown = lambda df: {(r["workspace"], r["events"], r["paths"]) for r in df.collect()}
    assert want <= shown(batch)
    events.write.parquet(str(tmp_path / "in"))
    stream = batches.debounce(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), watermark="1 second")
    seen = []
    q = batches.run(stream, lambda df, _: seen.extend((r["workspace"], r["events"], r["paths"]) for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert set(seen) == want  # what is not over yet has not come out
    spark.createDataFrame([("t", t(1)), ("t", t(2)), (" ", t(3))], "tool string, called_at timestamp").write.parquet(str(tmp_path / "calls"))
    calls = spark.readStream.schema("tool string, called_at timestamp").parquet(str(tmp_path / "calls"))
    q = statistics.run(calls, str(tmp_path / "out"), str(tmp_path / "cp2"))
    q.processAllAvailable()
    q.stop()
    assert [(r["tool"], r["calls"], r["last_called"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("t", 2, t(2))]
    both = statistics.combine(spark.createDataFrame([("t", -3, t(0), t(0))], "tool string, calls long, first_called timestamp, last_called timestamp"), statistics.summarize(spark.createDataFrame([("t", t(1))], "tool string, called_at timestamp")))
    assert both.first()["calls"] == 1 and statistics.total(both).first()["total_calls"] == 1


def test_tracked_paths(spark):
    df = spark.createDataFrame([("src/A.cs",), ("bin/A.cs",), (".graph/x.json",), ("App.slnx",), ("notes.md",), ("x/openapi/a.txt",)], "p string")
    assert sorted(r["p"] for r in df.where(batches.tracked(F.col("p"), ".graph")).collect()) == ["App.slnx", "src/A.cs", "x/openapi/a.txt"]

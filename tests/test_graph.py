"""A small graph with two versions of one package."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import merge, reconcile
from loomgraph.operators.changes import changed_files, incremental, providers_to_run
from loomgraph.operators.graph import PropertyGraph, contains_across_versions, dangling
from loomgraph.plans import http, packages, scope, usages
from loomgraph.schema import EDGE_DDL, NODE_DDL


def ref(file, *spans):
    return {"file": file, "spans": [dict(zip(("start_line", "start_col", "end_line", "end_col"), s, strict=True)) for s in spans]}


def node(kind, fqn, version, attributes=None, refs=None, workspace="main"):
    return (workspace, f"{kind}:{fqn}@{version}", kind, fqn, version, f"{fqn}@{version}", attributes or {}, refs or [])


def edge(source, target, kind, attributes=None, refs=None, workspace="main"):
    return (workspace, source, target, kind, attributes or {}, refs or [])


@pytest.fixture(scope="module")
def graph(spark):
    nodes, edges = [node("Project", "App", "project", {"projectPath": '"src/App.csproj"', "targetFrameworks": '["net10.0"]'}), node("Project", "Lone", "project")], []
    for v in ("1.0.0", "1.2.0"):
        nodes += [node("Package", "X", v, {"packageName": '"X"', "version": f'"{v}"'}), node("Assembly", "X.Core", v), node("Namespace", "X.Svc", v), node("Type", "X.Svc.W", v, {"kind": '"class"'}), node("Method", "X.Svc.W.Get", v, {"signature": '"Get()"'}, [ref("w.cs", (5, 5, 12, 6))])]
        chain = ["Package:X", "Assembly:X.Core", "Namespace:X.Svc", "Type:X.Svc.W", "Method:X.Svc.W.Get"]
        edges += [edge(f"{a}@{v}", f"{b}@{v}", "Contains") for a, b in zip(chain, chain[1:], strict=False)]
        edges.append(edge("Project:App@project", f"Package:X@{v}", "DependsOn", {"tfm": '"net10.0"', "isDirect": "true"}))
    nodes.append(node("Method", "App.Run", "project-App", refs=[ref("run.cs", (1, 1, 1, 9))]))
    edges += [edge("Method:App.Run@project-App", "Method:X.Svc.W.Get@1.2.0", "Calls", {"callCount": "2"}, [ref("run.cs", (7, 3, 7, 9), (8, 3, 8, 9))]), edge("Method:App.Run@project-App", "Method:X.Svc.W.Get@1.0.0", "Uses")]
    nodes += [
        node("HttpEndpoint", "GET /u", "openapi", {"httpMethod": '"GET"', "routeTemplate": '"/u/{id:int}"', "source": '"openapi"', "summary": '"A"'}, [ref("api.json")]),
        node("HttpEndpoint", "GET /u", "project-App", {"httpMethod": '"get"', "routeTemplate": '"/u/{id}"', "summary": '"B"'}, [ref("c.cs", (3, 1, 4, 1))]),
        node("HttpCallSite", "call", "1", {"httpMethod": '"GET"', "urlTemplate": '"/u/:id"', "callingMethod": '"Client"'}, [ref("t.ts", (2, 0, 2, 0))]),
    ]
    edges.append(edge("Method:App.Run@project-App", "HttpEndpoint:GET /u@project-App", "HandlesRoute"))
    return PropertyGraph(spark.createDataFrame(nodes, NODE_DDL), spark.createDataFrame(edges, EDGE_DDL))


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_lookups(graph):
    assert ids(graph.node("Package:X@1.0.0")) == ["Package:X@1.0.0"]
    assert ids(graph.by_name_prefix("x.svc.w@1.")) == ["Type:X.Svc.W@1.0.0", "Type:X.Svc.W@1.2.0"]
    assert ids(graph.by_name_prefix("  ")) == []
    assert len(ids(graph.by_attribute("signature"))) == 2
    assert graph.find_edges(kind="DependsOn").count() == 2
    assert graph.find_edges(to_id="Package:X@1.2.0", kind="DependsOn").count() == 1
    assert ids(graph.neighbors("Type:X.Svc.W@1.2.0")) == ["Method:X.Svc.W.Get@1.2.0"]
    assert ids(graph.neighbors("Type:X.Svc.W@1.2.0", "incoming", "Contains")) == ["Namespace:X.Svc@1.2.0"]
    assert len(ids(graph.neighbors("Type:X.Svc.W@1.2.0", "both"))) == 2
    with pytest.raises(ValueError):
        graph.neighbors("x", "sideways")
    assert dangling(graph.edges, graph.nodes).isEmpty() and contains_across_versions(graph.edges, graph.nodes).isEmpty()


def test_packages(graph):
    api = packages.describe_api(graph, "X", "1.0.0").collect()
    assert [(r["namespace"], r["type"], r["method"], r["signature"]) for r in api] == [("X.Svc", "X.Svc.W", "X.Svc.W.Get", "Get()")]
    assert packages.describe_api(graph, "X", "1.0.0", tfm="net9.0").isEmpty()
    none = packages.describe_api(graph, "X", "1.0.0", pattern="Nothing").collect()
    assert [(r["namespace"], r["type"]) for r in none] == [("X.Svc", None)]  # a namespace shows without types
    deps = packages.list_dependencies(graph, check=True).collect()
    assert sorted((r["project"], r["version"] or "") for r in deps) == [("App@project", "1.0.0"), ("App@project", "1.2.0"), ("Lone@project", "")]
    assert packages.list_dependencies(graph, project="SRC/app.csproj").count() == 2
    assert {r["versions"] for r in packages.version_conflicts(graph).collect()} == {"1.0.0,1.2.0"}
    with pytest.raises(ValueError):
        packages.describe_api(graph, " ", "1")


def test_usages(spark, graph):
    found = usages.find_usages(graph, usages.symbols(graph, kind="METHOD", full_name="X.Svc.W.Get")).collect()
    assert sorted((r["usage"], r["file"], r["start_line"]) for r in found) == [("Calls", "run.cs", 7), ("Calls", "run.cs", 8), ("Uses", "run.cs", 1)]  # the last falls back on its source's reference
    lines = spark.createDataFrame([("run.cs", i, f"  line {i} ") for i in range(1, 10)], "file string, line_no int, text string")
    files = spark.createDataFrame([("run.cs", 5)], "file string, ticks long")
    best = usages.suggest_usage(graph, usages.symbols(graph, symbol_id="Method:X.Svc.W.Get@1.2.0"), lines, files, most=1).collect()
    assert [(r["start_line"], r["excerpt"], r["recency"]) for r in best] == [(7, "6: line 6\n7: line 7\n8: line 8", 5)]
    with pytest.raises(ValueError):
        usages.suggest_usage(graph, usages.symbols(graph, symbol_id="x"), lines, files, most=0)
    with pytest.raises(ValueError):
        usages.symbols(graph, kind="Thing", full_name="x")


def test_http(graph):
    strict = http.trace_http(graph, "get", "/U/{id}").collect()
    assert sorted((r["role"], r["source"] or "") for r in strict) == [("Producer", ""), ("Producer", "Method:App.Run@project-App")]
    wide = http.trace_http(graph, "GET", "https://x/u/:id/", match_on="coalesce").collect()
    assert [(r["source"], r["written"], r["line"]) for r in wide if r["role"] == "Consumer"] == [("Client", "/u/:id", 2)]


def test_reconcile(graph):
    out = reconcile.reconcile(graph)
    ends = out.nodes.where("kind = 'HttpEndpoint'").collect()
    assert [e["id"] for e in ends] == ["HttpEndpoint:GET /u@openapi"]
    a = ends[0]["attributes"]
    assert a["summary:openapi"] == '"A"' and a["summary:static"] == '"B"' and "summary" not in a and a["source"] == '"openapi"'
    assert [r["file"] for r in ends[0]["source_refs"]] == ["api.json", "c.cs"]
    assert ids(out.edges.where("kind = 'HandlesRoute'"), "to_id") == ["HttpEndpoint:GET /u@openapi"]
    again = reconcile.reconcile(out)
    assert again.nodes.count() == out.nodes.count() and again.edges.count() == out.edges.count()


def test_incremental(spark, graph):
    before = spark.createDataFrame([("source:run.cs", "1"), ("http-spec:old.http", "2"), ("source:same.cs", "3")], "key string, sha256 string")
    after = spark.createDataFrame([("source:run.cs", "9"), ("source:same.cs", "3"), ("project:n.csproj", "4")], "key string, sha256 string")
    changes = changed_files(before, after)
    assert sorted((r["rel_path"], r["change"]) for r in changes.collect()) == [("n.csproj", "added"), ("old.http", "deleted"), ("run.cs", "modified")]
    assert len(ids(providers_to_run(changes), "provider_id")) == 8
    asked = []

    def collect(providers, files):
        asked.extend(providers)
        extra = lambda df: df.withColumn("provider_ord", F.lit(0)).withColumn("seq", F.lit(0).cast("long"))
        return extra(graph.nodes.limit(0)), extra(graph.edges.limit(0))

    out = incremental(graph, changes, collect)
    assert "dotnet" in asked and out.nodes.where("fqn = 'App.Run'").isEmpty() and out.edges.where("kind = 'Calls'").isEmpty()
    assert not out.nodes.where("kind = 'Package'").isEmpty()  # packages refer to no file and stay
    assert incremental(graph, changes.limit(0), collect) is graph


def test_merge_is_idempotent(graph):
    at = lambda df, o: df.withColumn("provider_ord", F.lit(o)).withColumn("seq", F.lit(0).cast("long"))
    twice = merge.merge_nodes(at(graph.nodes, 0).unionByName(at(graph.nodes, 1)))
    assert ids(twice) == ids(graph.nodes)
    assert merge.merge_edges(at(graph.edges, 0).unionByName(at(graph.edges, 1))).count() == graph.edges.count()


def test_scope(spark):
    known = spark.createDataFrame([("Shop",), ("Api",)], "workspace string")
    assert scope.resolve(known, None) is None and scope.resolve(known, ["x", "ALL"]) is None
    assert scope.resolve(known, ["shop", "SHOP"]) == ["Shop"]
    with pytest.raises(ValueError):
        scope.resolve(known, ["none"])
    assert scope.ping() == "pong"

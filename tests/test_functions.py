import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import attributes as attr
from loomgraph.functions import ids, paths, routes
from loomgraph.plans.packages import _escaped
from loomgraph.schema import WHITE


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("GET /api/users/{id}", "GET~0020~002Fapi~002Fusers~002F~007Bid~007D"), ("A.B.Get(string)", "A.B.Get~0028string~0029"), ("😀", "~D83D~DE00"), (" a~b ", "a~007Eb"), ("x+1-2_3", "x+1-2_3"), ("  ", None), ("abc\n", "abc"), ("\tabc", "abc"), ("a\nb", "a~000Ab"), ("\u3000", None)],
)
def test_escape(spark, text, expected):
    assert one(spark, ids.escape(F.lit(text))) == expected


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=8) | st.text(alphabet="\t\n\r \x85\xa0\u3000a~é", max_size=6), min_size=1, max_size=12))
def test_escape_agrees_with_the_drivers(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(ids.escape(F.col("t")).alias("x"))
    assert [r["x"] for r in df.collect()] == [_escaped(t.strip(WHITE)) or None for t in texts]


@pytest.mark.parametrize(("text", "ok"), [("Type:A.B@1.0", True), ("type:A@1", False), ("Type:A", False), ("Type:A:B@1", False), ("Nothing:A@1", False), ("Type:@1", False), ("Type:a~0020b@1", True), ("Type:A@1\n", False), ("\nType:A@1", False)])
def test_parse(spark, text, ok):
    got = one(spark, ids.parse(F.lit(text)))
    assert (got is not None) == ok
    if ok:
        assert f"{got['kind']}:{got['fqn']}@{got['version']}" == text


# Routes whose normal form is given.
PINNED = [(":id", "/{id}"), ("{id:int}", "/{id}"), ("{id?}", "/{id}"), ("/api/users//", "/api/users"), ("/files/{*remainder}", "/files/{**}"), ("http://EXAMPLE.COM/Api/Users", "/api/users")]
OWN = [
    ("/shop/:cart/items/:itemNo", "/shop/{cart}/items/{itemno}"), ("/tags/{tag:alpha:length(3)}/", "/tags/{tag}"), ("{page=1}", "/{page}"), ("/rest/{**all}", "/rest/{**}"), ("Orders", "/orders"), ("/", "/"), ("//", "/"), ("", "/"), (None, "/"),
    ("https://shop.test", "/"), ("ftp://h:21/A%20b?x=1#y", "/a b"), ("https://h/a+b", "/a+b"), ("/a:b/c", "/a{b}/c"), ("/v1.2/{x}-{y:int}", "/v1.2/{x}-{y}"),
]


@pytest.mark.parametrize(("path", "expected"), PINNED + OWN)
def test_normal_path(spark, path, expected):
    assert one(spark, routes.normal_path(F.lit(path).cast("string"))) == expected
    assert one(spark, routes.normal_path(F.lit(expected))) == expected  # a normal form stays


def test_route_key(spark):
    assert one(spark, routes.route_key(F.lit(" get "), F.lit("https://service/api/orders/:id/"))) == one(spark, routes.route_key(F.lit("GET"), F.lit("/api/orders/{id:int}")))


def test_controller_route(spark):
    assert one(spark, routes.controller_route(F.lit("/v2/[Controller]/"), F.lit("{id:int}"), F.lit("CartController"), F.lit("Get"))) == "/v2/cart/{id}"
    assert one(spark, routes.controller_route(F.lit(None).cast("string"), F.lit("[action]"), F.lit("X"), F.lit("GoOn"))) == "/goon"
    assert one(spark, routes.controller_route(F.lit("[controller]"), F.lit(None).cast("string"), F.lit("Controller"), F.lit("A"))) == "/controller"
    assert [one(spark, routes.mapped_route(F.lit(t))) for t in ("a/{x:int}", "/b", " ", "")] == ["/a/{x}", "/b", "/", "/"]


@pytest.mark.parametrize(
    ("line", "method"),
    [("fetch('/a')", "GET"), ("{ method : \"put\" }", "PUT"), ("{method:'a1', method: 'del'}", "DEL"), ("methods: 'PUT'", "GET"), ("method = 'PUT'", "GET"), ("method: PUT", "GET"), ("no method here, method:\t'patch'", "PATCH")],
)
def test_fetch_method(spark, line, method):
    assert one(spark, routes.fetch_method(F.lit(line))) == method


@pytest.mark.parametrize(("rest", "found"), [(" '/a'", ("/a", False)), ('"/a/b", {', ("/a/b", False)), ("`/a/${x}`", ("/a/${x}", True)), ("'/a\"", None), ("''", None), ("url)", None), ("`open", None), ("'it is", None), ("", None)])
def test_literals(spark, rest, found):
    got = one(spark, routes.literal_at(F.lit(rest)))
    assert (got and (got["url"], got["template"])) == found


def test_paths(spark):
    shown = lambda f: one(spark, paths.relative(F.lit("/w/a.b+(1)/"), F.lit(f)))
    assert [shown(f) for f in ("x\\y.cs", "/w/a.b+(1)/s/t.cs", "/W/A.b+(1)/t.cs", "/w/aXb+(1)/t.cs", " ")] == ["x/y.cs", "s/t.cs", "t.cs", "/w/aXb+(1)/t.cs", None]
    assert one(spark, paths.absolute(F.lit("/w"), F.lit("a/../b.cs"))) == "/w/b.cs" and one(spark, paths.absolute(F.lit("/w"), F.lit("/x//y"))) == "/x/y"
    assert one(spark, paths.label(F.lit("a"), F.lit(1), F.lit(2))) == "a:1:2" and one(spark, paths.label(F.lit("a"), F.lit(None).cast("int"), F.lit(None).cast("int"))) == "a"


def test_attributes(spark):
    m = F.create_map(*[F.lit(x) for x in ("s", '"v"', "n", "1", "b", "true", "a", '["y"," ","x"]')])
    got = spark.range(1).select(attr.text(m, "s").alias("s"), attr.text(m, "n").alias("n"), attr.flag(m, "b").alias("b"), attr.flag(m, "z").alias("z"), attr.texts(m, "a").alias("a"), attr.texts(m, "z").alias("e"), attr.canonical_key(m).alias("k"), attr.quoted(F.lit('a"b')).alias("q")).first()
    assert (got["s"], got["n"], got["b"], got["z"], got["a"], got["e"], got["q"]) == ("v", None, True, False, ["x", "y"], [], '"a\\"b"')
    assert got["k"].startswith('a=["y"')


def test_hashes_and_names(spark):
    import hashlib

    h = hashlib.sha256(b"src/a.ts").digest()
    assert one(spark, ids.short_hash(F.lit("src/a.ts"))) == h.hex()[:8]
    assert one(spark, ids.file_key_hash(F.lit("src/a.ts"))) == h[:4][::-1].hex()
    assert one(spark, ids.workspace_name(F.lit("/x/shop//"))) == "shop"
    assert one(spark, ids.project_version(F.lit("src/App.CSPROJ"))) == "project-src/App"
    assert one(spark, ids.package_identity(F.lit("a/b/1.0")))["version"] == "1.0"

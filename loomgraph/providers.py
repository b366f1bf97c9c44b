"""The eight providers: from files (file, text) to nodes and edges (U1; S4-S16 as graph).

File paths are relative to the workspace. Node identifiers, versions and attributes are those of the survey's catalogue (§1.4).
"""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.build import Provider
from loomgraph.functions.ids import file_key_hash, node_id, project_version, short_hash
from loomgraph.lineage import cut
from loomgraph.operators.changes import skipped
from loomgraph.operators.merge import last_version, usage_edges
from loomgraph.schema import EDGE_DDL, SPAN_DDL
from loomgraph.sources import csharp, emit, openapi, postman, requests, script, solution, symbols

_known: WeakKeyDictionary = WeakKeyDictionary()


def _once(files: DataFrame, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What several providers need of the same files, made by the first of them."""
    found = _known.setdefault(files, {})
    if name not in found:
        found[name] = make()
    return found[name]


def _records(files: DataFrame) -> DataFrame:
    """One scan of the C# files."""
    return _once(files, "records", lambda: csharp.records(files))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*\z", "")


def project_files(files: DataFrame) -> DataFrame:
    """(project_path) of the projects: those that solutions list, below the solution's folder, and where there is no solution every .csproj."""
    return _once(files, "projects", lambda: cut(_projects(files)))


def _projects(files: DataFrame) -> DataFrame:
    listed = solution.projects(files).select(F.concat(_folder(F.col("file")), F.col("project_path")).alias("project_path")).distinct()
    own = files.where(F.lower("file").endswith(".csproj") & ~skipped(F.col("file"))).select(F.col("file").alias("project_path"))
    return own if listed.isEmpty() else listed


def tokens(files: DataFrame) -> DataFrame:
    """(file, token): the version of user code in each C# file, by the project in the nearest folder above it; ``project`` where there is none."""
    return _once(files, "tokens", lambda: cut(_tokens(files, project_files(files))))


def _tokens(files: DataFrame, projects: DataFrame) -> DataFrame:
    names = files.where(F.lower("file").endswith(".cs")).select("file")
    parts = F.split("file", "/")
    # each folder above a file is a key of its own, so the nearest one is an equi-join and a maximum
    above = names.select("file", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder"))
    homes = projects.select(F.regexp_replace(_folder(F.col("project_path")), "/$", "").alias("folder"), project_version(F.col("project_path")).alias("token"))
    nearest = above.join(homes, "folder").groupBy("file").agg(F.max(F.struct(F.length("folder").alias("n"), F.col("token").alias("token")))["token"].alias("token"))
    return names.join(nearest, "file", "left").select("file", F.coalesce("token", F.lit("project")).alias("token"))


def _http(files: DataFrame, scanner: str) -> DataFrame:
    made = lambda: cut(csharp.resolved(_records(files)).join(tokens(files), "file"))
    return _once(files, "http", made).where(F.col("scanner") == scanner)


def _span() -> Column:
    return emit.place(F.col("file"), F.col("line"), F.col("col"), F.col("end_line"), F.col("end_col"))


def _user(df: DataFrame, kind: str, fqn: Column, origin: str, refs: Column | None) -> DataFrame:
    named = emit.attributes(origin=F.lit(f'"{origin}"'), projectVersion=emit.text(F.col("token")))
    return emit.nodes(df, "main", kind, fqn, F.col("token"), F.concat(fqn, F.lit("@"), F.col("token")), named, refs)


def controllers(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Endpoints of controllers, and the methods that handle them by edge (their nodes come with the dotnet provider)."""
    found = _http(files, "controller")
    route = F.concat_ws(" ", "method", "route")
    named = emit.attributes(
        httpMethod=emit.text(F.col("method")), routeTemplate=emit.text(F.col("route")), controllerType=emit.text(F.col("owner")), actionName=emit.text(F.col("action")), responseTypes=F.when(F.size("codes") > 0, F.to_json("codes"))
    )
    ends = emit.nodes(found, "main", "HttpEndpoint", route, F.col("token"), route, named, _span())
    return ends, emit.edges(found, "main", node_id("Method", F.col("source"), F.col("token")), node_id("HttpEndpoint", route, F.col("token")), "HandlesRoute")


def minimal_api(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mapped endpoints, the lambdas and methods that handle them, and the edges between them."""
    found = _http(files, "minimal-api")
    route = F.concat_ws(" ", "method", "route")
    named = emit.attributes(httpMethod=emit.text(F.col("method")), routeTemplate=emit.text(F.col("route")), confidence=emit.text(F.col("confidence")), isMinimalApi=F.lit("true"))
    ends = emit.nodes(found, "main", "HttpEndpoint", route, F.col("token"), route, named, _span())
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*\z", "")
    made = F.concat(F.lit("lambda@"), stem, F.lit("-"), file_key_hash(F.col("file")), F.lit(":"), F.regexp_extract("source", "[0-9]+$", 0))
    handled = found.where("source is not null").withColumn("handler_name", F.when(F.col("handler") == "lambda", made).otherwise(F.col("source")))
    lambdas = _user(handled.where("handler = 'lambda'"), "Method", F.col("handler_name"), "lambda", _span())
    named_ones = handled.where("handler = 'name'").select("handler_name", "token").distinct()
    places = _methods(files).select("source", "token", F.col("refs").alias("at"))
    methods = named_ones.join(places, (F.col("source") == F.col("handler_name")) & (named_ones["token"] == places["token"])).select("handler_name", named_ones["token"], "at")
    nodes = emit.union(ends, lambdas, _user(methods, "Method", F.col("handler_name"), "user", F.col("at")))
    return nodes, emit.edges(handled, "main", node_id("Method", F.col("handler_name"), F.col("token")), node_id("HttpEndpoint", route, F.col("token")), "HandlesRoute")


def client_calls(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls by HttpClient, and the methods that make them by edge."""
    found = _http(files, "http-client")
    shown = F.concat_ws(" ", "method", "route")
    site = F.concat(shown, F.lit("@"), short_hash(F.concat(F.col("file"), F.lit(":"), (F.col("line") - 1).cast("string"))))
    named = emit.attributes(httpMethod=emit.text(F.col("method")), urlTemplate=emit.text(F.col("route")), confidence=emit.text(F.col("confidence")), callingMethod=emit.text(F.col("source")), clientName=emit.text(F.col("client")))
    nodes = emit.nodes(found, "main", "HttpCallSite", site, F.col("token"), shown, named, _span())
    calls = found.where("source is not null")
    return nodes, emit.edges(calls, "main", node_id("Method", F.col("source"), F.col("token")), node_id("HttpCallSite", site, F.col("token")), "CallsRoute", refs=_span())


def _methods(files: DataFrame) -> DataFrame:
    """(source, token, refs): the methods of user code, each once with all its places."""
    rows = _records(files).where("record = 'method'").join(tokens(files), "file")
    span = F.struct(*[F.col(c).alias(n) for c, n in (("line", "start_line"), ("col", "start_col"), ("end_line", "end_line"), ("end_col", "end_col"))])
    by_file = rows.groupBy("source", "token", "file").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    return by_file.groupBy("source", "token").agg(F.array_sort(F.collect_list(F.struct("file", "spans"))).alias("refs"))


def _assets(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_path, text) of the resolved packages of each project."""
    rows = files.where(F.lower("file").endswith("obj/project.assets.json")).select(F.regexp_replace("file", r"(?i)obj/project\.assets\.json\z", "").alias("folder"), "text")
    return projects.withColumn("folder", _folder(F.col("project_path"))).join(rows, "folder").select("project_path", "text")


def dotnet(known: DataFrame | None = None):
    """Collects projects, packages and what depends on what; with a table of package symbols (symbols.SYMBOLS_DDL) also the packages' API, and the user methods with what
    they call and use of it."""

    def collect(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        projects = project_files(files)
        name = F.regexp_replace(F.element_at(F.split("project_path", "/"), -1), r"(?i)\.csproj\z", "")
        uses = solution.dependencies(_assets(files, projects).withColumnRenamed("project_path", "project"))
        frameworks = uses.groupBy(F.col("project").alias("project_path")).agg(F.array_sort(F.collect_set("tfm")).alias("tfms"))  # of one project
        listed = projects.join(frameworks, "project_path", "left")
        named = emit.attributes(projectPath=emit.text(F.col("project_path")), targetFrameworks=F.to_json(F.coalesce("tfms", F.array().cast("array<string>"))))
        project_nodes = emit.nodes(listed, "main", "Project", name, F.lit("project"), name, named, emit.place(F.col("project_path")))
        package = emit.attributes(packageName=emit.text(F.col("package")), relativePath=emit.text(F.replace("path", F.lit("\\"), F.lit("/"))), version=emit.text(F.col("version")))
        one = uses.groupBy("package", "version").agg(F.min("path").alias("path"))
        package_nodes = emit.nodes(one, "main", "Package", F.col("package"), F.col("version"), F.concat_ws("@", "package", "version"), package)
        rows = uses.withColumn("project_path", F.col("project"))
        depends = emit.edges(
            rows, "main", node_id("Project", name, F.lit("project")), node_id("Package", F.col("package"), F.col("version")), "DependsOn", emit.attributes(isDirect=F.col("is_direct").cast("string"), tfm=emit.text(F.col("tfm")))
        )
        methods = _user(_methods(files), "Method", F.col("source"), "user", F.col("refs"))
        nodes, edges = emit.union(project_nodes, package_nodes, methods), depends
        if known is not None:
            api = symbols.graph(known)
            # usage is of the package version that the file's own project has; of several frameworks the last one counts
            versions = last_version(uses.select(F.concat_ws("\n", "project", "package").alias("package"), "version", F.col("tfm").alias("tfm_ord")))
            versions = versions.select(project_version(F.split("package", "\n")[0]).alias("token"), F.split("package", "\n")[1].alias("assembly"), "version")
            nodes, edges = emit.union(nodes, api.nodes), emit.union(edges, api.edges, _usage(files, known, versions))
        return nodes, edges

    return collect


def _usage(files: DataFrame, known: DataFrame, versions: DataFrame) -> DataFrame:
    """Calls and Uses edges from user methods to the symbols of the package versions of their project."""
    types = known.withColumn("type_name", F.concat_ws(".", F.nullif(F.col("namespace"), F.lit("")), "type"))
    by_type = types.select("assembly", "version", F.lit("Type").alias("kind"), F.col("type").alias("name"), node_id("Type", F.col("type_name"), F.col("version")).alias("target"))
    by_method = types.select("assembly", "version", "type_name", F.explode("methods").alias("m")).select("assembly", "version", F.lit("Method").alias("kind"), F.col("m.name").alias("name"), node_id("Method", F.concat_ws(".", "type_name", "m.signature"), F.col("version")).alias("target"))
    table = by_type.unionByName(by_method).select(F.concat_ws("\n", "target", "assembly", "version").alias("symbol_id"), "kind", "name")
    sites = csharp.scan_uses(files, table).join(tokens(files), "file")
    at = F.split("symbol_id", "\n")
    sites = sites.select("file", "source", "usage", "token", "line", "col", "end_col", at[0].alias("target"), at[1].alias("assembly"), at[2].alias("version")).join(versions, ["token", "assembly", "version"], "left_semi")
    span = F.struct(F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("line").alias("end_line"), F.col("end_col")).cast(SPAN_DDL)
    sums = usage_edges(sites.select(node_id("Method", F.col("source"), F.col("token")).alias("from_id"), F.col("target").alias("to_id"), F.col("usage").alias("kind"), "file", span.alias("span")))
    count = F.col("count").cast("string")
    named = emit.attributes(callCount=F.when(F.col("kind") == "Calls", count), referenceCount=F.when(F.col("kind") == "Uses", count))
    return emit.edges(sums, "main", F.col("from_id"), F.col("to_id"), F.col("kind"), named, F.col("source_refs"))


def _only_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes, nodes.sparkSession.createDataFrame([], EDGE_DDL)


def _outside(files: DataFrame, *extensions: str) -> DataFrame:
    """Files with one of the extensions, in no folder that is passed over."""
    name = F.lower("file")
    wanted = name.endswith(extensions[0])
    for e in extensions[1:]:
        wanted = wanted | name.endswith(e)
    return files.where(wanted & ~skipped(F.col("file")) & F.col("text").isNotNull())


def scripts(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _only_nodes(script.nodes(script.scan(_outside(files, ".js", ".jsx", ".ts", ".tsx"))))


def request_files(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _only_nodes(requests.nodes(_outside(files, ".http", ".rest")))


def specifications(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    stem = F.regexp_replace(F.lower(F.element_at(F.split("file", "/"), -1)), r"\.[^.]*\z", "")
    inner = F.lower(F.concat(F.lit("/"), F.col("file")))
    return openapi.graph(files.where(F.lower("file").rlike(r"\.(json|yaml|yml)\z") & (stem.contains("openapi") | stem.contains("swagger")) & ~inner.contains("/obj/") & ~inner.contains("/bin/") & F.col("text").isNotNull()))


def collections(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _only_nodes(postman.nodes(_outside(files, ".postman_collection.json")))


def standard(known: DataFrame | None = None) -> list[Provider]:
    """All providers in the order in which they are merged; known: a table of package symbols."""
    # Their names.
    return [
        Provider("dotnet", dotnet(known)),
        Provider("dotnet-controller-endpoints", controllers),
        Provider("dotnet-minimal-api", minimal_api),
        Provider("dotnet-http-callsite", client_calls),
        Provider("http-file-callsite", request_files),
        Provider("js-fetch-callsite", scripts),
        Provider("openapi-spec", specifications),
        Provider("postman-callsite", collections),
    ]


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, text) of all files below a folder that some provider reads, paths relative to it."""
    from loomgraph.operators.changes import below, classify

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = raw.select(below(F.col("path"), root).alias("file"), F.decode("content", "UTF-8").alias("text"))
    return named.where(classify(F.col("file")).isNotNull() | F.lower("file").rlike(r"\.slnx?\z"))

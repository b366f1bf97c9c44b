"""What changed between two states of a workspace, and what has to run again."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.merge import merge_edges, merge_nodes, remove_owned

# Which providers read which kind of input.
PROVIDERS = (
    ("source", "dotnet"),
    ("source", "dotnet-controller-endpoints"),
    ("source", "dotnet-minimal-api"),
    ("source", "dotnet-http-callsite"),
    ("source", "js-fetch-callsite"),
    ("project", "dotnet"),
    ("project", "dotnet-controller-endpoints"),
    ("project", "dotnet-minimal-api"),
    ("project", "dotnet-http-callsite"),
    ("dependency", "dotnet"),
    ("dependency", "dotnet-controller-endpoints"),
    ("dependency", "dotnet-minimal-api"),
    ("dependency", "dotnet-http-callsite"),
    ("http-spec", "http-file-callsite"),
    ("http-spec", "openapi-spec"),
    ("http-spec", "postman-callsite"),
)
# File names and extensions by kind of input, and folders that are passed over.
DEPENDENCY_FILES = ("project.assets.json", "packages.lock.json", "directory.packages.props")
PROJECT_FILES = ("directory.build.props", "directory.build.targets", "global.json", "nuget.config")
SOURCE_EXTENSIONS = (".cs", ".js", ".jsx", ".ts", ".tsx")
SPEC_EXTENSIONS = (".json", ".yaml", ".yml")
SKIPPED_FOLDERS = (".git", "bin", "obj", "node_modules")


def classify(path: Column) -> Column:
    """dependency, project, http-spec or source; null for a file that is no input."""
    p = F.concat(F.lit("/"), F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))
    name = F.element_at(F.split(p, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    extension = F.regexp_extract(name, r"\.[^.]*$", 0)
    spec = extension.isin(*SPEC_EXTENSIONS) & ~p.contains("/obj/") & ~p.contains("/bin/") & (stem.contains("openapi") | stem.contains("swagger"))
    return (
        F.when(name.isin(*DEPENDENCY_FILES), "dependency")
        .when(name.isin(*PROJECT_FILES) | (extension == ".csproj"), "project")
        .when(extension.isin(".http", ".rest") | name.endswith(".postman_collection.json") | spec, "http-spec")
        .when(extension.isin(*SOURCE_EXTENSIONS), "source")
    )


def skipped(path: Column) -> Column:
    """Whether a file lies in a folder that is passed over."""
    return F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/"))).rlike("(?i)/(" + "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS) + ")/")


def below(path: Column, root: str) -> Column:
    """A path as Spark lists it, relative to the folder that was read; slashes after a scheme and %-escapes of the listing do not matter."""
    bare = lambda c: F.regexp_replace(c, r"\A[a-z]+:/*", "/")
    top = re.sub(r"\A[a-z]+:/*", "/", root.rstrip("/")) + "/"
    plain = F.coalesce(F.try_url_decode(F.replace(bare(path), F.lit("+"), F.lit("%2B"))), bare(path))
    return F.when(plain.startswith(top), F.substr(plain, F.lit(len(top) + 1))).otherwise(plain)


def hash_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(key, kind, rel_path, sha256) of the input files below root, each once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return input_hashes(files.select(below(F.col("path"), root).alias("rel_path"), "content"))


def input_hashes(files: DataFrame) -> DataFrame:
    """(key, kind, rel_path, sha256) of the inputs among files (rel_path, content), each once."""
    rows = files.select("rel_path", F.sha2("content", 256).alias("sha256")).withColumn("kind", classify(F.col("rel_path"))).where("kind is not null")
    assets = F.lower("rel_path").endswith("project.assets.json")  # counts even in a folder that is passed over
    return rows.where(assets | ~skipped(F.col("rel_path"))).select(F.concat_ws(":", "kind", "rel_path").alias("key"), "kind", "rel_path", "sha256").dropDuplicates(["key"])


def parse_key(key: Column) -> Column:
    """struct<kind, rel_path> of ``kind:rel_path``."""
    parts = F.split(key, ":", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).alias("rel_path"))


def changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(kind, rel_path, change): added, modified or deleted. Both: key, sha256."""
    both = previous.select("key", F.col("sha256").alias("old")).join(current.select("key", F.col("sha256").alias("new")), "key", "full_outer")
    what = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(parse_key(F.col("key")).alias("k"), what.alias("change")).select("k.kind", "k.rel_path", "change")


def changed_set(*changes: DataFrame) -> DataFrame:
    """(file): the different files of several sets of changes."""
    out = changes[0].select(F.col("rel_path").alias("file"))
    for c in changes[1:]:
        out = out.unionByName(c.select(F.col("rel_path").alias("file")))
    return out.distinct()


def changed_kinds(changes: DataFrame) -> DataFrame:
    return changes.select("kind").distinct()


def providers_to_run(changes: DataFrame) -> DataFrame:
    """(provider_id) that the changes ask for."""
    spark = changes.sparkSession
    rules = spark.createDataFrame(list(PROVIDERS), "kind string, provider_id string")
    return rules.join(changed_kinds(changes), "kind", "left_semi").select("provider_id").distinct()


def incremental(previous: PropertyGraph, changes: DataFrame, collect: Callable[[list[str], DataFrame], tuple[DataFrame, DataFrame]]) -> PropertyGraph:
    """The graph after changes: what changed files owned goes, what the providers asked for find in them comes, the last one wins.

    collect(provider ids, changed files) gives node and edge fragments with provider_ord and seq. Without a change the graph is returned
    as it is. Nodes that refer to no file, such as packages, stay."""
    wanted = [r["provider_id"] for r in providers_to_run(changes).collect()]  # eight at most
    if not wanted:
        return previous
    files = changes.select(F.col("rel_path").alias("file"))
    nodes, edges = remove_owned(previous.nodes, previous.edges, files)
    new_nodes, new_edges = collect(sorted(wanted), files)
    first = lambda df: df.withColumn("provider_ord", F.lit(-1)).withColumn("seq", F.lit(0).cast("long"))
    return PropertyGraph(merge_nodes(first(nodes).unionByName(new_nodes)), merge_edges(first(edges).unionByName(new_edges)))

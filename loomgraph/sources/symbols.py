"""Package symbols as graph: assemblies, namespaces, types, methods and how types relate (the graph side of S7; J16, J17).

Symbols come as a table, one row for each exported type, from assemblies.read() or whatever else reads assemblies. Where its methods have a field ``shown``, that is
their signature in the graph; the identifier is made of ``signature``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.attributes import quoted
from loomgraph.functions.ids import node_id
from loomgraph.operators.graph import PropertyGraph
from loomgraph.schema import REFS_DDL

#: The input: base and interfaces are full names; inherited are the interfaces that the base has already.
SYMBOLS_DDL = "package string, version string, assembly string, namespace string, type string, kind string, base string, interfaces array<string>, inherited array<string>, methods array<struct<name:string,signature:string>>"


def graph(symbols: DataFrame, workspace: str = "main") -> PropertyGraph:
    """Nodes from packages down to methods with their Contains edges; Inherits and Implements to known types of the same version, else to
    an ExternalRef. The root object is no base, and interfaces that come with the base are left out."""
    version = F.col("version")
    s = symbols.withColumn("type_name", F.concat_ws(".", F.nullif(F.col("namespace"), F.lit("")), "type"))
    shown = "shown" if "shown" in s.schema["methods"].dataType.elementType.names else "signature"
    listed = s.select("version", "type_name", F.explode("methods").alias("m")).select("version", "type_name", F.concat_ws(".", "type_name", "m.signature").alias("method_name"), F.col(f"m.{shown}").alias("signature"))
    methods = listed.groupBy("version", "type_name", "method_name").agg(F.min("signature").alias("signature"))
    space = F.when(F.coalesce("namespace", F.lit("")) == "", F.lit("global")).otherwise(F.col("namespace"))

    def node(df: DataFrame, label: str, fqn: Column, /, **attributes: Column) -> DataFrame:
        pairs = [x for k, v in sorted(attributes.items()) for x in (F.lit(k), quoted(v))]
        return df.select(
            F.lit(workspace).alias("workspace"),
            node_id(label, fqn, F.col("version")).alias("id"),
            F.lit(label).alias("kind"),
            fqn.alias("fqn"),
            "version",
            fqn.alias("display_name"),
            (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("attributes"),
            F.lit(None).cast(REFS_DDL).alias("source_refs"),
        )

    def edge(df: DataFrame, source: Column, target: Column, kind: Column | str) -> DataFrame:
        k = F.lit(kind) if isinstance(kind, str) else kind
        return df.select(F.lit(workspace).alias("workspace"), source.alias("from_id"), target.alias("to_id"), k.alias("kind")).distinct().select(
            "*", F.create_map().cast("map<string,string>").alias("attributes"), F.lit(None).cast(REFS_DDL).alias("source_refs")
        )

    at = lambda kind, fqn: node_id(kind, fqn, version)
    wanted = F.array_union(
        F.when(F.col("base").isNull() | F.col("base").isin("System.Object", "object"), F.array().cast("array<struct<name:string,kind:string>>")).otherwise(F.array(F.struct(F.col("base").alias("name"), F.lit("Inherits").alias("kind")))),
        F.transform(F.array_except(F.coalesce("interfaces", F.array().cast("array<string>")), F.coalesce("inherited", F.array().cast("array<string>"))), lambda i: F.struct(i.alias("name"), F.lit("Implements").alias("kind"))),
    )
    relations = s.select("version", "type_name", F.explode(wanted).alias("r")).select("version", "type_name", "r.name", "r.kind")
    known = s.select("version", F.col("type_name").alias("name")).distinct().withColumn("known", F.lit(True))
    related = relations.join(known, ["version", "name"], "left")
    external = related.where("known is null").select("name", F.lit("external").alias("version"), F.col("version").alias("from_version")).groupBy("name", "version").agg(F.min("from_version").alias("from_version"))
    nodes = [
        node(s.select("package", "version").distinct(), "Package", F.col("package"), packageName=F.col("package"), version=version),
        node(s.select("assembly", "version").distinct(), "Assembly", F.col("assembly")),
        node(s.groupBy(space.alias("space"), "version").agg(F.min("assembly").alias("assembly")), "Namespace", F.col("space"), assemblyName=F.col("assembly")),
        node(s.groupBy("type_name", "version").agg(F.min("kind").alias("k"), F.min("assembly").alias("assembly")), "Type", F.col("type_name"), kind=F.col("k"), assemblyName=F.col("assembly")),
        node(methods, "Method", F.col("method_name"), signature=F.col("signature"), declaringType=F.col("type_name")),
        node(external, "ExternalRef", F.col("name"), packageVersion=F.col("from_version")),
    ]
    edges = [
        edge(s, at("Package", F.col("package")), at("Assembly", F.col("assembly")), "Contains"),
        edge(s, at("Assembly", F.col("assembly")), at("Namespace", space), "Contains"),
        edge(s, at("Namespace", space), at("Type", F.col("type_name")), "Contains"),
        edge(methods, at("Type", F.col("type_name")), at("Method", F.col("method_name")), "Contains"),
        edge(related, at("Type", F.col("type_name")), F.when(F.col("known"), at("Type", F.col("name"))).otherwise(node_id("ExternalRef", F.col("name"), F.lit("external"))), F.col("kind")),
    ]
    return PropertyGraph(_union(nodes), _union(edges))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

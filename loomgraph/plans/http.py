"""Questions about HTTP: an index of routes, and who serves and calls one (Q6, Q7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import attributes as attr
from loomgraph.functions.routes import normal_method, normal_path
from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans.scope import within


def http_index(graph: PropertyGraph, match_on: str = "routeTemplate") -> DataFrame:
    """(workspace, node_id, role, method, path) of all endpoints and call sites with a method and a route. Strictly only
    ``routeTemplate`` counts; match_on="coalesce" lets call sites fall back to ``urlTemplate``."""
    a = F.col("attributes")
    route = attr.text(a, "routeTemplate")
    if match_on == "coalesce":
        route = F.coalesce(attr.optional(route), attr.text(a, "urlTemplate"))
    rows = graph.nodes.where(F.col("kind").isin("HttpEndpoint", "HttpCallSite")).select(
        "workspace", F.col("id").alias("node_id"), F.when(F.col("kind") == "HttpEndpoint", "Producer").otherwise("Consumer").alias("role"), attr.optional(attr.text(a, "httpMethod")).alias("m"), attr.optional(route).alias("r")
    )
    return rows.where("m is not null and r is not null").select("workspace", "node_id", "role", normal_method(F.col("m")).alias("method"), normal_path(F.col("r")).alias("path"))


def _first_source(graph: PropertyGraph, kind: str, nodes: DataFrame) -> DataFrame:
    """(workspace, node_id, source_id): the first existing source, in edge order, of edges of a kind."""
    edges = graph.edges.where(F.col("kind") == kind).select("workspace", F.col("to_id").alias("node_id"), "from_id", "to_id", "kind", "source_refs").join(nodes, ["workspace", "node_id"], "left_semi")
    exist = graph.nodes.select("workspace", F.col("id").alias("from_id"))
    keys = F.struct(F.col("from_id"), F.coalesce(F.to_json("source_refs"), F.lit("")).alias("r"))
    return edges.join(exist, ["workspace", "from_id"], "left_semi").groupBy("workspace", "node_id").agg(F.min(keys).alias("k")).select("workspace", "node_id", F.col("k.from_id").alias("source_id"))


def trace_http(graph: PropertyGraph, method: str, path: str, workspaces: Sequence[str] | None = None, match_on: str = "routeTemplate") -> DataFrame:
    """Producers and consumers of a route: workspace, node_id, role, the handler or caller, path as written, and the first place."""
    spark = graph.nodes.sparkSession
    asked = spark.range(1).select(normal_method(F.lit(method)).alias("method"), normal_path(F.lit(path)).alias("path"))
    hits = http_index(graph, match_on).where(within(workspaces)).join(asked, ["method", "path"])
    nodes = graph.nodes.where(F.col("kind").isin("HttpEndpoint", "HttpCallSite")).select("workspace", F.col("id").alias("node_id"), "attributes", "source_refs")
    hits = hits.join(nodes, ["workspace", "node_id"])
    keys = hits.select("workspace", "node_id")
    sources = _first_source(graph, "HandlesRoute", keys).unionByName(_first_source(graph, "CallsRoute", keys))
    a = F.col("attributes")
    written = F.when(F.col("role") == "Consumer", F.coalesce(attr.text(a, "urlTemplate"), attr.text(a, "routeTemplate"))).otherwise(attr.text(a, "routeTemplate"))
    by = F.when(F.col("role") == "Consumer", F.coalesce("source_id", attr.text(a, "callingMethod"))).otherwise(F.col("source_id"))
    ref = F.get("source_refs", F.lit(0))
    return hits.join(sources, ["workspace", "node_id"], "left").select(
        "workspace", "node_id", "role", "method", "path", by.alias("source"), written.alias("written"), ref["file"].alias("file"), F.get(ref["spans"], F.lit(0))["start_line"].alias("line"), F.get(ref["spans"], F.lit(0))["start_col"].alias("col")
    )


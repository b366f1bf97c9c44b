"""Endpoint reconciliation: endpoints of one route, found by several sources, become one.

Agreeing attributes keep their name; where sources disagree, each value stands under ``name:source``, in plain sight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import attributes as attr
from loomgraph.functions.attributes import canonical_key
from loomgraph.functions.routes import normal_method, normal_path
from loomgraph.lineage import cut
from loomgraph.operators.graph import PropertyGraph


def _members(nodes: DataFrame) -> DataFrame:
    """Endpoints with their route, their group's size and its chosen identifier: an ``openapi`` one first, else the least."""
    a = F.col("attributes")
    ends = nodes.where(F.col("kind") == "HttpEndpoint").withColumn("route", F.concat_ws(" ", normal_method(attr.text(a, "httpMethod")), normal_path(attr.text(a, "routeTemplate"))))
    groups = ends.groupBy("workspace", "route").agg(F.min(F.struct((F.col("version") != "openapi").alias("late"), F.col("id").alias("id"))).alias("best"), F.count(F.lit(1)).alias("size"))
    return ends.join(groups.select("workspace", "route", F.col("best.id").alias("canonical"), "size"), ["workspace", "route"])


def id_map(nodes: DataFrame) -> DataFrame:
    """(workspace, id, canonical) of all endpoints."""
    return _members(nodes).select("workspace", "id", "canonical")


def merged_attributes(nodes: DataFrame) -> DataFrame:
    """(workspace, canonical, name, value) of the groups of two endpoints or more."""
    return _attributes(_members(nodes))


def _attributes(members: DataFrame) -> DataFrame:
    many = members.where("size > 1")
    source = F.coalesce(F.nullif(attr.text(F.col("attributes"), "source"), F.lit("")), F.when(F.lower("version").startswith("project-"), "static").otherwise(F.col("version")))
    pairs = many.select("workspace", "canonical", "id", source.alias("source"), F.explode("attributes").alias("name", "value"))
    # one row for each value, then one for each name: a route that a third of all endpoints share is summed up before it moves
    values = pairs.groupBy("workspace", "canonical", "name", "source").agg(F.max_by("value", "id").alias("value"), F.min("value").alias("low"), F.max("value").alias("high"))
    agree = values.groupBy("workspace", "canonical", "name").agg((F.min("low") == F.max("high")).alias("agree"))
    joined = values.join(agree, ["workspace", "canonical", "name"])
    plain = joined.where("agree").select("workspace", "canonical", "name", "value").distinct()
    tagged = joined.where("not agree").select("workspace", "canonical", F.when(F.col("source") == "", F.col("name")).otherwise(F.concat_ws(":", "name", "source")).alias("name"), "value")
    return plain.unionByName(tagged)


def reconcile_nodes(nodes: DataFrame) -> DataFrame:
    """All nodes, with the endpoints of one route merged into one."""
    members = cut(_members(nodes))  # used three times
    refs = (
        members.where("size > 1").select("workspace", "canonical", F.explode("source_refs").alias("ref")).distinct().groupBy("workspace", "canonical").agg(F.array_sort(F.collect_list("ref")).alias("source_refs"))
    )
    maps = _attributes(members).groupBy("workspace", "canonical").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))
    head = members.where("size > 1 and id = canonical").drop("attributes", "source_refs", "route", "size").dropDuplicates(["workspace", "id"])
    one = head.join(maps, ["workspace", "canonical"], "left").join(refs, ["workspace", "canonical"], "left").drop("canonical")
    alone = members.where("size = 1").select(nodes.columns)
    return nodes.where(F.col("kind") != "HttpEndpoint").unionByName(alone).unionByName(one.select(nodes.columns))


def reconcile_edges(nodes: DataFrame, edges: DataFrame, dedup: str = "strict") -> DataFrame:
    """Edges moved to the merged endpoints, then one for each source, target and kind, the first in edge order; attributes tell edges
    apart only with dedup="with_attributes". A graph without endpoints keeps its edges as they are."""
    ids = cut(id_map(nodes))
    if ids.isEmpty():
        return edges
    moved = edges
    for end in ("from_id", "to_id"):
        new = ids.select(F.col("workspace"), F.col("id").alias(end), F.col("canonical").alias("__new"))
        moved = moved.withColumn("__was_" + end, F.col(end)).join(new, ["workspace", end], "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    key = ["workspace", "from_id", "to_id", "kind"]
    named = [*key, canonical_key(F.col("attributes")).alias("__attr")] if dedup == "with_attributes" else key
    order = F.struct("__was_from_id", "__was_to_id", F.coalesce(F.to_json("source_refs"), F.lit("")).alias("r"), canonical_key(F.col("attributes")).alias("a"))
    folded = moved.groupBy(*named).agg(F.min_by(F.struct("attributes", "source_refs"), order).alias("x"))
    return folded.select(*key, "x.attributes", "x.source_refs").select(edges.columns)


def reconcile(graph: PropertyGraph, dedup: str = "strict") -> PropertyGraph:
    """The graph with its endpoints merged."""
    return PropertyGraph(reconcile_nodes(graph.nodes), reconcile_edges(graph.nodes, graph.edges, dedup))

"""A property graph in two DataFrames, its lookups and traversals.

Nothing is indexed or collected: every lookup is a filter that reaches the scan, every traversal an equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.lineage import cut


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    def node(self, node_id: str) -> DataFrame:
        """The node of an identifier, or no row."""
        return self.nodes.where(F.col("id") == node_id)

    def find(self, kind: str, predicate: Column | None = None) -> DataFrame:
        """The nodes of a kind that fulfil a predicate."""
        found = self.nodes.where(F.col("kind") == kind)
        return found if predicate is None else found.where(predicate)

    def find_edges(self, from_id: str | None = None, to_id: str | None = None, kind: str | None = None) -> DataFrame:
        """Edges by any of source, target and kind."""
        found = self.edges
        for column, value in (("from_id", from_id), ("to_id", to_id), ("kind", kind)):
            if value is not None:
                found = found.where(F.col(column) == value)
        return found

    def neighbors(self, node_id: str, direction: str = "outgoing", kind: str | None = None) -> DataFrame:
        """The distinct existing nodes at the other end of a node's edges; for a loop the node itself."""
        edges = self.edges if kind is None else self.edges.where(F.col("kind") == kind)
        source, target = F.col("from_id") == node_id, F.col("to_id") == node_id
        if direction == "outgoing":
            ends = edges.where(source).select(F.col("to_id").alias("id"))
        elif direction == "incoming":
            ends = edges.where(target).select(F.col("from_id").alias("id"))
        elif direction == "both":
            ends = edges.where(source | target).select(F.when(source, F.col("to_id")).otherwise(F.col("from_id")).alias("id"))
        else:
            raise ValueError(f"no such direction: {direction}")
        return self.nodes.join(ends.distinct(), "id", "left_semi")

    def by_name_prefix(self, prefix: str) -> DataFrame:
        """Nodes whose display name begins with prefix, in any case; none for a blank prefix."""
        p = prefix.strip().lower()
        return self.nodes.where(F.lower(F.trim("display_name")).startswith(p)) if p else self.nodes.where(F.lit(False))

    def by_attribute(self, key: str) -> DataFrame:
        """Nodes that have an attribute."""
        return self.nodes.where(F.map_contains_key("attributes", key.strip()))

    def contained(self, roots: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        """Follows Contains edges from roots (workspace, id) through one level for each of kinds. Columns: workspace, id and, for each
        kind in lower case, its node identifier and fqn (null below where a level has nothing)."""
        contains = self.edges.where(F.col("kind") == "Contains").select("workspace", "from_id", "to_id")
        if len(kinds) > 1:  # every level reads them
            contains = cut(contains)
        out, last = cut(roots.select("workspace", "id")), "id"
        for i, kind in enumerate(kinds):
            name = kind.lower()
            # what was reached last meets its edges, then the nodes at their ends: no level joins all edges with all nodes, and each is computed once
            reached = out.select("workspace", F.col(last).alias("from_id")).where("from_id is not null").distinct()
            ends = contains.join(reached, ["workspace", "from_id"], "left_semi")
            node = self.nodes.where(F.col("kind") == kind).select("workspace", F.col("id").alias("to_id"), F.col("fqn").alias(f"{name}_fqn"), F.col("attributes").alias(f"{name}_attributes"))
            step = ends.join(node, ["workspace", "to_id"]).select(F.col("workspace").alias(f"w{i}"), F.col("from_id").alias(f"from{i}"), F.col("to_id").alias(f"{name}_id"), f"{name}_fqn", f"{name}_attributes")
            out = cut(out.join(step, (F.col("workspace") == F.col(f"w{i}")) & (F.col(last) == F.col(f"from{i}")), "left").drop(f"w{i}", f"from{i}"))
            last = f"{name}_id"
        return out

    def ordered(self) -> PropertyGraph:
        """The graph with nodes and edges in their fixed orders."""
        return PropertyGraph(self.nodes.orderBy(*node_order()), self.edges.orderBy(*edge_order()))


def node_order() -> list[Column]:
    return [F.col("id").asc()]


def edge_order() -> list[Column]:
    """Edges in their fixed order: source, target, name of the kind, references."""
    return [F.col("from_id").asc(), F.col("to_id").asc(), F.col("kind").asc(), F.to_json("source_refs").asc_nulls_first()]


def dangling(edges: DataFrame, nodes: DataFrame, end: str = "to_id") -> DataFrame:
    """Edges whose end is no node."""
    return edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti")


def contains_across_versions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Contains edges that join two versions, which a sound graph does not have."""
    v = nodes.select("id", "version")
    return (
        edges.where(F.col("kind") == "Contains")
        .join(v.select(F.col("id").alias("from_id"), F.col("version").alias("from_version")), "from_id")
        .join(v.select(F.col("id").alias("to_id"), F.col("version").alias("to_version")), "to_id")
        .where("from_version <> to_version")
    )

"""Building a graph from providers, whole or for what changed (U1, W5-W9; the write path).

A provider is a name and a function from (spark, files) to node and edge DataFrames, where files are (file, text). Providers are
merged in the order of their registration; within one provider the identifier breaks ties.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomgraph.lineage import cut
from loomgraph.operators.changes import changed_files, providers_to_run
from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.merge import merge_edges, merge_nodes
from loomgraph.operators.reconcile import reconcile
from loomgraph.sources import store


@dataclass(frozen=True)
class Provider:
    """A source of nodes and edges; the only thing to plug in."""

    id: str
    collect: Callable[[SparkSession, DataFrame], tuple[DataFrame, DataFrame]]


def fragments(spark: SparkSession, providers: Sequence[Provider], files: DataFrame, only: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What all providers (or those named) find, with the order in which it counts."""
    parts = []
    for i, p in enumerate(providers):
        if only is None or p.id in only:
            nodes, edges = p.collect(spark, files)
            parts.append((store.ordered(nodes, i), store.ordered(edges, i)))
    if not parts:
        raise ValueError("no provider to run")
    nodes, edges = parts[0]
    for n, e in parts[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes, edges


def build(spark: SparkSession, providers: Sequence[Provider], files: DataFrame, reconciled: bool = True, cache: str | None = None) -> PropertyGraph:
    """The graph of all files. With a cache folder what each provider finds is kept there, for update()."""
    if cache is not None:
        for i, p in enumerate(providers):
            store.save_fragment(cache, p.id, i, *p.collect(spark, files))
        return _finished(_merged(*store.load_fragments(spark, cache, [p.id for p in providers])), reconciled)
    return _finished(_merged(*fragments(spark, providers, files)), reconciled)


def _merged(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    return PropertyGraph(merge_nodes(nodes), merge_edges(edges))


def _finished(graph: PropertyGraph, reconciled: bool) -> PropertyGraph:
    """Each state of a graph is written once: what asks and updates it later starts from there."""
    graph = PropertyGraph(cut(graph.nodes), cut(graph.edges))
    if reconciled:
        merged = reconcile(graph)
        graph = PropertyGraph(cut(merged.nodes), cut(merged.edges))
    return graph


def update(
    spark: SparkSession, providers: Sequence[Provider], previous: PropertyGraph, old_hashes: DataFrame, new_hashes: DataFrame, files: DataFrame, reconciled: bool = True, cache: str | None = None
) -> PropertyGraph:
    """The graph after a change; files are all files as they are now. Where no registered provider reads what changed, it is the previous graph.

    With a cache folder that has a fragment of every provider (any missing one counts as all), only the providers that read a changed kind of file run, each over
    all files: what one finds in an unchanged file may hang on a changed one (a call of a method there, an assembly of a project). The fragments of the others are read,
    all are merged as in a whole build, before endpoints are reconciled, so the graph is the one that build() gives. Without a cache everything runs."""
    if old_hashes.isEmpty():
        return build(spark, providers, files, reconciled, cache)
    wanted = {r["provider_id"] for r in providers_to_run(changed_files(old_hashes, new_hashes)).collect()}  # eight at most
    run = [(i, p) for i, p in enumerate(providers) if p.id in wanted]
    if not run:
        return previous
    names = [p.id for p in providers]
    if cache is None or not store.has_fragments(spark, cache, names):
        return build(spark, providers, files, reconciled, cache)
    for i, p in run:
        store.save_fragment(cache, p.id, i, *p.collect(spark, files))
    return _finished(_merged(*store.load_fragments(spark, cache, names)), reconciled)

"""Questions about packages: their API, who depends on them, which versions conflict (Q1-Q3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import attributes as attr
from loomgraph.operators.graph import PropertyGraph, dangling
from loomgraph.plans.scope import required, within


def _escaped(text: str) -> str:
    out = []
    for c in text:
        if c.isascii() and (c.isalnum() or c in "._+-"):
            out.append(c)
        else:
            data = c.encode("utf-16-be")
            out += [f"~{data[i : i + 2].hex().upper()}" for i in range(0, len(data), 2)]
    return "".join(out)


def package_id(package: str, version: str) -> str:
    return f"Package:{_escaped(required(package, 'package'))}@{_escaped(required(version, 'version'))}"


def describe_api(graph: PropertyGraph, package: str, version: str, tfm: str | None = None, pattern: str | None = None, workspaces: Sequence[str] | None = None) -> DataFrame:
    """The API of a package: workspace, namespace, type, method, signature, a row for each method kept; a type kept for its own
    name and a namespace without kept types have rows with nulls.

    The pattern is searched in type and method names. A workspace takes part if it has the package and, given a framework,
    depends on it for that framework. Of a type that two assemblies or workspaces have, the last one counts."""
    wanted = package_id(package, version)
    roots = graph.nodes.where((F.col("kind") == "Package") & (F.col("id") == wanted) & within(workspaces))
    if tfm is not None:
        used = graph.edges.where((F.col("kind") == "DependsOn") & (F.col("to_id") == wanted) & (attr.text(F.col("attributes"), "tfm") == tfm)).select("workspace")
        roots = roots.join(used, "workspace", "left_semi")
    flat = graph.contained(roots, ("Assembly", "Namespace", "Type", "Method")).where("namespace_id is not null")
    rows = flat.select(
        "workspace",
        F.col("namespace_fqn").alias("namespace"),
        F.col("assembly_id"),
        F.col("type_id"),
        F.col("type_fqn").alias("type"),
        F.col("method_fqn").alias("method"),
        attr.text(F.col("method_attributes"), "signature").alias("signature"),
    )
    hit = F.lit(True) if pattern is None else F.col("method").rlike(pattern)
    own = F.lit(True) if pattern is None else F.col("type").rlike(pattern)
    last = F.max(F.struct("workspace", "assembly_id", "type_id")).over(Window.partitionBy("namespace", "type"))
    typed = rows.where("type_id is not null").where(F.coalesce(own, F.lit(False)) | F.coalesce(hit, F.lit(False)))
    typed = typed.withColumn("last", last).where(F.struct("workspace", "assembly_id", "type_id") == F.col("last"))
    listed = typed.select("namespace", "type", F.when(F.coalesce(hit, F.lit(False)), F.col("method")).alias("method"), F.when(F.coalesce(hit, F.lit(False)), F.col("signature")).alias("signature")).distinct()
    spaces = rows.select("namespace").distinct()
    return spaces.join(listed, "namespace", "left").select("namespace", "type", "method", "signature")


def _projects(graph: PropertyGraph, workspaces: Sequence[str] | None, project: str | None = None) -> DataFrame:
    found = graph.nodes.where((F.col("kind") == "Project") & within(workspaces))
    path = attr.text(F.col("attributes"), "projectPath")
    if project is not None and project.strip():
        p = project.strip().upper()
        found = found.where((F.upper("display_name") == p) | (F.upper("fqn") == p) | (F.upper(path) == p))
    return found.select("workspace", F.col("id").alias("project_id"), F.col("display_name").alias("project"), F.array_join(attr.texts(F.col("attributes"), "targetFrameworks"), ",").alias("target_frameworks"))


def _uses(graph: PropertyGraph) -> DataFrame:
    """DependsOn edges with their package."""
    e = graph.edges.where(F.col("kind") == "DependsOn").select("workspace", "from_id", "to_id", attr.text(F.col("attributes"), "tfm").alias("tfm"), attr.flag(F.col("attributes"), "isDirect").alias("is_direct"))
    p = graph.nodes.where(F.col("kind") == "Package").select(
        "workspace", F.col("id").alias("to_id"), F.coalesce(attr.text(F.col("attributes"), "packageName"), F.col("fqn")).alias("package"), F.coalesce(attr.text(F.col("attributes"), "version"), F.col("version")).alias("version")
    )
    return e.join(p, ["workspace", "to_id"])


def list_dependencies(graph: PropertyGraph, project: str | None = None, workspaces: Sequence[str] | None = None, check: bool = False) -> DataFrame:
    """Every project (or the one named by display name, fqn or path, in any case) with each package it depends on; one without
    dependencies has a row of nulls. With check, an edge to a package that is not there is an error."""
    if check and not dangling(graph.edges.where("kind = 'DependsOn'"), graph.nodes).isEmpty():
        raise ValueError("a dependency has no package node")
    uses = _uses(graph).select(F.col("workspace").alias("w"), "from_id", "package", "version", "is_direct", "tfm", F.col("to_id").alias("package_id"))
    projects = _projects(graph, workspaces, project)
    return projects.join(uses, (F.col("project_id") == F.col("from_id")) & (F.col("workspace") == F.col("w")), "left").drop("w", "from_id")


def version_conflicts(graph: PropertyGraph, workspaces: Sequence[str] | None = None) -> DataFrame:
    """Packages that the projects of a workspace use in two versions or more, with all their uses and the sorted versions."""
    rows = _uses(graph).where(within(workspaces)).join(_projects(graph, workspaces).select(F.col("workspace"), F.col("project_id").alias("from_id"), "project"), ["workspace", "from_id"])
    # two aggregations with partial sums stay small for a package that a third of all rows use; a window would not
    versions = rows.select("workspace", "package", "version").distinct().groupBy("workspace", "package").agg(F.array_join(F.array_sort(F.collect_list("version")), ",").alias("versions"), F.count(F.lit(1)).alias("n"))
    return rows.join(versions.where("n > 1"), ["workspace", "package"]).select("workspace", "package", "versions", "project", "version", "tfm", "is_direct")


"""Nodes and edges in the fixed envelope, written from the columns of what a scanner found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.attributes import quoted
from loomgraph.functions.ids import node_id
from loomgraph.schema import REFS_DDL


def text(value: Column) -> Column:
    """JSON text of a string; null for null."""
    return F.when(value.isNotNull(), quoted(value))


def attributes(**named: Column) -> Column:
    """A map of JSON texts, without the names whose text is null."""
    if not named:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def place(file: Column, *span: Column) -> Column:
    """One reference: a file and its span (start line, start column, end line, end column), or no span."""
    names = ("start_line", "start_col", "end_line", "end_col")
    spans = F.array(F.struct(*[c.cast("int").alias(n) for c, n in zip(span, names, strict=True)])) if span else F.array()
    return F.array(F.struct(file.alias("file"), spans.alias("spans"))).cast(REFS_DDL)


def nodes(df: DataFrame, workspace: str, kind: str, fqn: Column, version: Column, display: Column, named: Column, refs: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(workspace).alias("workspace"),
        node_id(kind, fqn, version).alias("id"),
        F.lit(kind).alias("kind"),
        fqn.alias("fqn"),
        version.alias("version"),
        display.alias("display_name"),
        named.alias("attributes"),
        (F.lit(None) if refs is None else refs).cast(REFS_DDL).alias("source_refs"),
    )


def edges(df: DataFrame, workspace: str, source: Column, target: Column, kind: Column | str, named: Column | None = None, refs: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(workspace).alias("workspace"),
        source.alias("from_id"),
        target.alias("to_id"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        (attributes() if named is None else named).alias("attributes"),
        (F.lit(None) if refs is None else refs).cast(REFS_DDL).alias("source_refs"),
    )


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

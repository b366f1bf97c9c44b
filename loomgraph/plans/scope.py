"""Which workspaces a question is about (Q8), and its checked arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import NODE_KINDS, WHITE


def resolve(known: DataFrame, wanted: Sequence[str] | None) -> list[str] | None:
    """The registered names for the wanted ones, compared in any case; None for all. known: a registry with a column workspace."""
    if not wanted or any(w.strip().lower() == "all" for w in wanted):
        return None
    upper = sorted({w.strip().upper() for w in wanted})
    found = {r["w"].upper(): r["w"] for r in known.where(F.upper("workspace").isin(upper)).select(F.col("workspace").alias("w")).distinct().collect()}  # those asked for
    missing = [w for w in upper if w not in found]
    if missing:
        raise ValueError(f"unknown workspaces: {', '.join(missing)}")
    return [found[w] for w in upper]


def within(workspaces: Sequence[str] | None) -> Column:
    """Whether a row's workspace is one of the resolved ones."""
    return F.lit(True) if workspaces is None else F.upper("workspace").isin([w.upper() for w in workspaces])


def required(value: str | None, name: str) -> str:
    if value is None or not value.strip(WHITE):
        raise ValueError(f"{name} is required")
    return value.strip(WHITE)


def kind_named(value: str) -> str:
    for kind in NODE_KINDS:
        if kind.lower() == value.strip().lower():
            return kind
    raise ValueError(f"no such kind: {value}")


def ping() -> str:
    return "pong"

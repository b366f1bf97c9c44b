"""Typed access to attributes kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.schema import WHITE


def text(attributes: Column, key: str) -> Column:
    """A string attribute; null if it is missing or not a string."""
    raw = F.try_element_at(attributes, F.lit(key))
    # a text without escapes, the usual case, is what stands between its quotes
    return F.when(raw.rlike(r'\A"[^"\\\x00-\x1f]*"\z'), F.substr(raw, F.lit(2), F.length(raw) - 2)).when(raw.startswith('"'), F.get_json_object(raw, "$"))


def flag(attributes: Column, key: str) -> Column:
    """A boolean attribute, false by default."""
    return F.coalesce(F.try_element_at(attributes, F.lit(key)) == "true", F.lit(False))


def texts(attributes: Column, key: str) -> Column:
    """The strings of an array attribute, blank ones dropped, sorted; empty if it is missing."""
    items = F.from_json(F.try_element_at(attributes, F.lit(key)), "array<string>")
    return F.coalesce(F.array_sort(F.filter(items, lambda x: F.trim(x, F.lit(WHITE)) != "")), F.array().cast("array<string>"))


def optional(value: Column) -> Column:
    """Trimmed; null if blank."""
    return F.nullif(F.trim(value, F.lit(WHITE)), F.lit(""))


def quoted(value: Column) -> Column:
    """JSON text of a string."""
    return F.substring(F.to_json(F.array(value)), 2, F.lit(1 << 30)).substr(F.lit(1), F.length(F.to_json(F.array(value))) - 2)


def canonical_key(attributes: Column) -> Column:
    """The attributes as sorted ``name=json`` pairs, joined: equal texts for equal maps, which cannot be compared themselves."""
    pairs = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(pairs, "|"), F.lit(""))


def ordered(attributes: Column) -> Column:
    """The attributes with their names in order."""
    return F.map_from_entries(F.array_sort(F.map_entries(attributes)))

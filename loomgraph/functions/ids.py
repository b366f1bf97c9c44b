"""Node identifiers: ``Kind:fqn@version`` with both segments escaped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.schema import NODE_KINDS, WHITE

_ID = r"\A([A-Za-z]+):([A-Za-z0-9._+~-]+)@([A-Za-z0-9._+~-]+)\z"


def _unit(code: Column) -> Column:
    return F.concat(F.lit("~"), F.lpad(F.hex(code), 4, "0"))


def escape(segment: Column) -> Column:
    """Trims, keeps [A-Za-z0-9._+-] and writes every other UTF-16 code unit as ~ and four hex digits. Null for a blank segment."""

    def unit(c: Column) -> Column:
        code = F.ascii(c)
        above = code - F.lit(0x10000)
        pair = F.concat(_unit(F.lit(0xD800) + F.shiftright(above, 10)), _unit(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))))
        return F.when(code > 0xFFFF, pair).otherwise(_unit(code))

    def whole(text: Column) -> Column:
        # each different character once, the ~ of the escapes first
        others = F.array_distinct(F.regexp_extract_all(text, F.lit("([^A-Za-z0-9._+~-])"), F.lit(1)))
        escaped = F.aggregate(others, F.replace(text, F.lit("~"), F.lit("~007E")), lambda t, c: F.replace(t, c, unit(c)))
        return F.when(text != "", escaped)

    # text made of safe characters alone, the usual case, skips that; the rest is named once, as it would stand in a plan many times over
    return F.when(segment.rlike(r"\A[A-Za-z0-9._+-]+\z"), segment).otherwise(F.get(F.transform(F.array(F.trim(segment, F.lit(WHITE))), whole), F.lit(0)))


def node_id(kind: Column | str, fqn: Column, version: Column) -> Column:
    """The identifier of a node from unescaped segments."""
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), escape(fqn), F.lit("@"), escape(version))


def parse(node: Column) -> Column:
    """struct<kind, fqn, version> of an identifier, escaped as they stand; null if it is malformed or of no known kind."""
    kind = F.regexp_extract(node, _ID, 1)
    ok = node.rlike(_ID) & kind.isin(*NODE_KINDS)
    return F.when(ok, F.struct(kind.alias("kind"), F.regexp_extract(node, _ID, 2).alias("fqn"), F.regexp_extract(node, _ID, 3).alias("version")))


def package_identity(name_version: Column) -> Column:
    """struct<name, version> of ``name/version``, split at the last slash."""
    return F.struct(F.regexp_extract(name_version, "^(.+)/([^/]+)$", 1).alias("name"), F.regexp_extract(name_version, "^(.+)/([^/]+)$", 2).alias("version"))


def project_version(relative_path: Column) -> Column:
    """The version token of user code."""
    return F.concat(F.lit("project-"), F.regexp_replace(relative_path, r"(?i)\.csproj$", ""))


def workspace_name(root: Column) -> Column:
    """The last segment of a root path, or the path itself."""
    last = F.element_at(F.split(F.regexp_replace(root, r"[/\\]+$", ""), r"[/\\]"), -1)
    return F.coalesce(F.nullif(last, F.lit("")), root)


def file_name(text: Column) -> Column:
    """Characters that file names should not have become underscores."""
    return F.regexp_replace(text, "[^a-zA-Z0-9._-]", "_")


def short_hash(text: Column) -> Column:
    """First eight hex digits of SHA-256."""
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(8))


def file_key_hash(text: Column) -> Column:
    """First four bytes of SHA-256 read as a little-endian number, in hex."""
    h = F.sha2(text.cast("binary"), 256)
    return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))

"""Paths of source files, and labels for places in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.schema import WHITE


def _resolved(path: Column) -> Column:
    """Empty and ``.`` segments gone, ``..`` taken back; of an absolute path."""
    step = lambda done, s: F.when(s.isin("", "."), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def _rooted(path: Column) -> Column:
    return path.startswith("/")


def relative(root: Column, file: Column) -> Column:
    """A file as it is shown: with forward slashes; an absolute one that lies below root (in any case) relative to root. Null for a blank one."""
    plain = F.replace(F.trim(file, F.lit(WHITE)), F.lit("\\"), F.lit("/"))
    top, full = _resolved(root), _resolved(file)
    below = F.lower(full).startswith(F.lower(F.concat(F.regexp_replace(top, "/+$", ""), F.lit("/"))))
    inner = F.substr(full, F.length(F.regexp_replace(top, "/+$", "")) + 2)
    return F.when(F.trim(F.coalesce(file, F.lit("")), F.lit(WHITE)) == "", F.lit(None).cast("string")).when(~_rooted(file), plain).when(below, inner).otherwise(plain)


def absolute(root: Column, file: Column) -> Column:
    """Where a file lies: itself if it is absolute, else below root. Null for a blank one."""
    whole = F.when(_rooted(file), file).otherwise(F.concat(root, F.lit("/"), file))
    return F.when(F.trim(F.coalesce(file, F.lit("")), F.lit(WHITE)) != "", _resolved(whole))


def label(file: Column, line: Column, col: Column) -> Column:
    """``file:line:col``, or the file alone where there is no span; null without a file."""
    return F.when(file.isNotNull() & line.isNotNull(), F.concat_ws(":", file, line.cast("string"), col.cast("string"))).otherwise(file)

"""Postman collections: requests in a tree of folders.

The tree is opened level by level, one explode each, over JSON text: each level is a plan of its own size, and a collection
deeper than max_depth is an error rather than cut short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import short_hash
from loomgraph.functions.routes import double_braces, strip_host
from loomgraph.sources import emit


def scan(files: DataFrame, max_depth: int = 8) -> DataFrame:
    """(file, collection, folder, name, method, url_template) of every request in (file, text)."""
    item = "array<string>"
    at = lambda c, p: F.get_json_object(c, p)
    root = files.select(
        "file",
        F.coalesce(at("text", "$.info.name"), F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")).alias("collection"),
        F.from_json(at("text", "$.variable"), "array<struct<key:string,value:string>>").alias("variables"),
        F.lit("").alias("folder"),
        F.from_json(at("text", "$.item"), item).alias("items"),
    )
    found, level = None, root
    for _ in range(max_depth):
        rows = level.select("file", "collection", "variables", "folder", F.explode("items").alias("i")).withColumn("name", at("i", "$.name"))
        here = rows.where(at("i", "$.request").isNotNull() & at("i", "$.item").isNull())
        found = here if found is None else found.unionByName(here)
        level = rows.where(at("i", "$.item").isNotNull()).select(
            "file", "collection", "variables", F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name")).alias("folder"), F.from_json(at("i", "$.item"), item).alias("items")
        )
    deeper = level.select(F.assert_true(F.size("items") <= 0, F.lit(f"a collection is deeper than {max_depth} folders")).alias("x")).where("x is not null")
    raw = at("i", "$.request.url")
    path = F.concat(F.lit("/"), F.array_join(F.filter(F.from_json(at("i", "$.request.url.path"), item), lambda x: x != ""), "/"))
    url = F.when(raw.startswith("{") & ~raw.startswith("{{"), F.coalesce(F.nullif(at("i", "$.request.url.raw"), F.lit("")), path)).otherwise(raw)
    found = found.where(F.trim(url) != "")  # a request without a url is none
    # known variables first, those that are left become parameters
    filled = F.aggregate(F.coalesce("variables", F.array().cast("array<struct<key:string,value:string>>")), F.coalesce(url, F.lit("")), lambda u, v: F.replace(u, F.concat(F.lit("{{"), v["key"], F.lit("}}")), F.coalesce(v["value"], F.lit(""))))
    out = found.select("file", "collection", "folder", "name", F.upper(F.coalesce(at("i", "$.request.method"), F.lit("GET"))).alias("method"), strip_host(double_braces(filled)).alias("url_template"))
    return out.unionByName(deeper.select(*[F.lit(None).cast("string").alias(c) for c in out.columns]))


def nodes(files: DataFrame, workspace: str = "main") -> DataFrame:
    """HttpCallSite nodes of the requests of collections (file, text)."""
    hashed, method, url = short_hash(F.col("file")), F.col("method"), F.col("url_template")
    fqn = F.concat(F.concat_ws(".", F.lit("Postman"), method, url, hashed), F.lit("."), F.coalesce("name", F.lit("")))
    filled = lambda c: emit.text(F.nullif(F.col(c), F.lit("")))
    named = emit.attributes(httpMethod=emit.text(method), urlTemplate=emit.text(url), confidence=F.lit('"high"'), collectionName=emit.text(F.col("collection")), scanner=F.lit('"postman"'), requestName=filled("name"), folderPath=filled("folder"))
    return emit.nodes(scan(files), workspace, "HttpCallSite", fqn, hashed, F.concat_ws(" ", method, url), named, emit.place(F.col("file")))

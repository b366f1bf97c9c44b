"""OpenAPI documents: an endpoint for each path and verb."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import attributes as attr
from loomgraph.functions.ids import node_id
from loomgraph.sources import emit

VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def scan(files: DataFrame) -> DataFrame:
    """(file, method, path, operation_id, summary, tags, schema_refs) of (file, text); a text that is no OpenAPI document gives nothing.
    JSON is opened by expressions; YAML is turned to JSON first, if a YAML reader is installed."""

    @F.pandas_udf("string")
    def as_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            import yaml
        except ImportError:
            yaml = None

        def one(t: str) -> str | None:
            try:
                return json.dumps(yaml.safe_load(t), default=str) if yaml and t else None
            except yaml.YAMLError:
                return None

        for s in texts:
            yield s.map(one)

    plain = F.trim("text").startswith("{")
    docs = files.where(plain).select("file", "text").unionByName(files.where(~plain).select("file", as_json("text").alias("text"))).where("text is not null")
    docs = docs.where(F.get_json_object("text", "$.openapi").isNotNull() | F.get_json_object("text", "$.swagger").isNotNull())
    paths = docs.select("file", F.explode(F.from_json(F.get_json_object("text", "$.paths"), "map<string,string>")).alias("path", "operations"))
    ops = paths.select("file", "path", F.explode(F.from_json("operations", "map<string,string>")).alias("verb", "op")).where(F.lower("verb").isin(*VERBS))
    bodies = F.concat_ws("\n", F.get_json_object("op", "$.requestBody"), F.get_json_object("op", "$.responses"))  # what parameters refer to does not count
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all(bodies, F.lit(r'"\$ref"\s*:\s*"#/(?:components/schemas|definitions)/([^"]+)"'), F.lit(1))))
    return ops.select(
        "file",
        F.upper("verb").alias("method"),
        "path",
        F.get_json_object("op", "$.operationId").alias("operation_id"),
        F.get_json_object("op", "$.summary").alias("summary"),
        F.array_join(F.array_sort(F.from_json(F.get_json_object("op", "$.tags"), "array<string>")), ",").alias("tags"),
        F.array_join(refs, ",").alias("schema_refs"),
    )


def graph(files: DataFrame, workspace: str = "main") -> tuple[DataFrame, DataFrame]:
    """An HttpEndpoint for each operation of specifications (file, text), the ExternalRef of where it is described, and the DescribedBy edge between them."""
    ops = scan(files)
    route = F.concat_ws(" ", "method", "path")
    named = emit.attributes(
        httpMethod=emit.text(F.col("method")), routeTemplate=emit.text(F.col("path")), source=F.lit('"openapi"'), operationId=emit.text(attr.optional(F.col("operation_id"))),
        tags=F.when(F.col("tags") != "", F.to_json(F.split("tags", ","))), schemaRefs=F.when(F.col("schema_refs") != "", F.to_json(F.split("schema_refs", ","))), summary=emit.text(attr.optional(F.col("summary"))),
    )
    one = F.lit("openapi")
    where = F.concat_ws(" ", "path", "method")
    described = F.concat(F.col("file"), F.lit("#"), where)
    ends = emit.nodes(ops, workspace, "HttpEndpoint", route, one, route, named, emit.place(F.col("file")))
    outside = emit.nodes(ops, workspace, "ExternalRef", described, one, described, emit.attributes(specFile=emit.text(F.col("file")), operationPath=emit.text(where)))
    return emit.union(ends, outside), emit.edges(ops, workspace, node_id("HttpEndpoint", route, one), node_id("ExternalRef", described, one), "DescribedBy")

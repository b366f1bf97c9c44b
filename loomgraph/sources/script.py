"""HTTP calls in JavaScript and TypeScript, line by line, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import short_hash
from loomgraph.functions.routes import fetch_method, literal_at, url_template
from loomgraph.sources import emit

# The client methods that count as calls.
AXIOS_VERBS = ("get", "post", "put", "delete", "patch")


def lines(files: DataFrame) -> DataFrame:
    """(file, line_no, text) of (file, text), lines from 1."""
    return files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("i", "text")).select("file", (F.col("i") + 1).alias("line_no"), "text")


def _calls(line: Column) -> Column:
    """array<struct<method, url, confidence>> of one line: what stands behind each ``fetch(`` and each ``axios.`` (in any case) with a verb. Fetches on a line
    share its method option; a text in quotes is sure, one in backticks has its expressions replaced."""
    option = fetch_method(line)

    def call(method: Column, rest: Column) -> Column:
        found = literal_at(rest)
        url = F.when(found["template"], url_template(found["url"])).otherwise(found["url"])
        return F.when(found.isNotNull() & method.isNotNull(), F.struct(method.alias("method"), url.alias("url"), F.when(found["template"], "medium").otherwise("high").alias("confidence")))

    def client(piece: Column) -> Column:
        name = F.substring_index(piece, "(", 1)
        return call(F.when(F.lower(name).isin(*AXIOS_VERBS) & piece.contains("("), F.upper(name)), F.substr(piece, F.length(name) + 2))

    behind = lambda mark: F.slice(F.split(line, mark), 2, 1 << 20)
    found = F.concat(F.transform(behind(r"fetch\("), lambda x: call(option, x)), F.transform(behind(r"(?i)axios\."), client))
    return F.filter(found, lambda c: c.isNotNull())


def scan(files: DataFrame) -> DataFrame:
    """(file, line_no, method, url_template, confidence) of every call in (file, text)."""
    rows = lines(files).where(F.col("text").contains("fetch(") | F.lower("text").contains("axios."))
    return rows.select("file", "line_no", F.explode(_calls(F.col("text"))).alias("c")).select("file", "line_no", "c.method", F.col("c.url").alias("url_template"), "c.confidence")


def nodes(calls: DataFrame, workspace: str = "main") -> DataFrame:
    """HttpCallSite nodes of scanned calls."""
    hashed, line = short_hash(F.col("file")), F.col("line_no")
    fqn = F.concat_ws(".", F.lit("JS"), "method", "url_template", hashed, line.cast("string"))
    named = emit.attributes(
        httpMethod=emit.text(F.col("method")), urlTemplate=emit.text(F.col("url_template")), confidence=emit.text(F.col("confidence")), sourceFile=emit.text(F.col("file")), sourceLine=line.cast("string"), scanner=F.lit('"regex"')
    )
    return emit.nodes(calls, workspace, "HttpCallSite", fqn, hashed, F.concat_ws(" ", "method", "url_template"), named, emit.place(F.col("file"), line, F.lit(0), line, F.lit(0)))

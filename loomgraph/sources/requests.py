"""Request files (.http, .rest): blocks between ``###`` lines, each with one request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ids import short_hash
from loomgraph.functions.routes import double_braces
from loomgraph.schema import WHITE
from loomgraph.sources import emit

# The words that a request line begins with.
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT", "TRACE")


def blocks(lines: DataFrame, separator: str = "^###") -> DataFrame:
    """lines (file, line_no, text) with block: how many separators came up to the line."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(F.col("text").rlike(separator).cast("int")).over(w))


def scan(lines: DataFrame) -> DataFrame:
    """(file, block, line_no, method, url_template, name, headers) of the blocks that have a request: their first line that is neither blank nor a comment must be one.

    The name is the text behind the separator, else the word behind ``# @name``. Headers are the lines behind the request up to a blank line or one
    without a colon; of equal names in any case the first gives the name and the last the value. Variables become parameters."""
    t = F.trim(F.col("text"), F.lit(WHITE))
    separator = F.col("text").startswith("###")
    comment = t.startswith("#") | t.startswith("//")
    words = F.filter(F.split(t, " "), lambda w: w != "")
    verb = F.upper(F.get(F.split(t, r"\s"), F.lit(0)))
    mark = F.when(F.lower(t).rlike(r"^#\s*@name\s"), F.regexp_extract(t, r"(?i)@name\s+(\S+)", 1))
    key = ["file", "block"]
    rows = blocks(lines).select(
        *key, "line_no", t.alias("t"), comment.alias("comment"), F.when(separator, F.nullif(F.trim(F.substr(t, F.lit(4)), F.lit(WHITE)), F.lit(""))).alias("title"), F.nullif(mark, F.lit("")).alias("mark"),
        (verb.isin(*METHODS) & t.rlike(r"^\S+\s")).alias("is_request"), F.get(words, F.lit(0)).alias("word"), F.get(words, F.lit(1)).alias("url"),
    )
    at = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("line_no", c)))[c].alias(c)  # noqa: E731  the first that there is
    plain = F.when(~F.col("comment") & (F.col("t") != ""), F.struct("line_no", "is_request", "word", "url"))
    head = rows.groupBy(*key).agg(F.min(plain).alias("r"), at("title"), at("mark")).where("r.is_request and r.url is not null")
    head = head.select(*key, F.col("r.line_no").alias("at"), F.upper("r.word").alias("method"), double_braces(F.col("r.url")).alias("url_template"), F.coalesce("title", "mark").alias("name"))
    colon = F.instr("t", ":")
    behind = rows.where(~F.col("comment")).join(head.select(*key, "at"), key).where("line_no > at").withColumn("colon", colon)
    stop = behind.where("colon <= 1").groupBy(*key).agg(F.min("line_no").alias("stop"))
    pairs = behind.join(stop, key, "left").where("(stop is null or line_no < stop) and colon > 1")
    named = pairs.select(*key, "line_no", F.trim(F.substr("t", F.lit(1), F.col("colon") - 1), F.lit(WHITE)).alias("k"), F.trim(F.substr("t", F.col("colon") + 1), F.lit(WHITE)).alias("v"))
    last = named.groupBy(*key, F.lower("k").alias("low")).agg(F.min_by("k", "line_no").alias("k"), F.max_by("v", "line_no").alias("v"))
    headers = last.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("headers"))  # of one request
    return head.join(headers, key, "left").select(*key, F.col("at").alias("line_no"), "method", "url_template", "name", "headers")


def nodes(files: DataFrame, workspace: str = "main") -> DataFrame:
    """HttpCallSite nodes of request files (file, text); blocks count from 0, a separator in the first line opens the first one."""
    from loomgraph.sources.script import lines

    opened = files.select("file", F.col("text").startswith("###").cast("long").alias("opened"))
    found = scan(lines(files)).join(opened, "file")
    hashed, line, method, url = short_hash(F.col("file")), F.col("line_no"), F.col("method"), F.col("url_template")
    fqn = F.concat_ws(".", F.lit("HTTP"), method, url, hashed, (F.col("block") - F.col("opened")).cast("string"))
    shown = F.concat(F.concat_ws(" ", method, url), F.coalesce(F.concat(F.lit(" ("), F.col("name"), F.lit(")")), F.lit("")))
    named = emit.attributes(
        httpMethod=emit.text(method), urlTemplate=emit.text(url), confidence=F.lit('"high"'), sourceFile=emit.text(F.col("file")), sourceLine=line.cast("string"), scanner=F.lit('"http-file"'), requestName=emit.text(F.col("name")),
        headers=F.when(F.size("headers") > 0, F.to_json("headers")),
    )
    return emit.nodes(found, workspace, "HttpCallSite", fqn, hashed, shown, named, emit.place(F.col("file"), line, F.lit(0), line, F.lit(0)))

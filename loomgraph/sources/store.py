"""Storing graphs: Parquet by kind, and JSON shards for exchange."""

from __future__ import annotations

import html
import json
import posixpath
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.schema import EDGE_DDL, EDGE_KINDS, NODE_DDL, NODE_KINDS

SCHEMA_VERSION = "1"


def inside(root: str, relative: str) -> str:
    """The path of relative below root; an error if it leads out of it."""
    root = root.rstrip("/")
    path = posixpath.normpath(f"{root}/{relative}") if "://" not in root else root.split("://", 1)[0] + "://" + posixpath.normpath(root.split("://", 1)[1] + "/" + relative)
    if not path.startswith(root + "/"):
        raise ValueError(f"{relative} leads out of {root}")
    return path


#: Rows of a file of a stored graph, about.
FILE_ROWS = 500_000


def _by_kind(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df in as many partitions for each kind as its rows ask for, however unequal the kinds are, each in order."""
    sizes = df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", F.ceil(F.col("n") / FILE_ROWS).cast("int").alias("parts"))
    sizes = [(r["kind"], r["parts"]) for r in sizes.collect()]  # a row for each kind of the fixed list
    total = max(1, sum(n for _, n in sizes))
    parts = F.create_map(*[F.lit(x) for pair in sizes for x in pair])[F.col("kind")] if sizes else F.lit(1)
    return df.withColumn("__part", F.pmod(F.xxhash64(key), parts)).repartition(total, "kind", "__part").sortWithinPartitions("kind", *order).drop("__part")


def save(graph: PropertyGraph, root: str, version: str, hashes: DataFrame | None = None) -> None:
    """Writes nodes and edges by kind into a folder of its own version, then points to it: readers see the old graph or the new one. hashes: key, sha256 of the files that
    it was built from."""
    spark = graph.nodes.sparkSession
    _by_kind(graph.nodes, "id", "id").write.mode("overwrite").partitionBy("kind").parquet(inside(root, f"{version}/nodes"))
    _by_kind(graph.edges, "from_id", "from_id", "to_id").write.mode("overwrite").partitionBy("kind").parquet(inside(root, f"{version}/edges"))
    if hashes is not None:
        hashes.select("key", "sha256").write.mode("overwrite").parquet(inside(root, f"{version}/hashes"))
    now = spark.sql("select current_timestamp() as last_build")
    now.select(F.lit(version).alias("version"), F.lit(SCHEMA_VERSION).alias("schema_version"), "last_build").coalesce(1).write.mode("overwrite").json(inside(root, "current"))


_MANIFEST = "version string, schema_version string, last_build timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(version, schema_version, last_build) of the current graph; where there is none yet, no version and the beginning of time."""
    if _exists(spark, inside(root, "current")):
        return spark.read.schema(_MANIFEST).json(inside(root, "current"))
    return spark.sql(f"select cast(null as string) as version, '{SCHEMA_VERSION}' as schema_version, timestamp_seconds(0) as last_build")


def load(spark: SparkSession, root: str, version: str | None = None) -> PropertyGraph:
    """The graph that root points to, or one of its versions; an empty one where none was saved. Filters on kind read that kind's folders only."""
    version = version or manifest(spark, root).first()["version"]
    if version is None:
        return PropertyGraph(spark.createDataFrame([], NODE_DDL), spark.createDataFrame([], EDGE_DDL))
    read = lambda part, ddl: spark.read.schema(ddl).parquet(inside(root, f"{version}/{part}"))
    return PropertyGraph(read("nodes", NODE_DDL), read("edges", EDGE_DDL))


def load_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(key, sha256) of the files that the current graph was built from; none where it does not say."""
    version = manifest(spark, root).first()["version"]
    path = inside(root, f"{version}/hashes")
    schema = "key string, sha256 string"
    return spark.read.schema(schema).parquet(path) if version is not None and _exists(spark, path) else spark.createDataFrame([], schema)


# -- fragments of providers and packages (S21, S22, K2, K3, U6) -----------------------------------------------------------------------------


def ordered(df: DataFrame, provider: int) -> DataFrame:
    """df with the order in which it counts when fragments are merged."""
    key = ("id",) if "id" in df.columns else ("from_id", "to_id")
    return df.withColumn("provider_ord", F.lit(provider)).withColumn("seq", F.xxhash64(*key))


def save_fragment(cache: str, provider: str, order: int, nodes: DataFrame, edges: DataFrame) -> None:
    """Keeps what a provider found, in place of what it found before."""
    for part, df in (("nodes", nodes), ("edges", edges)):
        ordered(df, order).write.mode("overwrite").parquet(inside(cache, f"providers/{file_safe(provider)}/{part}"))


def has_fragments(spark: SparkSession, cache: str, providers: Sequence[str]) -> bool:
    """Whether every provider has a whole fragment; one that is missing counts as all."""
    return all(_exists(spark, inside(cache, f"providers/{file_safe(p)}/{part}/_SUCCESS")) for p in providers for part in ("nodes", "edges"))


def load_fragments(spark: SparkSession, cache: str, providers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of all providers, with the order in which they count."""
    read = lambda part, ddl: spark.read.schema(f"{ddl}, provider_ord int, seq long").parquet(*[inside(cache, f"providers/{file_safe(p)}/{part}") for p in providers])
    return read("nodes", NODE_DDL), read("edges", EDGE_DDL)


def file_safe(name: str) -> str:
    """A name with an underscore for each character that file names should not have."""
    return re.sub(r"[^a-zA-Z0-9._-]", "_", name)


class PackageCache:
    """Symbols of packages (symbols.SYMBOLS_DDL) by name and version: read once, then asked for."""

    def __init__(self, spark: SparkSession, cache: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, inside(cache, "packages"), schema

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if _exists(self.spark, self.path) else self.spark.createDataFrame([], self.schema)

    def get(self, wanted: DataFrame) -> DataFrame:
        """The symbols of the wanted packages (package, version) that are kept."""
        return self.rows().join(wanted.select("package", "version").distinct(), ["package", "version"], "left_semi").select(*[c.split()[0] for c in self.schema.split(", ")])

    def misses(self, wanted: DataFrame) -> DataFrame:
        return cache_misses(wanted, self.rows())

    def add(self, found: DataFrame) -> None:
        """Keeps the symbols of packages that were missing."""
        found.write.mode("append").parquet(self.path)


_REF_JSON = "array<struct<file:string,spans:array<struct<startLine:int,startColumn:int,endLine:int,endColumn:int>>>>"


def _refs_in(column):
    return F.transform(column, lambda r: F.struct(r["file"].alias("file"), F.array_sort(F.transform(r["spans"], lambda s: F.struct(s["startLine"].alias("start_line"), s["startColumn"].alias("start_col"), s["endLine"].alias("end_line"), s["endColumn"].alias("end_col")))).alias("spans")))


def _refs_out(column):
    return F.transform(column, lambda r: F.struct(r["file"].alias("file"), F.transform(r["spans"], lambda s: F.struct(s["start_line"].alias("startLine"), s["start_col"].alias("startColumn"), s["end_line"].alias("endLine"), s["end_col"].alias("endColumn"))).alias("spans")))


_GAP, _COLON = re.compile(r"[\s,]*"), re.compile(r"\s*:\s*")


def raw_members(text: str) -> dict[str, str]:
    """The members of a JSON object, each value as the text it has there: a number keeps its digits."""
    decoder, out, i = json.JSONDecoder(), {}, text.index("{") + 1
    while text[i := _GAP.match(text, i).end()] != "}":
        key, i = decoder.raw_decode(text, i)
        i = _COLON.match(text, i).end()
        _, end = decoder.raw_decode(text, i)
        out[key] = text[i:end]
        i = end
    return out


def raw_items(text: str) -> list[str]:
    """The items of a JSON array, as they stand."""
    decoder, out, i = json.JSONDecoder(), [], text.index("[") + 1
    while text[i := _GAP.match(text, i).end()] != "]":
        _, end = decoder.raw_decode(text, i)
        out.append(text[i:end])
        i = end
    return out


_SHARD = "id string, source string, target string, kind string, display_name string, attributes map<string,string>, refs string"


def _shard(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The rows of all shard files of a part; unknown members are passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                rows = []
                for item in raw_items(raw_members(text).get(part, "[]")):
                    m = raw_members(item)
                    plain = [json.loads(m.get(k, "null")) for k in ("id", "from", "to", "kind", "displayName")]
                    rows.append((*plain, raw_members(m.get("attributes", "{}")), m.get("sourceRefs", "[]")))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SHARD.replace("map<string,string>", "map").split(", ")])

    return spark.read.text(f"{path}/{part}/*.json", wholetext=True).mapInPandas(run, _SHARD)


def read_shards(spark: SparkSession, path: str, workspace: str = "main") -> PropertyGraph:
    """A graph from JSON shards: ``nodes/*.json`` with a list ``nodes``, ``edges/*.json`` with a list ``edges``. Attribute values keep their JSON text."""
    refs = _refs_in(F.coalesce(F.from_json("refs", _REF_JSON), F.array().cast(_REF_JSON)))
    n, e = _shard(spark, path, "nodes"), _shard(spark, path, "edges")
    w = F.lit(workspace).alias("workspace")
    nodes = n.select(w, "id", "kind", F.regexp_extract("id", "^[^:]*:(.*)@[^@]*$", 1).alias("fqn"), F.regexp_extract("id", "@([^@]*)$", 1).alias("version"), "display_name", "attributes", refs.alias("source_refs"))
    edges = e.select(w, F.col("source").alias("from_id"), F.col("target").alias("to_id"), "kind", "attributes", refs.alias("source_refs"))
    return PropertyGraph(nodes, edges)


def shard_rows(df: DataFrame, part: str) -> DataFrame:
    """(kind, sort keys, json): each node or edge as one line of JSON with its keys in order."""
    attributes = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    refs = F.to_json(_refs_out(F.coalesce("source_refs", F.array().cast(dict(df.dtypes)["source_refs"]))))
    text = lambda c: F.get_json_object(F.to_json(F.struct(F.struct(F.col(c)).alias("x"))), "$.x")
    inner = lambda c: F.regexp_extract(text(c), r"^\{\"[^\"]*\":(.*)\}$", 1)
    if part == "nodes":
        body = F.concat(F.lit('{"attributes":'), attributes, F.lit(',"displayName":'), inner("display_name"), F.lit(',"id":'), inner("id"), F.lit(',"kind":'), inner("kind"), F.lit(',"sourceRefs":'), refs, F.lit("}"))
        return df.select("kind", F.col("id").alias("a"), F.lit("").alias("b"), body.alias("json"))
    body = F.concat(F.lit('{"attributes":'), attributes, F.lit(',"from":'), inner("from_id"), F.lit(',"kind":'), inner("kind"), F.lit(',"sourceRefs":'), refs, F.lit(',"to":'), inner("to_id"), F.lit("}"))
    return df.select("kind", F.col("from_id").alias("a"), F.col("to_id").alias("b"), body.alias("json"))


#: Rows that an export through the driver takes at most; a larger graph stays in Parquet.
EXPORT_ROWS = 5_000_000


def _small_enough(graph: PropertyGraph, most: int) -> None:
    n = graph.nodes.count() + graph.edges.count()
    if n > most:
        raise ValueError(f"{n} nodes and edges are too many for an export through the driver (at most {most})")


def write_shards(graph: PropertyGraph, folder: str, most: int = EXPORT_ROWS) -> None:
    """A deterministic JSON file for each kind in a local folder, in the order of the rows' identifiers; for exchange, through the driver row by row,
    so only for graphs of ``most`` rows."""
    import os

    _small_enough(graph, most)
    for part, df, kinds in (("nodes", graph.nodes, NODE_KINDS), ("edges", graph.edges, EDGE_KINDS)):
        os.makedirs(f"{folder}/{part}", exist_ok=True)
        for kind in kinds:
            path = inside(folder, f"{part}/{kind.lower()}.json")
            with open(path + ".tmp", "w", encoding="utf-8") as f:
                f.write(f'{{"{part}":[')
                for i, r in enumerate(shard_rows(df.where(F.col("kind") == kind), part).orderBy("a", "b", "json").toLocalIterator()):
                    f.write(("," if i else "") + "\n" + r["json"])
                f.write("\n]}\n")
            os.replace(path + ".tmp", path)


_PAGE = (
    '<!doctype html><meta charset="utf-8"><title>{title}</title><h1>{title}</h1><pre id="out"></pre><script id="graph" type="application/json">',
    '</script>\n<script>const g=JSON.parse(document.getElementById("graph").textContent);document.getElementById("out").textContent=g.nodes.map(n=>n.id).join("\\n")</script>\n',
)


def export_html(graph: PropertyGraph, path: str, title: str = "Property graph", most: int = EXPORT_ROWS // 10) -> None:
    """One HTML page with the whole graph as JSON, written row by row, for graphs of ``most`` rows, which a browser can hold."""
    _small_enough(graph, most)
    with open(path, "w", encoding="utf-8") as f:
        f.write(_PAGE[0].format(title=html.escape(title)))
        for k, (part, df) in enumerate((("edges", graph.edges), ("nodes", graph.nodes))):
            f.write(f'{"," if k else "{"}"{part}":[')
            for i, r in enumerate(shard_rows(df, part).orderBy("a", "b", "json").toLocalIterator()):
                f.write(("," if i else "") + r["json"].replace("</", "<\\/"))
            f.write("]")
        f.write("}" + _PAGE[1])


def json_lines(result: DataFrame) -> Iterator[str]:
    """A result as lines of JSON, in its order: what a command line prints (K7)."""
    for r in result.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        yield r["j"]


def cache_misses(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Packages (package, version) whose fragments are not cached yet."""
    return wanted.select("package", "version").distinct().join(cached.select("package", "version"), ["package", "version"], "left_anti")

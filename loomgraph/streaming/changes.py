"""Debounced change batches and the loop that acts on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.changes import SKIPPED_FOLDERS, classify

GAP = "750 milliseconds"


def tracked(path: Column, graph_dir: str | None = None, also: Sequence[str] = (".sln", ".slnx")) -> Column:
    """Whether a changed path matters: an input or a solution, in no folder that is passed over and not below the graph's own."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    input_file = classify(path).isNotNull() | F.regexp_extract(p, r"\.[^./]*$", 0).isin(*also) | p.contains("/openapi/")
    outside = ~F.concat(F.lit("/"), p).rlike("/(" + "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS) + ")/")
    own = F.lit(False) if graph_dir is None else p.startswith(graph_dir.lower().rstrip("/") + "/")
    return input_file & outside & ~own


def debounce(events: DataFrame, gap: str = GAP, watermark: str | None = None) -> DataFrame:
    """Change batches of (workspace, path, ts): events of a workspace that follow each other within the gap are one batch, with its
    sorted different paths. With a watermark the events are a stream, and a batch comes out once it is over."""
    rows = events.select("workspace", F.col("ts").cast("timestamp").alias("ts"), "path")
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    window = F.session_window("ts", gap)
    if not watermark:
        # different paths first: a burst on one path is summed up before it moves
        rows = rows.groupBy("workspace", "ts", "path").agg(F.count(F.lit(1)).alias("n"))
        return _batches(rows.groupBy("workspace", window.alias("s")).agg(F.sum("n").alias("events"), F.collect_set("path").alias("p")))
    return _batches(rows.groupBy("workspace", window.alias("s")).agg(F.count(F.lit(1)).alias("events"), F.collect_set("path").alias("p")))


def _batches(grouped: DataFrame) -> DataFrame:
    return grouped.select("workspace", F.col("s.start").alias("started"), "events", F.array_join(F.array_sort("p"), "|").alias("paths"))


def run(batches: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str, failed: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """Calls build for each micro-batch of change batches; a build that fails is reported and the loop goes on."""

    def act(df: DataFrame, epoch: int) -> None:
        if df.isEmpty():
            return
        try:
            build(df, epoch)
        except Exception as error:
            if failed is None:
                raise
            failed(epoch, error)

    return batches.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(act).start()

"""Statistics of tool calls: how often, first and last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def summarize(calls: DataFrame) -> DataFrame:
    """(tool, calls, first_called, last_called) of (tool, called_at), batch or stream; calls without a name do not count."""
    return calls.where(F.trim("tool") != "").groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.min("called_at").alias("first_called"), F.max("called_at").alias("last_called"))


def total(statistics: DataFrame) -> DataFrame:
    return statistics.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("total_calls"))


def combine(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored statistics (negative counts read as none) with new ones."""
    both = stored.withColumn("calls", F.greatest(F.lit(0).cast("long"), "calls")).unionByName(new)
    return both.groupBy("tool").agg(F.sum("calls").alias("calls"), F.min("first_called").alias("first_called"), F.max("last_called").alias("last_called"))


def run(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the statistics of a stream of calls in a Parquet folder for each epoch below path; the highest epoch is the current one."""

    def flush(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return summarize(calls).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(flush).start()

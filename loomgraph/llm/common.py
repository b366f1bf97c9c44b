"""What several operators share: reading tables, shared storage, Arrow columns."""

from __future__ import annotations

import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns (default: all) of one of the tables below sf_dir."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where none is set and driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders that staged() has written in this process, in order.
_written: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """A mark for drop_staged()."""
    return len(_written)


def drop_staged(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Removes the folders staged since a mark, but for the last ``keep`` ones. Only for what no DataFrame in use still reads."""
    gone = _written[since : len(_written) - keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _written[since : len(_written) - keep]


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives value in any task. What is broadcast is bytes with the classes in them, so executors need not have this package."""
    holder = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(holder.value)


def fresh_worker() -> None:
    """At the start of a task: gives back what tasks of other stages left in this Python worker, which outlives them."""
    if sys.modules.pop("loomgraph_worker_state", None) is not None:
        import ctypes
        import gc

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library has no such call
            pass


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def result_schema(df: DataFrame, added: str) -> T.StructType:
    """df's columns without those that ``added`` (a DDL string) replaces, then the added ones."""
    new = T.StructType.fromDDL(added)
    return T.StructType([f for f in df.schema.fields if f.name not in new.names] + new.fields)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, empty for null."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive zero-copy parts of batch whose texts hold about most_bytes (always at least one row)."""
    column = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def with_columns(batch: pa.RecordBatch, schema: pa.Schema, **new: pa.Array) -> pa.RecordBatch:
    """batch's columns and the new ones, in the order of schema."""
    return pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(batch.schema.get_field_index(f.name)) for f in schema], names=schema.names)


def text_size(df: DataFrame, text: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of the whole text column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def hash_sample(df: DataFrame, most: int) -> list[Row]:
    """The ``most`` rows of the smallest hash of all their columns (of equal hashes by the columns); all rows where there are no more. A bounded sample for training.
    In a large table a threshold that the row count sets comes first, so that few rows more reach the driver, however many partitions there are;
    where repeated rows leave fewer below it than there should be, all rows are ranked."""
    rank = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31))
    n = df.count()
    near = df if n <= 8 * most else df.where(rank < F.lit(int(4 * most / n * (1 << 31))))
    got = near.orderBy(rank, *df.columns).limit(most).collect()
    if len(got) < min(most, n):
        got = df.orderBy(rank, *df.columns).limit(most).collect()
    return got


#: Copies of the other side's row that rows of a frequent key are spread over, and the least rows that make a key frequent.
SALTS, FREQUENT = 32, 1000


def frequent(counts: DataFrame, key: str, count: str) -> list:
    """The keys of more than FREQUENT rows and of more than a 2000th of all rows: 2000 keys at most. counts: key, and how many rows it has."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(count) > max(FREQUENT, total // 2000)).select(key).collect()]


def join_spread(rows: DataFrame, other: DataFrame, key: str, often: list, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to other by key. Rows of the keys in ``often`` (see frequent()) are spread over SALTS copies of their rows in other, so that
    no key gathers in one task. rows must come from a scan, whose order is fixed."""
    if not often:
        return rows.join(other, key, how)
    hot = F.coalesce(F.col(key).isin(often), F.lit(False))
    left = rows.withColumn("__lg_salt", F.when(hot, (F.monotonically_increasing_id() % SALTS).cast("int")).otherwise(0))
    right = other.withColumn("__lg_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "__lg_salt"], how).drop("__lg_salt")


def hex64(column: Column) -> Column:
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))

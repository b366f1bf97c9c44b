"""Uniform shuffling into shards of exact size through a hypergeometric communication matrix.

Input partitions hold known numbers of rows and shards have known sizes, so how many rows each partition sends to each
shard follows a multivariate hypergeometric law: the matrix is drawn exactly, every partition deals out its rows by a
local permutation, rows are exchanged, and each shard permutes what it received.  The second permutation is cut into
buckets by a hash, each ordered for itself behind the buckets before it, so no task holds a shard.

Shard sizes differ by at most one row (the law ``rows``).  The matrix has a row for each input partition and a column
for each shard; nothing else reaches the driver.

Cases: rows with equal texts, null texts and repeated rows are dealt like any others; with fewer rows than shards some
shards stay empty; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import staged

SHARDS = 40
SEED = 20_240
#: Mean rows in one bucket of the second permutation.
BUCKET_ROWS = 2000


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric number: how many of n rows drawn from good + bad are good; of any size."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n and good + bad else 0
    low, high = max(0, n - bad), min(n, good)
    lg = math.lgamma
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    log_p = lg(good + 1) - lg(mode + 1) - lg(good - mode + 1) + lg(bad + 1) - lg(n - mode + 1) - lg(bad - n + mode + 1) - lg(good + bad + 1) + lg(n + 1) + lg(good + bad - n + 1)
    left = rng.random() - math.exp(log_p)  # inversion, outwards from the most likely number
    up = down = mode
    p_up = p_down = math.exp(log_p)
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], np.int64)


def matrix(counts: list[int], sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows to send from each partition (its number of rows in counts) to each shard; rows add up to counts, columns to sizes."""
    rng = np.random.default_rng(seed)
    left = sizes.astype(np.int64).copy()
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        rest = int(left.sum())
        for s in range(len(sizes)):
            rest -= int(left[s])
            out[p, s] = draw(rng, int(left[s]), rest, n) if rest else n
            n -= out[p, s]
        left -= out[p]
    return out


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (gapless from 0 in each shard): a uniform random order, sizes at most one row apart."""
    spark = docs.sparkSession
    pid, idx, bucket = "__lg_pid", "__lg_idx", "__lg_bucket"
    at = F.monotonically_increasing_id()
    rows = staged(docs.drop("shard", "slot").withColumn(pid, at).withColumn(idx, F.col(pid).bitwiseAND(F.lit((1 << 33) - 1))).withColumn(pid, F.shiftright(pid, 33)), "shuffle")
    counts = {int(r[pid]): int(r["n"]) for r in rows.groupBy(pid).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each input partition
    order = sorted(counts)
    sizes = shard_sizes(sum(counts.values()), shards)
    sent = dict(zip(order, matrix([counts[p] for p in order], sizes, seed), strict=True))
    shipped = spark.sparkContext.broadcast(sent)

    @F.pandas_udf("int")
    def dealt(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, shard = None, np.zeros(0, np.int32)
        for p, i in parts:
            out = np.empty(len(p), np.int32)
            p, i = p.to_numpy(), i.to_numpy()
            for k in np.unique(p).tolist():
                if k != last:  # the local permutation of this partition's rows
                    share = shipped.value[k]
                    shard = np.random.default_rng([seed, k]).permutation(np.repeat(np.arange(len(share), dtype=np.int32), share))
                    last = k
                out[p == k] = shard[i[p == k]]
            yield pd.Series(out)

    buckets = max(1, -(-int(sizes.max()) // BUCKET_ROWS))
    h = lambda k: F.xxhash64(F.col(pid), F.col(idx), F.lit(seed + k))
    sorted_rows = rows.withColumn("shard", dealt(pid, idx)).withColumn(bucket, F.pmod(h(1), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sorted_rows.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias("n")).select("shard", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__lg_base"))
    inner = F.row_number().over(Window.partitionBy("shard", bucket).orderBy(h(2), pid, idx)) - 1
    placed = sorted_rows.withColumn("__lg_inner", inner).join(base, ["shard", bucket])
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*[F.col(f"`{c}`") for c in kept], "shard", (F.col("__lg_base") + F.col("__lg_inner")).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes each shard as a folder of its own, in the order of its slots."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Per-key results without a few keys' tasks running longest.

Multi-level tree aggregation. Each task combines its own chunk of the input
(input splits are of fixed size) into one state per key. States are then
merged in rounds: in each, a key's states of ``fan_in`` neighbouring chunks go
to one place, so no task is ever sent more than ``fan_in`` states of one key,
and a key that holds a third of all rows is spread over as many tasks as it has
groups of chunks. The last round merges what is left of each key, at most
``fan_in`` states. Fan-in is the root of the number of chunks, between 2 and
``FAN_IN``, so there are at least two rounds over more than two chunks.

Defined results: null keys form a group of their own; null values are not
added; a group of null values alone has sum 0; empty input gives no rows. Sums
are decimal(38,0), so they do not overflow. The number of chunks only says how
many rounds there are: a wrong one changes no result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 64


def chunk_count(rows: DataFrame) -> int:
    """About how many input splits a table has, from the sizes of what it reads;
    only plans."""
    spark = rows.sparkSession
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    text = spark.conf.get("spark.sql.files.maxPartitionBytes")
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)
    return max(min(size // split, 1 << 24), spark.sparkContext.defaultParallelism)


def tree_totals(rows: DataFrame, keys: list[str], value: str, fan_in: int | None = None, chunks: int | None = None) -> DataFrame:
    """(keys, n_rows, total): rows and sum of the integer ``value`` per key."""
    chunks = chunk_count(rows) if chunks is None else chunks
    fan_in = min(max(math.isqrt(chunks), 2), FAN_IN) if fan_in is None else fan_in
    state = rows.select(*keys, F.col(value).cast("decimal(19,0)").alias("__v"))
    state = state.withColumn("__chunk", F.floor(F.spark_partition_id() / F.lit(fan_in)).cast("int"))
    # Partial aggregation combines each chunk inside its task, before the shuffle.
    state = state.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("__v"), F.lit(0)).cast("decimal(38,0)").alias("total"))
    merged = [F.sum("n_rows").alias("n_rows"), F.sum("total").cast("decimal(38,0)").alias("total")]
    groups = -(-chunks // fan_in)
    while groups > fan_in:
        groups = -(-groups // fan_in)
        state = state.withColumn("__chunk", F.floor(F.col("__chunk") / fan_in).cast("int")).groupBy(*keys, "__chunk").agg(*merged)
    return state.groupBy(*keys).agg(*merged)


def heavy_keys(totals: DataFrame, n_rows: int, per_cent: int = 1) -> DataFrame:
    """The non-null keys that hold at least ``per_cent`` % of ``n_rows``: at
    most 100 / ``per_cent`` rows."""
    key = totals.columns[0]
    return totals.filter(F.col(key).isNotNull() & (F.col("n_rows") * 100 >= F.lit(n_rows * per_cent)))

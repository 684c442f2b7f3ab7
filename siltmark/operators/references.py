"""References to records that do not exist, or came only after the reference.

The parents' sorted integer keys are compressed into runs of contiguous keys
(start, end, latest time of a parent in the run). Every reference is matched,
as of its key, to the run that starts at or last before it: a key beyond the
run's end, or before every run, is an orphan. A reference written at or after the
run's latest time cannot be early, so only the rest is compared with its own
parent's time, exactly.

Keys are cut into blocks of ``BLOCK`` consecutive integers; runs end at block
borders, so a block is matched alone, by one sort. Hot blocks (see ``skew``) are
spread over as many salts as they have references for tasks, their runs (at
most ``BLOCK`` / 2) and, for the comparison with parents' times, their parents
(at most ``BLOCK``) repeated for each.

References alike in key, ``carry`` columns and period are combined first, in
each task before the shuffle, keeping their earliest time.

Defined results: a null reference refers to nothing and is left out; null keys
of parents are left out; a parent key with several rows exists from the
earliest of its times, null times aside; null times are never late; a null
reference time has a null period; without parents every reference is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.operators.skew import hash_of, hot_keys, salt_lookup, salt_rows
from siltmark.session import cut

BLOCK = 4096


def month(seconds: str):
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM")


def combined(links: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Links alike in keys and month (UTC session) once, at their earliest."""
    return links.groupBy(*keys, month(time).alias("period")).agg(F.min(time).alias("__time"))


def earliest(parents: DataFrame, key: str, time: str) -> DataFrame:
    """(__block, __k, __came): every parent key once, with its earliest time."""
    one = parents.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("__k")).agg(F.min(time).alias("__came"))
    return one.withColumn("__block", F.expr(f"shiftright(__k, {BLOCK.bit_length() - 1})"))


def key_runs(one: DataFrame) -> DataFrame:
    """(__block, start, stop, latest): runs of contiguous keys in each block."""
    run = F.col("__k") - F.row_number().over(Window.partitionBy("__block").orderBy("__k"))
    return one.withColumn("__run", run).groupBy("__block", "__run").agg(
        F.min("__k").alias("start"), F.max("__k").alias("stop"), F.max("__came").alias("latest")).drop("__run")


def broken_references(refs: DataFrame, ref: str, parents: DataFrame, key: str, time: str) -> DataFrame:
    """``refs`` (from ``combined``, best from a written table as it is read
    twice) that are broken, with ``problem`` = ``missing`` or ``late``."""
    names = refs.columns
    refs = refs.filter(F.col(ref).isNotNull()).withColumn("__k", F.col(ref).cast("long"))
    refs = refs.withColumn("__block", F.expr(f"shiftright(__k, {BLOCK.bit_length() - 1})"))
    block = hash_of("__block")
    hot = hot_keys(refs.selectExpr(f"{block} AS k"))
    left = salt_rows(refs, block, hot, hash_of(*names))
    one = cut(earliest(parents, key, time), "parents")
    runs = salt_lookup(key_runs(one), block, hot)
    runs = runs.select("__block", "__salt", F.col("start").alias("__k"), F.struct("start", "stop", "latest").alias("__r"))
    # Runs sort before the references to their own start.
    both = left.unionByName(runs, allowMissingColumns=True).withColumn("__is_ref", F.col("__r").isNull())
    as_of = Window.partitionBy("__block", "__salt").orderBy("__k", "__is_ref").rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumn("__r", F.last("__r", ignorenulls=True).over(as_of)).filter("__is_ref")
    missing = F.col("__r").isNull() | (F.col("__k") > F.col("__r.stop"))
    maybe_late = F.col("__time") < F.col("__r.latest")
    broken = matched.withColumn("__missing", missing).filter(missing | maybe_late)
    came = salt_lookup(one, block, hot).withColumnRenamed("__k", "__ck")
    suspect = ~F.col("__missing") & (F.col("__k") == F.col("__ck"))
    found = broken.alias("b").join(came.alias("c"), (F.col("b.__block") == F.col("c.__block")) & (F.col("b.__salt") == F.col("c.__salt")) & suspect, "left")
    late = F.col("__missing") | (F.col("__time") < F.col("__came"))
    return found.filter(late).select(*[F.col(f"b.`{c}`") for c in names], F.when(F.col("__missing"), "missing").otherwise("late").alias("problem"))

"""Finding and splitting hot keys.

A key is hot if it holds more rows than a task should be given: ``MIN_ROWS``, or
1/``MAX_HOT`` of all rows where that is more, so there are never more than
``MAX_HOT`` hot keys. They are a table of (hash of the key, salts), with as many
salts as the key has rows for tasks; together there are at most 2 ``MAX_HOT``
salts at any size, so the table, 16 bytes a row, may be broadcast. A hash only
says what to split: if two keys share one, one of them is split needlessly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.session import cut

MAX_HOT = 100_000
MIN_ROWS = 20_000


def hot_keys(keys: DataFrame, total: int | None = None, n: str | None = None) -> DataFrame:
    """(__key, __salts) of the hot values among the hashes in the first column
    of ``keys``, written once. A row stands for one, or for as many as its
    column ``n`` says. Counts are combined in each task before the shuffle."""
    name = keys.columns[0]
    counts = keys.groupBy(F.col(name).alias("__key")).agg((F.sum(n) if n else F.count(F.lit(1))).alias("__n"))
    total = keys.count() if total is None else total
    rows = max(MIN_ROWS, total // MAX_HOT)
    return cut(counts.filter(F.col("__n") > rows).select("__key", F.ceil(F.col("__n") / F.lit(rows)).cast("int").alias("__salts")), "hot")


def _with_salts(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    return df.withColumn("__key", F.expr(key)).join(F.broadcast(hot), "__key", "left")  # at most MAX_HOT rows


def flag_hot(df: DataFrame, key: str, hot: DataFrame, name: str) -> DataFrame:
    """Adds whether the row's key is hot. ``key`` is an expression for its hash."""
    return _with_salts(df, key, hot).withColumn(name, F.col("__salts").isNotNull()).drop("__key", "__salts")


def salt_rows(df: DataFrame, key: str, hot: DataFrame, spread: str, name: str = "__salt") -> DataFrame:
    """Rows of hot keys get one of their salts from the expression ``spread``, others 0."""
    salt = F.expr(f"pmod(xxhash64({spread}), coalesce(__salts, 1))").cast("int")
    return _with_salts(df, key, hot).withColumn(name, salt).drop("__key", "__salts")


def salt_lookup(df: DataFrame, key: str, hot: DataFrame, name: str = "__salt") -> DataFrame:
    """The other side of ``salt_rows``: rows of hot keys once for each salt."""
    salts = F.explode(F.expr("sequence(0, coalesce(__salts, 1) - 1)"))
    return _with_salts(df, key, hot).withColumn(name, salts).drop("__key", "__salts")


def hash_of(*columns: str) -> str:
    return f"xxhash64({', '.join(f'`{c}`' for c in columns)})"


def same(left: str, right: str, columns: list[str]) -> Column:
    """The columns of two sides are equal, null to null."""
    return reduce(Column.__and__, [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns])


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str, hot: DataFrame | None = None) -> DataFrame:
    """Join on columns of one name, null equal to null, with hot keys of
    ``left`` spread over salts. ``right`` should have few rows per key; ``how``
    is one of inner, left, left_semi, left_anti. Columns of ``left`` and, unless
    how is semi or anti, the others of ``right``. Rows meet by a hash of the
    key; the key itself is then compared."""
    hot = hot_keys(left.selectExpr(f"{hash_of(*on)} AS k")) if hot is None else hot
    lhs = salt_rows(left, hash_of(*on), hot, hash_of(*left.columns)).withColumn("__k", F.expr(hash_of(*on))).alias("l")
    rhs = salt_lookup(right, hash_of(*on), hot).withColumn("__k", F.expr(hash_of(*on))).alias("r")
    joined = lhs.join(rhs, (F.col("l.__k") == F.col("r.__k")) & (F.col("l.__salt") == F.col("r.__salt")) & same("l", "r", on), how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__k", "__salt")
    return joined.select(*[F.col(f"l.`{c}`") for c in left.columns], *[F.col(f"r.`{c}`") for c in right.columns if c not in on])

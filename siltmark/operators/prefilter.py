"""Leaving out, before a shuffle, what can't match.

The hashes of the wanted keys are bits of a bitmap of ``BITS``, kept as a table
of (number, word of 64 bits) that has no more rows than there are keys, or
``BITS`` / 64. Rows whose bit isn't set are dropped where they are read. Others
may or may not match, so an exact join always follows: the bitmap only saves
shuffling. It saves less where there are more keys than bits, and changes no
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27


def maybe_among(rows: DataFrame, wanted: DataFrame, keys: list[str], wanted_keys: list[str] | None = None) -> DataFrame:
    """Rows whose ``keys`` may be among those of ``wanted``, null equal to null."""
    place = lambda names: f"xxhash64({', '.join(f'`{k}`' for k in names)}) & {BITS - 1}L AS __p"
    bit = "shiftleft(1L, cast(__p & 63L AS int))"
    words = wanted.selectExpr(place(wanted_keys or keys)).groupBy(F.expr("shiftright(__p, 6)").alias("__word")).agg(F.expr(f"bit_or({bit})").alias("__bits"))
    placed = rows.selectExpr("*", place(keys)).withColumn("__word", F.expr("shiftright(__p, 6)"))
    met = placed.join(F.broadcast(words), "__word")  # at most BITS / 64 rows
    return met.where(f"__bits & {bit} <> 0").select(*rows.columns)

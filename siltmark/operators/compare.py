"""Differences between two copies of a table, field by field.

Both sides are cut into buckets by a hash of the key; a pair of buckets is
compared as two Arrow tables: keys are sorted, aligned by sorted search, and
each column is compared under a null-aware mask; only cells that differ are
emitted, with their values as text. The number of buckets follows the number of
rows, and that of tasks the number of buckets, so neither a bucket nor a task
grows with the data.

Rows of one key are reduced to one before that, in each task first, so a row
delivered a billion times costs one row per task and a bucket holds one row per
key.

Defined results: rows whose key is null belong to no record and are left out;
null differs from every value but null; NaN equals NaN; a key whose rows on
one side are not alike is reported as such (``SEVERAL``), and is represented by
the smallest of them by the compared fields in their order, nulls first; empty
tables give one-sided rows or none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_ROWS, BUCKETS_PER_TASK, MOST_TASKS = 4_000, 8, 100_000
#: ``field`` of a key whose rows on one side differ from each other.
SEVERAL = ("several_in_left", "several_in_right")


def _differs(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Mask of the rows in which two aligned columns differ."""
    unequal = pc.not_equal(a, b)
    if pa.types.is_floating(a.type):
        unequal = pc.and_(unequal, pc.invert(pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))))
    one_null = pc.xor(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(unequal, False), one_null).to_numpy(zero_copy_only=False)


def _text(column: pa.ChunkedArray, mask: np.ndarray) -> pa.ChunkedArray:
    return pc.cast(column.filter(pa.array(mask)), pa.string())


def _compare(key: str, fields: list[str], left_only: str, right_only: str):
    def bucket(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.sort_by(key), right.sort_by(key)
        kind = left.schema.field(key).type
        ka, kb = a.column(key).to_numpy(zero_copy_only=False), b.column(key).to_numpy(zero_copy_only=False)
        at = np.searchsorted(kb, ka)
        found = np.zeros(len(ka), bool)
        if len(kb):
            found = kb[np.minimum(at, len(kb) - 1)] == ka
        matched = np.zeros(len(kb), bool)
        matched[at[found]] = True
        cells = []  # (keys, field, left and right values)

        def add(keys: np.ndarray, name: str, old=None, new=None) -> None:
            nothing = pa.chunked_array([pa.nulls(len(keys), pa.string())])
            cells.append((pa.array(keys, type=kind), pa.array([name] * len(keys), pa.string()), nothing if old is None else old, nothing if new is None else new))

        add(ka[~found], left_only)
        add(kb[~matched], right_only)
        for keys, table, name in ((ka, a, SEVERAL[0]), (kb, b, SEVERAL[1])):
            add(keys[table.column("__several").to_numpy(zero_copy_only=False).astype(bool)], name)
        ra, rb, kept = a.filter(pa.array(found)), b.take(pa.array(at[found])), ka[found]
        for f in fields:
            mask = _differs(ra.column(f), rb.column(f))
            add(kept[mask], f, _text(ra.column(f), mask), _text(rb.column(f), mask))
        columns = [pa.chunked_array([c for cell in cells for c in (cell[i].chunks if isinstance(cell[i], pa.ChunkedArray) else [cell[i]])],
                                    type=kind if i == 0 else pa.string()) for i in range(4)]
        return pa.table(columns, names=[key, "field", "left_value", "right_value"])

    return bucket


def differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], left_only: str = "not_in_right",
                right_only: str = "not_in_left", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, field, left_value, right_value): ``left_only`` / ``right_only`` for
    keys on one side, else every field in which the sides differ."""
    buckets = max(1, (max(left.count(), right.count())) // bucket_rows + 1)
    tasks = min(-(-buckets // BUCKETS_PER_TASK), MOST_TASKS)

    def side(df: DataFrame) -> DataFrame:
        alike = F.xxhash64(*fields)
        one = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*fields)).alias("__row"), (F.min(alike) != F.max(alike)).alias("__several"))
        rows = one.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__bucket"), F.col(key).alias(key), "__several", *[F.col(f"__row.{f}").alias(f) for f in fields])
        return rows.repartition(tasks, "__bucket")

    kind = left.schema[key].dataType.simpleString()
    pairs = side(left).groupBy("__bucket").cogroup(side(right).groupBy("__bucket"))
    return pairs.applyInArrow(_compare(key, fields, left_only, right_only), f"{key} {kind}, field string, left_value string, right_value string")

"""What changed between full snapshots of a table.

Snapshots of one tree are put in order; every snapshot's rows are given a
canonical hash of their values and joined, by a full outer join on primary key
and place in the order, with the rows of the snapshot before. A missing side is
an addition or a removal, unequal hashes are a change.

Defined results: snapshots with null time or null tree are left out; equal
times are put in order by snapshot id; links repeated or leading to no row count
once or not at all; a snapshot may be empty; nulls in the primary key are
values equal to each other; if rows of one key in a snapshot differ, the one of
the largest values stands for them; null values alone have no hash and are never
a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_order(snapshots: DataFrame, sid: str, tree: str, time: str) -> DataFrame:
    """(sid, prev, next): the snapshots of each tree in order. One row per
    snapshot."""
    s = snapshots.select(sid, tree, time).filter(F.col(tree).isNotNull() & F.col(time).isNotNull() & ~F.isnan(time))
    in_order = Window.partitionBy(tree).orderBy(time, sid)
    return s.select(F.col(sid).alias("__sid"), F.lag(sid).over(in_order).alias("__prev"), F.lead(sid).over(in_order).alias("__next"))


def row_hash(*columns: str):
    """128-bit hash of the columns' canonical text; null if all are null."""
    text = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    present = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    return F.when(present, F.unhex(F.md5(F.concat_ws("\u0000", *text))))


def snapshot_changes(snapshots: DataFrame, links: DataFrame, rows: DataFrame, primary: list[str], values: list[str],
                     sid: str = "id", tree: str = "path", time: str = "created_at", link_sid: str = "snapshot_id",
                     link_row: str = "file_id", row_id: str = "id") -> DataFrame:
    """(snapshot_id, primary key, status) for every change from the snapshot
    just before to ``snapshot_id``."""
    order = snapshot_order(snapshots, sid, tree, time)
    link = links.select(F.col(link_sid).alias("__s"), F.col(link_row).alias("__row")).dropna().distinct()
    part = rows.select(F.col(row_id).alias("__row"), *primary, *[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)])
    names = [f"__v{i}" for i in range(len(values))]
    held = link.join(part, "__row").groupBy("__s", *primary).agg(F.max(F.struct(*names)).alias("__v"))
    held = held.select("__s", *primary, "__v.*").select("__s", *primary, row_hash(*names).alias("__hash"))
    now = held.join(order.filter("__prev is not null").select(F.col("__sid").alias("__s"), F.col("__sid").alias("__at")), "__s")
    then = held.join(order.filter("__next is not null").select(F.col("__sid").alias("__s"), F.col("__next").alias("__at")), "__s")
    now, then = now.drop("__s").alias("n"), then.drop("__s").alias("t")
    same = [F.col("n.__at") == F.col("t.__at"), *[F.col(f"n.{c}").eqNullSafe(F.col(f"t.{c}")) for c in primary]]
    both = now.join(then, same, "full_outer")
    status = (F.when(F.col("t.__at").isNull(), "added").when(F.col("n.__at").isNull(), "removed")
              .when(F.col("n.__hash") != F.col("t.__hash"), "changed"))
    out = both.withColumn("status", status).filter(F.col("status").isNotNull())
    # No coalesce over the key: a null key would be taken from the wrong side.
    return out.select(F.coalesce("n.__at", "t.__at").alias("snapshot_id"),
                      *[F.when(F.col("n.__at").isNull(), F.col(f"t.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in primary], "status")

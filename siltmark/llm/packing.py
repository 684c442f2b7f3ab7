"""Filling containers of fixed capacity: hierarchical residual packing.

Items larger than the capacity are split into full containers and a rest. Then
every partition packs its own items, largest first, each into the open
container it fits most tightly (best fit). Containers filled to ``full`` of the
capacity are final. The others are items of their own in a tree of further
best-fit rounds: in each, the underfull containers of ``fan_in`` neighbouring
groups are packed into each other. After a round at most one container of a
group is half empty, so of each group the ``carry`` emptiest go up and the rest,
which could take nothing more from one another, are final as they are. A merge
task therefore holds the underfull containers of ``fan_in`` input splits in the
first round, and at most ``fan_in`` * ``carry`` in later ones, at any size of
input; no item is dropped at any point.

Defined results: an item of null size is left out; an item of size 0 or less
counts 0 and goes to a container of its partition; sizes equal to the capacity
are not split; repeated rows are items of their own; empty input gives no rows;
a capacity below 1 or null is an error.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.session import cut

FULL, FAN_IN, CARRY = 0.98, 16, 256


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, by best fit in order of falling size."""
    out = np.zeros(len(sizes), np.int64)
    rooms: list[int] = []  # sorted distinct free spaces of open containers
    with_room: dict[int, list[int]] = {}
    n = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        if size <= 0:
            break
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            held = with_room[room]
            bin_no = held.pop()
            if not held:
                del with_room[room], rooms[at]
        else:
            room, bin_no, n = capacity, n, n + 1
        out[i] = bin_no
        room -= size
        if room:
            if room in with_room:
                with_room[room].append(bin_no)
            else:
                with_room[room] = [bin_no]
                insort(rooms, room)
    nothing = np.flatnonzero(sizes <= 0)
    out[nothing] = np.arange(len(nothing)) % max(n, 1)
    return out


def pieces(items: DataFrame, size: str, capacity: int) -> DataFrame:
    """Items with ``piece`` 0, 1, ... and its size; one piece unless the item
    is larger than the capacity."""
    n = F.greatest(F.ceil(F.col(size) / F.lit(capacity)), F.lit(1)).cast("int")
    out = items.filter(F.col(size).isNotNull()).withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    left = F.greatest(F.col(size), F.lit(0)) - F.col("piece").cast("long") * capacity
    return out.withColumn(size, F.least(left, F.lit(capacity).cast("long")))


def _pack_partition(capacity: int, keep: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)  # ids and sizes of one input split
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        if not table.num_rows:
            return
        sizes = table.column(keep).to_numpy()
        local = best_fit(sizes, capacity)
        base = TaskContext.get().partitionId() << 32
        fill = np.bincount(local, weights=np.maximum(sizes, 0)).astype(np.int64)
        n = table.num_rows
        rows = [*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns], pa.array(local + base), pa.nulls(n, pa.int64())]
        names = [*table.column_names, "bin", "fill"]
        yield pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in rows], names=names)
        empty = [pa.nulls(len(fill), f.type) for f in table.schema]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(np.arange(len(fill)) + base), pa.array(fill)], names=names)

    return pack


def _merge_group(capacity: int, full: int, carry: int):
    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        bins, sizes = table.column("bin").to_numpy(), table.column("fill").to_numpy()
        local = best_fit(sizes, capacity)
        fill = np.bincount(local, weights=np.maximum(sizes, 0)).astype(np.int64)
        roots = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(roots, local, bins)
        goes_up = np.zeros(len(fill), bool)
        open_bins = np.flatnonzero(fill < full)
        goes_up[open_bins[np.argsort(fill[open_bins], kind="stable")[:carry]]] = True
        return pa.table({"bin": bins, "root": roots[local], "fill": fill[local], "up": goes_up[local] & (roots[local] == bins)})

    return merge


def pack(items: DataFrame, size: str, keep: list[str], capacity: int, full: float = FULL, fan_in: int = FAN_IN, carry: int = CARRY) -> DataFrame:
    """(keep, piece, size, container): the container of every piece."""
    if capacity is None or capacity < 1:
        raise ValueError(f"capacity {capacity} can hold nothing")
    capacity, enough = int(capacity), int(np.ceil(full * capacity))
    names = [*keep, "piece", size]
    parts = pieces(items.select(*keep, F.col(size).cast("long").alias(size)), size, capacity).select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    placed = cut(parts.mapInArrow(_pack_partition(capacity, len(keep) + 1), f"{kinds}, bin bigint, fill bigint"), "packed")
    groups = int(placed.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0) + 1
    below = placed.filter(F.col("fill").isNotNull() & (F.col("fill") < enough)).select("bin", "fill")
    moved, span = None, 1
    while groups > 1:
        span, groups = span * fan_in, -(-groups // fan_in)
        group = F.floor(F.shiftright("bin", 32) / F.lit(span)).cast("long")
        step = below.withColumn("__group", group).groupBy("__group").applyInArrow(
            _merge_group(capacity, enough, carry), "bin bigint, root bigint, fill bigint, up boolean")
        step = cut(step, "merged")
        below = step.filter("up").select("bin", "fill")
        change = step.filter("bin <> root").select("bin", "root")
        if moved is None:
            moved = change
        else:  # what had moved into a container that now moves goes with it
            later = change.select(F.col("bin").alias("root"), F.col("root").alias("__later"))
            moved = moved.join(later, "root", "left").select("bin", F.coalesce("__later", "root").alias("root")).unionByName(change)
    out = placed.filter(F.col("fill").isNull()).select(*names, "bin")
    if moved is None:
        return out.withColumnRenamed("bin", "container")
    return out.join(cut(moved, "moved"), "bin", "left").select(*names, F.coalesce("root", "bin").alias("container"))


def split_items(packed: DataFrame, keep: list[str]) -> DataFrame:
    """The items of which pieces lie in more than one container."""
    spread = packed.groupBy(*keep).agg(F.max("piece").alias("__last"), F.min("container").alias("__first_in"), F.max("container").alias("__last_in"))
    return spread.filter("__last > 0 and __first_in <> __last_in").select(*keep)


def fill_report(packed: DataFrame, size: str, capacity: int) -> DataFrame:
    """Containers, their tokens, the least number that could hold them, and the
    share of space that is used."""
    used = packed.groupBy("container").agg(F.sum(size).alias("used"))
    total = used.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    return total.select("containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.lit(capacity)).alias("at_least"),
                        F.try_divide(F.col("tokens"), F.col("containers") * F.lit(capacity)).alias("used_share"))

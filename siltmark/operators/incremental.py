"""Replaying a consumer's runs over a filling table (see ``versioned``).

``load`` writes the rows into a versioned table, a version per distinct cutoff.
Rows without a time are removed by a deletion vector, and small files of past
versions are moved into larger ones from time to time, as in any table that
fills; deltas that span such a version take the removed files back out.

``replay`` then goes through the runs in their order. A run sees the last
version within its cutoff. It is given the delta between the version saved in
the last output commit and the one it sees, and writes the rows whose records
no earlier run has published. A run that failed does all of this but dies
before its commit; one without a status died before it wrote. Either leaves
neither output nor progress, so what it saw comes again with the next run. A run
whose cutoff went back gets nothing.

Defined results: rows with null ``time`` are left out; a run with null or NaN
cutoff sees nothing; a status other than ``ok``, or null, is a failure; rows
that are alike in ``record`` columns (null equal to null) are new only once, at
the first by ``time``, then ``order``; rows repeated with the same ``order``
value come once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.operators.prefilter import maybe_among
from siltmark.operators.versioned import Consumer, VersionedTable, part_number
from siltmark.session import shared_path

#: Rows of a data file: the table's share of a task, within these bounds.
LEAST_ROWS, MOST_ROWS = 50_000, 2_000_000
COMPACT_EVERY = 16


class RunFailed(RuntimeError):
    """The run died after its output was written and before it was committed."""


def step_index(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted ``bounds`` are less than ``value``: a binary
    search in one constant array."""
    if not bounds:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def step(found: Column, width: Column) -> Column:
        further = found + width
        return F.when((further <= len(bounds)) & (F.get(array, further - 1) < value), further).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _parts(counts: dict[int, int], tasks: int) -> tuple[list[int], list[int]]:
    """Per slice the number of its first file, and of its files."""
    rows = min(max(sum(counts.values()) // max(tasks, 1), LEAST_ROWS), MOST_ROWS)
    files = [-(-counts.get(i, 0) // rows) for i in range(max(counts, default=-1) + 1)]
    return [sum(files[:i]) for i in range(len(files))], files


def load(rows: DataFrame, runs: DataFrame, order: str, time: str, record: list[str],
         compact_every: int = COMPACT_EVERY) -> tuple[VersionedTable, list[tuple]]:
    """The source table, a version per cutoff, and (run, status, version it
    sees) of the runs; ``runs`` (bounded: one row per run) has run_id, status,
    cutoff."""
    spark = rows.sparkSession
    names = list(dict.fromkeys([order, time, *record]))
    log = [(r[0], r[1], r[2]) for r in runs.select("run_id", "status", "cutoff").orderBy("run_id").collect()]
    known = lambda c: c is not None and not math.isnan(c)
    bounds = sorted({float(c) for _, _, c in log if known(c)})

    # Slice 0 is of rows without time, slice i + 1 of those the i-th cutoff is the first to see.
    sliced = rows.select(*names, F.when(F.col(time).isNull(), 0).otherwise(step_index(F.col(time), bounds) + 1).alias("__slice"))
    sliced = sliced.filter(F.col("__slice") <= len(bounds))
    counts = {r[0]: r[1] for r in sliced.groupBy("__slice").agg(F.count(F.lit(1))).collect()}  # a row per cutoff
    first, files = _parts(counts, spark.sparkContext.defaultParallelism)
    source = VersionedTable(spark, shared_path(spark, "source"), rows.select(*names).schema)
    slices: dict[int, list[str]] = {}
    if sum(files):
        at = lambda numbers: F.get(F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>"), F.col("__slice"))
        part = (at(first) + F.pmod(F.xxhash64(order), at(files))).cast("int")
        for name in source.write_files(sliced.repartitionById(sum(files), part)):
            number = part_number(name)
            slices.setdefault(max(i for i, f in enumerate(first) if f <= number and files[i]), []).append(name)

    version_of, version, small = {}, 0, []
    for i, bound in enumerate(bounds, 1):
        version = source.commit(added=slices.get(i, []) + (slices.get(0, []) if i == 1 else []), meta={"cutoff": bound}, parent=version)
        if i == 1 and slices.get(0):
            version = source.delete(F.col(time).isNull(), meta={"cutoff": bound}, parent=version)
        if files and counts.get(i, 0) and counts[i] // files[i] < LEAST_ROWS:
            small += slices.get(i, [])
        if i % compact_every == 0 and len(small) > 1:
            version = source.compact(small, meta={"cutoff": bound}, parent=version)
            small = []
        version_of[bound] = version
    return source, [(run, status, version_of[float(c)]) for run, status, c in log if known(c)]


def deliveries(rows: DataFrame, runs: DataFrame, order: str, time: str, record: list[str]) -> DataFrame:
    """The deltas of all runs at once, as the rows with ``run_id``; nothing is
    published."""
    source, steps = load(rows, runs, order, time, record)
    done, out = 0, source.read(0).withColumn("_change", F.lit("insert")).withColumn("run_id", F.lit(0).cast("long"))
    for run, status, until in steps:
        if status == "ok" and until > done:
            out = out.unionByName(source.changes(done, until, net=True).withColumn("run_id", F.lit(run).cast("long")))
            done = until
    return out


def first_seen(delta: DataFrame, order: str, time: str, record: list[str], carry: list[str]) -> DataFrame:
    """Of the rows alike in ``record`` the first by ``time``, then ``order``:
    ``order``, ``carry`` and the record's columns as ``__is_``.

    A minimum, combined in each task before the shuffle, so a record that was
    written again a billion times arrives as one row per task.
    """
    first = F.min(F.struct(time, order, *carry)).alias("__first")
    found = delta.groupBy(*[F.col(c).alias(f"__is_{c}") for c in record]).agg(first)
    return found.select(F.col(f"__first.{order}").alias(order), *[F.col(f"__first.{c}").alias(c) for c in carry], *[f"__is_{c}" for c in record])


def publish_new(consumer: Consumer, run: int, until: int, order: str, time: str, record: list[str], ok: bool = True) -> int | None:
    """One run: publishes the rows of its delta whose records no earlier run has
    published. A run that is not ``ok`` dies before its commit."""
    keys = [f"__is_{c}" for c in record]
    own = [f"`{c}` AS `{k}`" for c, k in zip(record, keys)]
    schema = consumer.output.schema

    def new_rows(delta: DataFrame) -> DataFrame:
        # One minimum per record over this run's rows and the records published
        # before, which come first: no join, and nulls are equal.
        rows = delta.where("_change = 'insert'").selectExpr(*own, f"struct(1 AS seen, `{time}`, `{order}`) AS at")
        if consumer.processed():
            known = consumer.output.read().selectExpr(*[f"`{k}`" for k in keys])
            known = maybe_among(known, rows, keys)  # what can't be among this run's records isn't shuffled
            kind = {f.name: f.dataType.simpleString() for f in consumer.source.schema.fields}
            rows = rows.unionAll(known.selectExpr("*", f"struct(0 AS seen, cast(null AS {kind[time]}) AS `{time}`, cast(null AS {kind[order]}) AS `{order}`) AS at"))
        first = rows.groupBy(*keys).agg(F.min("at").alias("at")).where("at.seen = 1")
        return first.selectExpr(f"{run}L AS run_id", f"at.`{order}` AS `{order}`", *[f"`{k}`" for k in keys]).select(*schema.names)

    def die() -> None:
        raise RunFailed(f"run {run}")

    return consumer.run(new_rows, until, net=True, before_commit=(lambda: None) if ok else die, run_id=run)


def output_table(source: VersionedTable, order: str, record: list[str]) -> VersionedTable:
    kinds = source.schema
    fields = [T.StructField("run_id", T.LongType()), T.StructField(order, kinds[order].dataType)]
    return VersionedTable(source.spark, shared_path(source.spark, "output"),
                          T.StructType(fields + [T.StructField(f"__is_{c}", kinds[c].dataType) for c in record]))


def replay(rows: DataFrame, runs: DataFrame, order: str = "id", time: str = "updated_at",
           record: tuple[str, ...] = ("path", "algo", "mtime", "hash", "size"), compact_every: int = COMPACT_EVERY) -> DataFrame:
    """(run_id, ``order``) of the new rows each run must process, read from the
    output table that all publishing runs together have left."""
    record = list(record)
    source, steps = load(rows, runs, order, time, record, compact_every)
    consumer = Consumer(source, output_table(source, order, record))
    for run, status, until in steps:
        if status is None:
            continue
        try:
            publish_new(consumer, run, until, order, time, record, ok=status == "ok")
        except RunFailed:
            continue
    return consumer.output.read().select("run_id", order)

"""History of changing attributes from presence bitmaps.

Every entity has positions 0, 1, 2, ... (its snapshots, or its observations in
order). For each entity and attribute value a bitmap holds one bit per
position at which the entity had that value. It is kept in words of 62
positions; bits 0 and 63 of a word repeat the last position of the word before
and the first of the word after, so runs of consecutive bits are found inside
each word alone: a run starts at a set bit whose lower neighbour is clear and
ends at one whose upper neighbour is clear. Runs are the periods of validity; a
gap in the positions, or another value between, ends a run and the value's
return starts another.

A hot entity (see ``skew``) is cut, in order, into range parts on several tasks;
each part is given the last row of the part before it as a halo, and version
numbers are continued from counts per part.

Defined results: rows with null time or null in a ``required`` column are left
out; nulls in entity or other attributes are values equal to each other; ties
in time are put in order by ``order``; rows that repeat all columns count as
observations of their own (they change nothing); empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.operators import skew
from siltmark.session import cut

WORD = 62


def presence_edges(rows: DataFrame, entity: list[str], attrs: list[str], pos: str) -> DataFrame:
    """Adds ``run_starts`` and ``run_ends`` to rows with an entity, its
    attributes and a position, by the bitmaps described above. One shuffle at
    most, on ``entity`` (none if the rows are partitioned by it already)."""
    p = F.col(pos)
    word, bit = F.floor(p / WORD).cast("long"), F.pmod(p, F.lit(WORD)).cast("int")

    def place(w: Column, b: Column) -> Column:
        return F.struct(w.alias("w"), b.cast("int").alias("b"))

    own = place(word, bit + 1)
    places = F.when(bit == WORD - 1, F.array(own, place(word + 1, F.lit(0)))).when(
        (bit == 0) & (p > 0), F.array(own, place(word - 1, F.lit(WORD + 1)))).otherwise(F.array(own))
    spread = rows.withColumn("__at", F.explode(places))
    bitmap = Window.partitionBy(*entity, *attrs, F.col("__at.w"))
    spread = spread.withColumn("__bits", F.bit_or(F.expr("shiftleft(1L, __at.b)")).over(bitmap))
    spread = spread.filter((F.col("__at.b") >= 1) & (F.col("__at.b") <= WORD))

    def clear(b: str) -> Column:
        return F.expr(f"(shiftright(__bits, {b}) & 1L) = 0")

    return spread.withColumn("run_starts", clear("__at.b - 1")).withColumn("run_ends", clear("__at.b + 1")).drop("__at", "__bits")


def intervals(rows: DataFrame, entity: list[str], attrs: list[str], pos: str) -> DataFrame:
    """(entity, attributes, first_pos, last_pos): a row per run of consecutive
    positions. Repeated rows count once."""
    rows = rows.select(*entity, *attrs, pos).distinct()
    edges = presence_edges(rows, entity, attrs, pos).filter("run_starts or run_ends")
    of_value = Window.partitionBy(*entity, *attrs).orderBy(pos)
    last = F.when(F.col("run_ends"), F.col(pos)).otherwise(F.lead(pos).over(of_value))
    return edges.withColumn("last_pos", last).filter("run_starts").select(*entity, *attrs, F.col(pos).alias("first_pos"), "last_pos")


def _openings(rows: DataFrame, entity: list[str], attrs: list[str], order: str, time: str) -> DataFrame:
    """The rows that open a version within their (entity, __part)."""
    key = [*entity, "__part"]
    in_order = Window.partitionBy(*key).orderBy(F.desc("__halo"), time, order)
    placed = rows.withColumn("__pos", F.row_number().over(in_order) - 1)
    return presence_edges(placed, key, attrs, "__pos").filter("run_starts and not __halo").drop("run_starts", "run_ends", "__halo")


def versions(rows: DataFrame, entity: list[str], attrs: list[str], order: str, time: str, required: list[str] = (),
             parts: int | None = None) -> DataFrame:
    """All versions of every entity: entity, attributes, ``file_id`` (``order``
    of the opening row), ``version_no``, ``valid_from``, ``valid_to``,
    ``closed_by`` (null for the last version) and ``n_versions``."""
    names = list(dict.fromkeys([*entity, *attrs, order, time]))
    rows = rows.select(*names)
    for c in [time, *required]:
        rows = rows.filter(F.col(c).isNotNull())
    key = skew.hash_of(*entity)
    hot = skew.hot_keys(rows.selectExpr(f"{key} AS k"))
    n = parts or hot.agg(F.sum("__salts")).first()[0] or 0
    flagged = skew.flag_hot(rows, key, hot, "__hot") if n else rows.withColumn("__hot", F.lit(False))
    flat = flagged.filter("not __hot").drop("__hot").withColumn("__part", F.lit(0)).withColumn("__halo", F.lit(False))
    opened = _openings(flat, entity, attrs, order, time)
    by_entity = Window.partitionBy(*entity, "__part").orderBy("__pos")
    whole = Window.partitionBy(*entity, "__part")

    def numbered(df: DataFrame) -> DataFrame:
        return (df.withColumn("version_no", F.row_number().over(by_entity).cast("long"))
                .withColumn("closed_by", F.lead(order).over(by_entity)).withColumn("valid_to", F.lead(time).over(by_entity))
                .withColumn("n_versions", F.count(F.lit(1)).over(whole)))

    out = [*entity, *attrs, F.col(order).alias("file_id"), "version_no", F.col(time).alias("valid_from"), "valid_to", "closed_by", "n_versions"]
    result = numbered(opened).select(*out)
    if not n:
        return result

    ranged = flagged.filter("__hot").drop("__hot").repartitionByRange(n, *entity, time, order)
    ranged = cut(ranged.withColumn("__part", F.spark_partition_id()), "history")  # parts must stay as they are from here on
    # One row per hot entity and part: bounded by (hot entities + parts).
    ends = ranged.groupBy(*entity, "__part").agg(F.max(F.struct(time, order, *attrs)).alias("e"))
    following = Window.partitionBy(*entity).orderBy("__part")
    halos = ends.withColumn("__part", F.lead("__part").over(following)).filter("__part is not null")
    halos = halos.select(*[F.col(c) if c in entity else F.col(f"e.{c}").alias(c) for c in names], "__part", F.lit(True).alias("__halo"))
    local = numbered(_openings(ranged.withColumn("__halo", F.lit(False)).unionByName(halos), entity, attrs, order, time))
    local = cut(local.select(*names, "__part", "version_no", "closed_by", "valid_to", "n_versions"), "history")
    sums = local.filter("version_no = 1").select(*entity, "__part", F.col("n_versions").alias("__n"), F.col(order).alias("__first"), F.col(time).alias("__at"))
    rest = Window.partitionBy(*entity)
    sums = (sums.withColumn("__before", F.coalesce(F.sum("__n").over(following.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("__next", F.lead("__first").over(following)).withColumn("__next_at", F.lead("__at").over(following))
            .withColumn("__all", F.sum("__n").over(rest)))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*entity, "__part"]]
    joined = local.alias("l").join(sums.alias("s"), same)  # a part is on one task, so no key here is hot
    joined = joined.select(*[F.col(f"l.{c}") for c in names], (F.col("version_no") + F.col("__before")).alias("version_no"),
                           F.coalesce("closed_by", "__next").alias("closed_by"), F.coalesce("valid_to", "__next_at").alias("valid_to"),
                           F.col("__all").alias("n_versions"))
    return result.unionByName(joined.select(*out))

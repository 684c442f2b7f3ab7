"""Verifying and comparing manifests.

A manifest has ``path``, metadata, and a column per hash algorithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.functions.hashes import DEFAULT_ALGO, HASHES
from siltmark.functions.paths import is_gzip, uncompressed_path


def algos_of(manifest: DataFrame) -> list[str]:
    return [a for a in HASHES if a in manifest.columns]


def long_form(manifest: DataFrame, keep: list[str] = ("path",), algos: list[str] | None = None) -> DataFrame:
    """A row per path and algorithm: ``keep``, algo, hash; nulls are left out."""
    algos = algos_of(manifest) if algos is None else algos
    pairs = F.array(*[F.struct(F.lit(a).alias("algo"), F.col(f"`{a}`").alias("hash")) for a in algos])
    return manifest.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.algo", "x.hash").filter("hash is not null")


def wide_form(rows: DataFrame, keep: list[str], algos: list[str]) -> DataFrame:
    """From rows with algo and hash to a column per algorithm."""
    return rows.select(*keep, *[F.when(F.col("algo") == a, F.col("hash")).alias(a) for a in algos])


def present(manifest: DataFrame, algo: str) -> DataFrame:
    """Rows that have a hash: null and empty values are dropped."""
    return manifest.filter(F.col(algo).isNotNull() & (F.col(algo) != ""))


def mtime_changed(recorded, live):
    """Null equals nothing but null, so an entry without time always changed."""
    return ~F.coalesce(recorded == live, F.lit(False))


def verify(manifest: DataFrame, live: DataFrame, gzip_fallback: bool = False) -> DataFrame:
    """(algo, hash, path): live hashes that differ from the recorded ones, of
    files whose time changed. Files that are gone are not reported. With
    ``gzip_fallback`` a missing ``x`` is looked up as ``x.gz`` but reported as ``x``."""
    recorded = long_form(manifest, ["path", "mtime"]).filter("hash <> ''").withColumnRenamed("hash", "old").withColumnRenamed("mtime", "was")
    now = long_form(live, ["path", "mtime"]).filter("hash <> ''").withColumnRenamed("hash", "new")
    if gzip_fallback:
        here = live.select("path", F.lit(True).alias("here")).distinct()
        recorded = recorded.join(here, "path", "left").withColumn("at", F.when(F.col("here"), F.col("path")).otherwise(F.concat("path", F.lit(".gz"))))
    else:
        recorded = recorded.withColumn("at", F.col("path"))
    both = recorded.join(now.withColumnRenamed("path", "at"), ["at", "algo"])
    return both.filter(mtime_changed(F.col("was"), F.col("mtime")) & (F.col("new") != F.col("old"))).select("algo", F.col("new").alias("hash"), "path")


def compare(source: DataFrame, other: DataFrame, algo: str = DEFAULT_ALGO) -> DataFrame:
    """(algo, hash, path) of source entries with no match: the same path and
    hash, or the same name and hash, null equal to null. Two anti joins on
    equality, as neither-nor, in place of one on a disjunction; their right sides
    have a row per key, so the adaptive planner can split a hot key on the left."""
    rows = source.select("path", "name", F.col(algo).alias("hash"))
    theirs = other.select("path", "name", F.col(algo).alias("hash"))
    left = rows.join(theirs.select("path", F.col("hash").alias("h")).distinct().withColumnRenamed("path", "p"),
                     (F.col("path") == F.col("p")) & F.col("hash").eqNullSafe(F.col("h")), "left_anti")
    named = theirs.select(F.col("name").alias("n"), F.col("hash").alias("h")).distinct()
    left = left.join(named, F.col("name").eqNullSafe(F.col("n")) & F.col("hash").eqNullSafe(F.col("h")), "left_anti")
    return left.select(F.lit(algo).alias("algo"), "hash", "path")


def dedupe(target: DataFrame, source: DataFrame, algo: str = DEFAULT_ALGO, target_root: str = "", source_root: str = "",
           target_misses: DataFrame | None = None, source_misses: DataFrame | None = None) -> DataFrame:
    """(target, source): full paths of entries of one relative path and equal
    hash. ``*_misses`` (from ``verify``) replace recorded hashes by live ones."""

    def side(manifest: DataFrame, misses: DataFrame | None, name: str) -> DataFrame:
        rows = manifest.select("path", F.col(algo).alias(name))
        if misses is not None:
            new = misses.filter(F.col("algo") == algo).select("path", F.col("hash").alias("__new"))
            rows = rows.join(new, "path", "left").withColumn(name, F.coalesce("__new", name)).drop("__new")
        return rows.filter(F.col(name).isNotNull() & (F.col(name) != ""))

    both = side(target, target_misses, "__t").join(side(source, source_misses, "__s"), "path").filter("__t = __s")
    full = lambda root: F.concat(F.lit(root.rstrip("/") + "/"), "path") if root else F.col("path")
    return both.select(full(target_root).alias("target"), full(source_root).alias("source"))


def uncompressed(manifest: DataFrame, size: str | None = None) -> DataFrame:
    """Paths and names without .gz; ``size`` is a column of unpacked sizes."""
    size_then = F.when(is_gzip(F.col("path")), F.coalesce(size, "size")).otherwise(F.col("size")) if size else F.col("size")
    new = {"path": uncompressed_path(F.col("path")), "name": uncompressed_path(F.col("name")), "size": size_then}
    return manifest.withColumns(new)  # all from the columns as they were


def sidecar_hashes(entries: DataFrame, sidecars: DataFrame, algo: str = DEFAULT_ALGO) -> DataFrame:
    """Adds ``sidecar_hash``: the value the manifest in the entry's own folder
    (rows of ``sidecars`` have its ``folder``) holds for its name, if the times
    are equal; else null."""
    theirs = sidecars.select(F.col("folder").alias("dirname"), F.col("path").alias("name"), "mtime", F.col(algo).alias("sidecar_hash"))
    theirs = theirs.dropDuplicates(["dirname", "name", "mtime"])
    return entries.join(theirs, ["dirname", "name", "mtime"], "left")

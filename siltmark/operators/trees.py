"""Hashing and verifying trees of files, end to end."""

from __future__ import annotations

import gzip
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions.hashes import DEFAULT_ALGO, hasher_maker
from siltmark.functions.paths import manifest_name, real_path, relative_path
from siltmark.operators import cache as caches
from siltmark.operators import digests
from siltmark.operators.manifests import algos_of
from siltmark.sources.fstree import CHUNK, scan_tree
from siltmark.sources.manifests import write_manifest


def file_hash(path: str, algo, uncompress: bool = False) -> str | None:
    """Hash of one file, read in chunks; None if it can't be read. ``algo`` is a
    name or a maker of hashers."""
    state = hasher_maker(algo)() if isinstance(algo, str) else algo()
    try:
        with (gzip.open if uncompress and path.lower().endswith(".gz") else open)(path, "rb") as f:
            while chunk := f.read(CHUNK):
                state.update(chunk)
    except OSError:
        return None
    return state.hexdigest()


def hash_paths(entries: DataFrame, algo: str = DEFAULT_ALGO, uncompress: bool = False, path: str = "path") -> DataFrame:
    """Adds the column ``algo`` to rows of files, each read where its task runs.
    Rows are dealt out evenly first, as few large directories may hold most."""

    make = hasher_maker(algo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(path)
            values = [file_hash(p, make, uncompress) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], names=[*batch.schema.names, algo])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields)
    n = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return entries.repartition(n).mapInArrow(run, f"{schema}, `{algo}` string")


def hash_tree(spark: SparkSession, paths: list[str], algo: str = DEFAULT_ALGO, out: str | None = None, start: str | None = None,
              cache: caches.HashCache | None = None, snapshot: str | None = None, force: bool = False, uncompress: bool = False,
              single: bool = True, patterns: list[str] | None = None) -> DataFrame:
    """Hash the files beneath ``paths``: (path, metadata, algo, cached).

    Files the cache knows by (path, mtime, algo) are not read, unless forced.
    All of ``paths`` go into one manifest, and every file scanned is linked to
    the snapshot. A hash of unpacked contents is not that of the file, so with
    ``uncompress`` the cache and its snapshots are neither read nor written."""
    hasher_maker(algo)  # ValueError if there is none
    paths = list(dict.fromkeys(paths))
    began = time.time()
    if cache is None or force or uncompress:
        rows = scan_tree(spark, paths, force=force, algos=[algo], uncompress=uncompress, patterns=patterns).withColumn("cached", F.lit(False))
    else:
        stats = scan_tree(spark, paths, force=force, patterns=patterns).withColumn("algo", F.lit(algo))
        known, new = caches.split_known(stats, cache.files())
        known = known.withColumn(algo, F.col("cached_hash")).withColumn("cached", F.lit(True)).drop("cached_hash", "algo")
        rows = known.unionByName(hash_paths(new.drop("algo"), algo).withColumn("cached", F.lit(False)))
    rows = rows.filter(F.col(algo).isNotNull())
    if out:
        rows = rows.filter(~F.col("path").isin(os.path.abspath(out), os.path.realpath(out)))
    rows = rows.cache()
    try:
        if cache is not None and not uncompress:
            entries = rows.select("path", "mtime", F.lit(algo).alias("algo"), F.col(algo).alias("hash"), "size", F.col("ino").cast("string").alias("inode"),
                                  F.lit(float(int(began))).alias("updated_at"))
            cache.put(entries)
            if snapshot:
                cache.snapshot(snapshot, os.path.abspath(start or paths[0]), entries)
        if out:
            base = os.path.realpath(start) if start else os.path.dirname(os.path.realpath(out))
            record = rows.drop("cached").withColumn("path", real_path(F.col("path"))).withColumn("path", relative_path(F.col("path"), base))
            if uncompress:
                from siltmark.operators.manifests import uncompressed

                record = uncompressed(record)
            write_manifest(record, out, single=single)
    except Exception:
        rows.unpersist()
        raise
    return rows


def verify_tree(manifest: DataFrame, root: str, uncompress: bool = False) -> DataFrame:
    """(algo, hash, path) of files whose time and content changed since the
    manifest was written. Only files whose time changed are read. Files that are
    gone are passed over; ``uncompress`` looks for ``x.gz`` where ``x`` is gone,
    and reports ``x``."""
    algos = [(a, hasher_maker(a)) for a in algos_of(manifest)]
    rows = manifest if "mtime" in manifest.columns else manifest.withColumn("mtime", F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                full = os.path.join(root, r["path"])
                at = full
                if uncompress and not os.path.exists(full) and os.path.exists(full + ".gz"):
                    at = full + ".gz"
                try:
                    if os.stat(at).st_mtime == r["mtime"]:
                        continue
                except OSError:
                    continue
                for a, make in algos:
                    if r[a] and (new := file_hash(at, make, uncompress)) and new != r[a]:
                        found.append((a, new, full))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(3)], names=["algo", "hash", "path"])

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.select("path", "mtime", *[a for a, _ in algos]).repartition(n).mapInArrow(run, "algo string, hash string, path string")


def folder_hash(spark: SparkSession, path: str, algo: str = DEFAULT_ALGO) -> str | None:
    """One hash over the contents of all files beneath a folder, in path order."""
    files = scan_tree(spark, [path]).withColumn("folder", F.lit(path))
    row = digests.folder_hashes(files, content=None, algo=algo).first()
    return row["hash"] if row else None


def path_hash(spark: SparkSession, path: str, algo: str = DEFAULT_ALGO, filetype: str = "a") -> str | None:
    """Hash of a file or folder; None if ``filetype`` leaves it out."""
    if os.path.isdir(path):
        return folder_hash(spark, path, algo) if filetype in ("d", "a") else None
    return file_hash(path, algo) if filetype in ("f", "a") and os.path.isfile(path) else None


def path_hashes(spark: SparkSession, path: str, algo: str = DEFAULT_ALGO, filetype: str = "f", recursive: bool = True) -> DataFrame:
    """(path, hash) of files and/or folders; rows without a hash are dropped."""
    if not recursive:
        value = path_hash(spark, path, algo, filetype)
        return spark.createDataFrame([(path, value)] if value else [], "path string, hash string")
    parts = []
    if filetype in ("f", "a"):
        parts.append(scan_tree(spark, [path], algos=[algo]).select("path", F.col(algo).alias("hash")))
    if filetype in ("d", "a"):
        files = scan_tree(spark, [path])
        parts.append(digests.every_folder(files, os.path.abspath(path), content=None, algo=algo).select(F.col("folder").alias("path"), "hash"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.filter("hash is not null and hash <> ''")


def duplicate_files(spark: SparkSession, paths: list[str], algo: str = DEFAULT_ALGO) -> DataFrame:
    """(hash, n_files, path) of files of equal content. Sizes that occur once
    can't be duplicates, so only the other files are read."""
    stats = None
    for p in paths:  # a file reached from two inputs counts twice
        if p and os.path.exists(p):
            part = scan_tree(spark, [p])
            stats = part if stats is None else stats.unionByName(part)
    if stats is None:
        return spark.createDataFrame([], "hash string, n_files bigint, path string")
    sizes = stats.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size")
    return digests.duplicates(hash_paths(stats.join(sizes, "size", "left_semi"), algo), value=algo)


def sidecar_path(path: str) -> str:
    return os.path.join(os.path.dirname(os.path.abspath(path)), manifest_name())

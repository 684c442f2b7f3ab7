"""Digests of folders and lists, and groups of equal content.

A hash over a concatenation is made in order, so a folder is one stream: rows
are sorted by folder and path and pass through an incremental hasher batch by
batch. Memory does not grow with a folder; sorting spills. Where contents are
files, only their paths are sorted, and the task that hashes a folder reads
them; contents that are a column of a table have to travel with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.functions.hashes import DEFAULT_ALGO, content_hash, hasher_maker
from siltmark.functions.paths import ancestors, under_root
from siltmark.operators.skew import hash_of, hot_keys, skew_join
from siltmark.session import cut

CHUNK = 1 << 20


def _file_chunks(path: str) -> Iterator[bytes]:
    """The bytes of a file; what can't be read counts as empty."""
    try:
        with open(path, "rb") as f:
            while chunk := f.read(CHUNK):
                yield chunk
    except OSError:
        return


def _stream(algo: str, begin: bytes = b"", files: bool = False):
    """Hashes runs of rows (group, bytes) that come sorted by group; instead of
    bytes there may be paths of ``files``."""
    make = hasher_maker(algo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            done = []
            for g, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = state is None or g != group
                if first:
                    if state is not None:
                        done.append((group, state.hexdigest()))
                    group, state = g, make()
                if files:
                    for chunk in _file_chunks(data):
                        state.update(chunk)
                elif data:
                    state.update(data[len(begin):] if first else data)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], names=["g", "h"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["g", "h"])

    return run


def folder_hashes(files: DataFrame, folder: str = "folder", path: str = "path", content: str | None = "content", algo: str = DEFAULT_ALGO) -> DataFrame:
    """(folder, hash): hash of the folder's contents in ascending order of path;
    without ``content`` those of the files at the paths. Null content counts as
    empty; a null folder or path is left out."""
    rows = files.filter(F.col(folder).isNotNull() & F.col(path).isNotNull())
    rows = rows.select(F.col(folder).alias("g"), F.col(content or path).alias("c"), *([F.col(path).alias("p")] if content else []))
    rows = rows.repartition("g").sortWithinPartitions("g", "p" if content else "c").select("g", "c")
    return rows.mapInArrow(_stream(algo, files=content is None), "g string, h string").select(F.col("g").alias(folder), F.col("h").alias("hash"))


def every_folder(files: DataFrame, root: str, path: str = "path", content: str | None = "content", algo: str = DEFAULT_ALGO) -> DataFrame:
    """``folder_hashes`` of every directory from ``root`` down, each over all
    the files beneath it."""
    above = F.filter(ancestors(F.col(path)), lambda d: under_root(d, root))
    rows = files.select(path, *([content] if content else []), F.explode(above).alias("folder"))
    return folder_hashes(rows, "folder", path, content, algo)


def composite_hash(entries: DataFrame, path: str = "path", value: str = "hash", algo: str = DEFAULT_ALGO) -> DataFrame:
    """One row (hash): over lines ``path:hash`` in order of path, then hash. An
    empty list has the hash of an empty text; entries with nulls are left out."""
    rows = entries.select(F.col(path).alias("p"), F.col(value).alias("v")).dropna()
    line = F.encode(F.concat(F.lit("\n"), "p", F.lit(":"), "v"), "utf-8")
    rows = rows.repartition(1).sortWithinPartitions("p", "v").select(F.lit("").alias("g"), line.alias("c"))
    made = rows.mapInArrow(_stream(algo, b"\n"), "g string, h string")
    nothing = content_hash(F.encode(F.lit(""), "utf-8"), algo)
    return made.agg(F.max("h").alias("h")).select(F.coalesce("h", nothing).alias("hash"))


def duplicates(entries: DataFrame, path: str = "path", value: str = "hash") -> DataFrame:
    """(hash, n_files, path): every member of a group of more than one. A path
    given twice counts twice; null and empty hashes are left out. Groups are
    rows, never arrays, so a group may be of any size."""
    rows = entries.select(F.col(value).alias("hash"), F.col(path).alias("path")).filter("hash is not null and hash <> ''")
    rows = cut(rows, "hashes")  # read three times, but contents are hashed once
    counts = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n_files")).filter("n_files > 1")
    many = cut(counts, "groups")
    hot = hot_keys(many.selectExpr(f"{hash_of('hash')} AS k", "n_files"), total=rows.count(), n="n_files")
    return skew_join(rows, many, ["hash"], "inner", hot).select("hash", "n_files", "path")


def summary(entries: DataFrame, size: str = "size", seconds: float | None = None) -> DataFrame:
    """Files, bytes and, given the time taken, rates (MB of 2^20 bytes)."""
    out = entries.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    if seconds:
        out = out.withColumn("files_per_s", F.col("files") / F.lit(seconds)).withColumn("mb_per_s", F.col("bytes") / F.lit(seconds * 1024**2))
    return out

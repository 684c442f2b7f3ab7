"""Readers and writers of manifests: JSON, text and XML hash lists.

Writers leave a folder of part files unless ``single`` is asked for (one task,
streaming). The parts of a JSON manifest, put together in order of their names,
are one JSON object with a record per line.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.functions.hashes import DEFAULT_ALGO, HASHES
from siltmark.functions.paths import relative_path, utc_stamp
from siltmark.session import cut, filesystem, hadoop_path

#: Names and order of the fields of a manifest record.
STAT_TYPES = {"name": "string", "dirname": "string", "atime": "double", "ctime": "double", "mtime": "double", "ino": "bigint",
              "dev": "bigint", "nlink": "bigint", "size": "bigint", "type": "string"}
#: Names of dates in XML hash lists.
XML_DATES = {"atime": "lastaccesseddate", "ctime": "creationdate", "mtime": "lastmodificationdate"}
XML_VERSION = "1.1"


def record_schema(extra: dict[str, str] | None = None) -> str:
    fields = {**STAT_TYPES, **{a: "string" for a in HASHES}, **(extra or {})}
    return ", ".join(f"`{k}` {v}" for k, v in fields.items())


_EDGES = ("{", "}", "")


def _line_records(lines: DataFrame, extra: dict[str, str] | None) -> DataFrame:
    """Adds ``e``: the map a line of a JSON manifest holds, null if the line
    alone is no record (the braces around all records hold none)."""
    body = F.regexp_replace("value", r"^\s*,?|,?\s*$", "")
    kind = f"map<string, struct<{_colons(record_schema(extra))}>>"
    return lines.withColumn("e", F.when(~body.isin(*_EDGES), F.from_json(F.concat(F.lit("{"), body, F.lit("}")), kind)))


def _last_wins(rows: DataFrame, value: str, order: Column) -> DataFrame:
    return rows.groupBy("path").agg(F.max_by(value, order).alias(value))


def read_json(spark: SparkSession, path: str, extra: dict[str, str] | None = None) -> DataFrame:
    """Manifest of any layout: (path, fields). Where every line is a record, as
    ``write_json`` leaves them, files are split among tasks; else each file is
    parsed whole."""
    lines = spark.read.text(path)
    text = F.trim("value")
    # A line of its own: one key and one object, closed. Anything else is another layout.
    alone = text.rlike(r'^,?\s*"(?:[^"\\]|\\.)*"\s*:\s*\{.*\}\s*,?$') | text.isin(*_EDGES)
    nested = _line_records(lines.filter(~text.isin(*_EDGES)), extra).filter(F.col("e").isNull() | (F.size("e") != 1))
    by_line = lines.filter(~alone).isEmpty() and nested.isEmpty() and not lines.filter(text == "{").isEmpty()
    return (read_json_lines if by_line else read_json_whole)(spark, path, extra)


def read_json_whole(spark: SparkSession, path: str, extra: dict[str, str] | None = None) -> DataFrame:
    """Each file is parsed whole, in one task; text that isn't JSON gives no
    rows; of repeated paths the last wins."""
    text = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", f"map<string, struct<{_colons(record_schema(extra))}>>"))
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.posexplode(entries).alias("pos", "entry"))
    rows = rows.select(F.col("entry.key").alias("path"), F.col("entry.value").alias("record"), "file", "pos")
    return _last_wins(rows, "record", F.struct("file", "pos")).select("path", "record.*")


def _colons(ddl: str) -> str:
    return ", ".join(part.replace(" ", ": ", 1) for part in ddl.split(", "))


def read_json_lines(spark: SparkSession, path: str, extra: dict[str, str] | None = None) -> DataFrame:
    """A manifest with a record per line, as ``write_json`` leaves it: files are
    split among tasks, so a manifest may be of any size."""
    rows = _line_records(_positions(spark.read.text(path)), extra).select(F.explode(F.map_entries("e")).alias("e"), "at")
    return _last_wins(rows.select(F.col("e.key").alias("path"), F.col("e.value").alias("record"), "at"), "record", F.col("at")).select("path", "record.*")


def _positions(lines: DataFrame) -> DataFrame:
    """Lines with a value that grows in order of file, block and line."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n"))
    return lines.select("value", at.alias("at"))


def read_txt(spark: SparkSession, path: str, algo: str = DEFAULT_ALGO) -> DataFrame:
    """Lines ``hash path``: (path, algo's column). Lines without both parts are
    dropped; of repeated paths the last wins."""
    lines = _positions(spark.read.text(path))
    parts = F.split(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""), " ", 2)
    rows = lines.withColumn("parts", parts).filter(F.size("parts") == 2)
    return _last_wins(rows.select(F.col("parts")[1].alias("path"), F.col("parts")[0].alias(algo), "at"), algo, F.col("at"))


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """An XML hash list: (path, hashdate, lastmodificationdate, size, md5)."""
    schema = "file string, hashdate string, lastmodificationdate string, size bigint, md5 string"
    rows = spark.read.format("xml").option("rowTag", "hash").option("ignoreSurroundingSpaces", False).schema(schema).load(path)
    return rows.select(F.col("file").alias("path"), "hashdate", "lastmodificationdate", F.coalesce("size", F.lit(0)).alias("size"),
                       F.coalesce("md5", F.lit("")).alias("md5"))


def _write(rows: DataFrame, out: str, single: bool, order: list[str], save: Callable[[DataFrame, str], None]) -> None:
    """A folder of parts, or one file: that is written by one task in a folder
    beside it and then put in its place."""
    if not single:
        save(rows.orderBy(*order) if order else rows, out)
        return
    spark, folder = rows.sparkSession, f"{out}.{uuid.uuid4().hex}"
    save(rows.repartition(1).sortWithinPartitions(*order) if order else rows.repartition(1), folder)
    fs, target = filesystem(spark, out), hadoop_path(spark, out)
    parts = [s.getPath() for s in fs.listStatus(hadoop_path(spark, folder)) if s.getPath().getName().startswith("part-")]
    fs.delete(target, True)
    if parts:
        fs.rename(parts[0], target)
    else:
        fs.create(target).close()
    fs.delete(hadoop_path(spark, folder), True)


def _save(lines: DataFrame, out: str, single: bool, order: list[str]) -> None:
    _write(lines, out, single, order, lambda df, to: df.select("value").write.mode("overwrite").text(to))


def write_json(df: DataFrame, out: str, single: bool = False) -> None:
    """One JSON object, a record per line; paths are escaped; an empty manifest
    is an empty object. Null fields are left out; of records of one path one is
    kept. Commas lead every line but the first."""
    fields = [c for c in df.columns if c != "path"]
    body = F.to_json(F.struct(*fields)) if fields else F.lit("{}")
    # The text of {"path": ...} without its braces and key is the escaped path.
    key = F.expr("substring(__key, 9, length(__key) - 9)")
    df = df.filter("path is not null").dropDuplicates(["path"])
    rows = cut(df.withColumn("__key", F.to_json(F.struct("path"))).select(
        F.lit(1).alias("kind"), F.col("path").alias("at"), F.concat(F.lit("    "), key, F.lit(": "), body).alias("value")), "lines")
    first = rows.agg(F.min("at")).first()[0]
    rows = rows.withColumn("value", F.when(F.col("at") == F.lit(first), F.col("value")).otherwise(F.concat(F.lit("    ,"), F.ltrim("value"))))
    ends = df.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "kind int, at string, value string")
    _save(ends.unionByName(rows), out, single, ["kind", "at"])


def write_txt(df: DataFrame, out: str, algo: str | None = None, single: bool = False) -> None:
    """Lines ``hash path``; without ``algo`` the first one the table has."""
    algo = algo or next((a for a in HASHES if a in df.columns), None)
    if algo is None:
        raise ValueError("no hash column to write")
    lines = df.select(F.concat_ws(" ", F.coalesce(algo, F.lit("")), "path").alias("value"), F.col("path").alias("at"))
    _save(lines, out, single, ["at"])


def write_xml(df: DataFrame, out: str, single: bool = False) -> None:
    """An XML hash list per part file; a record's elements are in reverse order
    of its fields, so that the path comes last. Paths are relative to ``out``."""
    fields = [c for c in df.columns if c != "path"]
    cells = [(utc_stamp(F.col(c)) if "date" in XML_DATES.get(c, c) else F.col(c).cast("string")).alias(XML_DATES.get(c, c)) for c in reversed(fields)]
    rows = df.select(*cells, utc_stamp(F.unix_timestamp().cast("double")).alias("hashdate"), relative_path(F.col("path"), os.path.dirname(out)).alias("file"))
    options = {"rootTag": f'hashlist version="{XML_VERSION}"', "rowTag": "hash", "declaration": 'version="1.0" encoding="UTF-8"'}
    _write(rows, out, single, ["file"] if single else [], lambda df, to: df.write.mode("overwrite").format("xml").options(**options).save(to))


READERS: dict[str, Callable[..., DataFrame]] = {".json": read_json, ".txt": read_txt, ".mhl": read_xml}
WRITERS: dict[str, Callable[..., None]] = {".json": write_json, ".txt": write_txt, ".mhl": write_xml}


def _by_extension(table: dict, path: str):
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in table:
        raise ValueError(f"no manifest format for {path!r}; known: {', '.join(table)}")
    return table[ext]


def read_manifest(spark: SparkSession, path: str, **options) -> DataFrame:
    return _by_extension(READERS, path)(spark, path, **options)


def write_manifest(df: DataFrame, path: str, **options) -> None:
    _by_extension(WRITERS, path)(df, path, **options)

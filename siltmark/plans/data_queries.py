"""Queries of the general record-level operators over the driver's tables, and
the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltmark.operators import compare, history, incremental, references, snapdiff, treeagg
from siltmark.operators.versioned import VersionedTable
from siltmark.session import cut, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FIELDS = ["path", "mtime", "algo", "hash", "size", "inode"]


def p1_found(spark, d):
    new = incremental.replay(table(spark, d, "files"), table(spark, d, "sync_runs"))
    return new.filter("run_id <> 1").select("run_id", F.col("id").alias("file_id"))


def p1_run_sizes(spark, d):
    """Per publishing run: rows delivered to it and new rows among them."""
    record = ["path", "algo", "mtime", "hash", "size"]
    delta = incremental.deliveries(table(spark, d, "files"), table(spark, d, "sync_runs"), "id", "updated_at", record)
    new = incremental.first_seen(delta, "id", "updated_at", record, ["run_id"])
    sizes = delta.groupBy("run_id").agg(F.count(F.lit(1)).alias("delivered"))
    return sizes.join(new.groupBy("run_id").agg(F.count(F.lit(1)).alias("new_rows")), "run_id", "left").fillna(0)


def p1_deltas(spark, d):
    """Net rows inserted and deleted over three commits: a first load, a deletion
    of one algorithm's rows by deletion vectors, and its rows from the replica."""
    columns = ["id", *FIELDS]
    ours, theirs = (table(spark, d, n).select(*columns) for n in ("files", "files_replica"))
    t = VersionedTable(spark, shared_path(spark, "deltas"), ours.schema)
    since = t.append(ours)
    t.delete(F.col("algo") == "crc32")
    until = t.append(theirs.filter("algo = 'crc32'"))
    return t.changes(since, until, net=True).withColumnRenamed("_change", "change")


def p1_replica_deltas(spark, d):
    """Net rows inserted and deleted when the replica replaces the table whole:
    a first load, deletion vectors over all its rows, and the replica's rows."""
    columns = ["id", *FIELDS]
    ours, theirs = (table(spark, d, n).select(*columns) for n in ("files", "files_replica"))
    t = VersionedTable(spark, shared_path(spark, "deltas"), ours.schema)
    since = t.append(ours)
    t.delete(F.lit(True))
    until = t.append(theirs)
    return t.changes(since, until, net=True).withColumnRenamed("_change", "change")


def p2_versions(spark, d):
    return history.versions(table(spark, d, "files"), ["path", "algo"], ["mtime", "hash"], "id", "updated_at", ["hash"])


def p2_found(spark, d):
    v = p2_versions(spark, d).filter("n_versions >= 2")
    return v.select("file_id", "version_no", F.coalesce("closed_by", F.lit(0).cast("long")).alias("closed_by"))


def p2_history(spark, d):
    v = p2_versions(spark, d)
    return v.select("path", "algo", "version_no", "mtime", "hash", "valid_from", "valid_to", "file_id")


def p2_membership(spark, d):
    """Periods, in snapshots of a tree, during which a path had a hash."""
    order = table(spark, d, "snapshots").filter("created_at is not null")
    at = F.row_number().over(Window.partitionBy("path").orderBy("created_at", "id")) - 1
    order = order.select(F.col("id").alias("snapshot_id"), F.col("path").alias("tree"), at.cast("long").alias("pos"))
    links = table(spark, d, "snapshot_files").select("snapshot_id", "file_id").distinct()
    held = links.join(order, "snapshot_id")
    rows = held.join(table(spark, d, "files").select(F.col("id").alias("file_id"), "path", "algo", "hash"), "file_id")
    return history.intervals(rows, ["tree", "path", "algo"], ["hash"], "pos")


def _differences(spark, d):
    return compare.differences(table(spark, d, "files"), table(spark, d, "files_replica"), "id", FIELDS, "not_in_replica", "not_in_files")


def p4_found(spark, d):
    return _differences(spark, d).filter(~F.col("field").isin(*compare.SEVERAL)).select("id", "field")


def p4_cells(spark, d):
    """Every cell that differs, with both values (times aside, whose text is not
    the same in every engine)."""
    return _differences(spark, d).filter("field <> 'mtime'")


def p4_summary(spark, d):
    return p4_found(spark, d).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def p5_totals(spark, d):
    t = treeagg.tree_totals(table(spark, d, "files"), ["hash"], "size")
    return t.filter("hash is not null").select("hash", "n_rows", F.col("total").cast("long").alias("total_size"))


def p5_found(spark, d):
    files = table(spark, d, "files")
    return treeagg.heavy_keys(treeagg.tree_totals(files, ["hash"], "size"), files.count()).select("hash")


def _references(spark, d):
    links = cut(references.combined(table(spark, d, "snapshot_files"), ["snapshot_id", "file_id"], "linked_at"), "links")
    to_files = references.broken_references(links, "file_id", table(spark, d, "files"), "id", "updated_at")
    to_snapshots = references.broken_references(links, "snapshot_id", table(spark, d, "snapshots"), "id", "created_at")
    return to_files.withColumn("ref_table", F.lit("files")).unionByName(to_snapshots.withColumn("ref_table", F.lit("snapshots")))


def p6_found(spark, d):
    return _references(spark, d).select("ref_table", "problem", "snapshot_id", "file_id", "period")


def p6_by_period(spark, d):
    return _references(spark, d).groupBy("ref_table", "problem", "period").agg(F.count(F.lit(1)).alias("n"))


def p7_found(spark, d):
    return snapdiff.snapshot_changes(table(spark, d, "snapshots"), table(spark, d, "snapshot_files"), table(spark, d, "files"),
                                     ["path", "algo"], ["hash"])


def p7_counts(spark, d):
    return p7_found(spark, d).groupBy("snapshot_id", "status").agg(F.count(F.lit(1)).alias("n"))


def p7_paths(spark, d):
    """Changes of paths whatever the algorithm: a path has several hashes in a snapshot, of which the largest counts."""
    return snapdiff.snapshot_changes(table(spark, d, "snapshots"), table(spark, d, "snapshot_files"), table(spark, d, "files"), ["path"], ["hash"])


QUERIES = {f.__name__: f for f in (
    p1_found, p1_run_sizes, p1_deltas, p1_replica_deltas, p2_found, p2_history, p2_membership, p4_found, p4_cells, p4_summary, p5_found, p5_totals,
    p6_found, p6_by_period, p7_found, p7_counts, p7_paths)}

_ROW = ", ".join(["id", *FIELDS])
_NEW = """
WITH ok AS (SELECT run_id, cutoff FROM sync_runs WHERE status = 'ok' AND cutoff IS NOT NULL),
seen AS (SELECT *, row_number() OVER (PARTITION BY path, algo, mtime, hash, size ORDER BY updated_at, id) AS rn
         FROM files WHERE updated_at IS NOT NULL),
given AS (SELECT s.id, s.rn, (SELECT min(run_id) FROM ok WHERE cutoff >= s.updated_at) AS run_id FROM seen s)
"""
_VERSIONS = """
WITH r AS (SELECT *, lag(mtime) OVER w AS pm, lag(hash) OVER w AS ph, row_number() OVER w AS k FROM files
           WHERE updated_at IS NOT NULL AND hash IS NOT NULL WINDOW w AS (PARTITION BY path, algo ORDER BY updated_at, id)),
v AS (SELECT *, row_number() OVER w AS version_no, lead(id) OVER w AS nid, lead(updated_at) OVER w AS nat,
             count(*) OVER (PARTITION BY path, algo) AS n
      FROM r WHERE k = 1 OR mtime IS DISTINCT FROM pm OR hash <> ph WINDOW w AS (PARTITION BY path, algo ORDER BY updated_at, id))
"""
_DIFFS = """
WITH a AS (SELECT DISTINCT id, path, mtime, algo, hash, size, inode FROM files),
b AS (SELECT DISTINCT id, path, mtime, algo, hash, size, inode FROM files_replica),
d AS (SELECT id, 'not_in_replica' AS field FROM a WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT id, 'not_in_files' FROM b WHERE id NOT IN (SELECT id FROM a)
""" + "".join(f"UNION ALL SELECT a.id, '{f}' FROM a JOIN b USING (id) WHERE a.{f} IS DISTINCT FROM b.{f}\n" for f in FIELDS) + ")"
_CELL = lambda side: "CASE field " + " ".join(f"WHEN '{f}' THEN {side}.{f}::VARCHAR" for f in FIELDS if f != "mtime") + " END"
_BROKEN = """
WITH l AS (SELECT snapshot_id, file_id, linked_at, strftime(to_timestamp(floor(linked_at)) AT TIME ZONE 'UTC', '%Y-%m') AS period FROM snapshot_files),
b AS (SELECT DISTINCT 'files' AS ref_table, CASE WHEN f.id IS NULL THEN 'missing' ELSE 'late' END AS problem, snapshot_id, file_id, period
FROM l LEFT JOIN files f ON f.id = file_id WHERE f.id IS NULL OR linked_at < f.updated_at
UNION ALL SELECT DISTINCT 'snapshots', CASE WHEN s.id IS NULL THEN 'missing' ELSE 'late' END, snapshot_id, file_id, period
FROM l LEFT JOIN snapshots s ON s.id = snapshot_id WHERE s.id IS NULL OR linked_at < s.created_at)
"""
_CHANGES = """
WITH s AS (SELECT id, path AS tree, lag(id) OVER w AS prev, lead(id) OVER w AS next FROM snapshots WHERE created_at IS NOT NULL
           WINDOW w AS (PARTITION BY path ORDER BY created_at, id)),
h AS (SELECT snapshot_id, f.path, f.algo, max(f.hash) AS hash FROM (SELECT DISTINCT snapshot_id, file_id FROM snapshot_files) l
      JOIN files f ON f.id = l.file_id GROUP BY ALL),
n AS (SELECT s.id AS at, path, algo, hash FROM h JOIN s ON s.id = snapshot_id WHERE prev IS NOT NULL),
t AS (SELECT s.next AS at, path, algo, hash FROM h JOIN s ON s.id = snapshot_id WHERE next IS NOT NULL),
c AS (SELECT coalesce(n.at, t.at) AS snapshot_id, coalesce(n.path, t.path) AS path, coalesce(n.algo, t.algo) AS algo,
             CASE WHEN t.at IS NULL THEN 'added' WHEN n.at IS NULL THEN 'removed' WHEN n.hash <> t.hash THEN 'changed' END AS status
      FROM n FULL JOIN t ON n.at = t.at AND n.path = t.path AND n.algo = t.algo)
"""
ORACLES = {
    "p1_found": _NEW + "SELECT run_id, id AS file_id FROM given WHERE rn = 1 AND run_id <> 1",
    "p1_run_sizes": _NEW + "SELECT run_id, count(*) AS delivered, count(*) FILTER (rn = 1) AS new_rows FROM given WHERE run_id IS NOT NULL GROUP BY run_id",
    "p1_deltas": "".join(
        f"{glue}SELECT *, '{change}' AS change FROM (SELECT {_ROW} FROM {a} WHERE algo = 'crc32' EXCEPT ALL SELECT {_ROW} FROM {b} WHERE algo = 'crc32')"
        for glue, change, a, b in (("", "delete", "files", "files_replica"), (" UNION ALL ", "insert", "files_replica", "files"))),
    "p1_replica_deltas": "".join(
        f"{glue}SELECT *, '{change}' AS change FROM (SELECT {_ROW} FROM {a} EXCEPT ALL SELECT {_ROW} FROM {b})"
        for glue, change, a, b in (("", "delete", "files", "files_replica"), (" UNION ALL ", "insert", "files_replica", "files"))),
    "p2_found": _VERSIONS + "SELECT id AS file_id, version_no, coalesce(nid, 0) AS closed_by FROM v WHERE n >= 2",
    "p2_history": _VERSIONS + "SELECT path, algo, version_no, mtime, hash, updated_at AS valid_from, nat AS valid_to, id AS file_id FROM v",
    "p2_membership": """
WITH s AS (SELECT id, path AS tree, row_number() OVER (PARTITION BY path ORDER BY created_at, id) - 1 AS pos FROM snapshots WHERE created_at IS NOT NULL),
h AS (SELECT DISTINCT tree, f.path, f.algo, f.hash, pos FROM snapshot_files l JOIN s ON s.id = l.snapshot_id JOIN files f ON f.id = l.file_id),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY tree, path, algo, hash ORDER BY pos) AS island FROM h)
SELECT tree, path, algo, hash, min(pos) AS first_pos, max(pos) AS last_pos FROM g GROUP BY tree, path, algo, hash, island""",
    "p4_found": _DIFFS + "SELECT id, field FROM d",
    "p4_cells": _DIFFS + f"""SELECT d.id, field, {_CELL('a')} AS left_value, {_CELL('b')} AS right_value
FROM d LEFT JOIN a USING (id) LEFT JOIN b USING (id) WHERE field <> 'mtime'""",
    "p4_summary": _DIFFS + "SELECT field, count(*) AS n FROM d GROUP BY field",
    "p5_found": "SELECT hash FROM files WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) * 100 >= (SELECT count(*) FROM files)",
    "p5_totals": "SELECT hash, count(*) AS n_rows, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM files WHERE hash IS NOT NULL GROUP BY hash",
    "p6_found": _BROKEN + "SELECT * FROM b",
    "p6_by_period": _BROKEN + "SELECT ref_table, problem, period, count(*) AS n FROM b GROUP BY ALL",
    "p7_found": _CHANGES + "SELECT * FROM c WHERE status IS NOT NULL",
    "p7_paths": _CHANGES.replace(", f.algo", "").replace("path, algo, ", "path, ").replace(" AND n.algo = t.algo", "").replace("coalesce(n.algo, t.algo) AS algo,", "") + "SELECT * FROM c WHERE status IS NOT NULL",
    "p7_counts": _CHANGES + "SELECT snapshot_id, status, count(*) AS n FROM c WHERE status IS NOT NULL GROUP BY ALL",
}

"""The cache of hashed files, its snapshots, and their differences.

The functions work on tables; ``HashCache`` keeps them as versioned tables in
a folder. A change becomes visible by one commit: what belongs to a snapshot is
linked to its ``uid`` and only counts once the snapshot's own row is committed,
so a writer that dies before that leaves nothing that can be seen. Writers that
lose a race compute their change again (``versioned.retrying``).
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.functions.paths import is_glob, matches_glob, under_root
from siltmark.operators.versioned import VersionedTable, retrying

KEY = ["path", "mtime", "algo"]
FILES = "path string, mtime double, algo string, hash string, size bigint, inode string, updated_at double"
SNAPSHOTS = "name string, path string, created_at double, uid string"
LINKS = "uid string, path string, mtime double, algo string"


# -- files ---------------------------------------------------------------------

def query(cache: DataFrame, pattern: str, algo: str | None = None, since: float | None = None) -> DataFrame:
    """Entries whose path is, or as a glob matches, ``pattern``."""
    path = F.col("path")
    out = cache.filter(matches_glob(path, pattern) if is_glob(pattern) else path == pattern)
    if algo:
        out = out.filter(F.col("algo") == algo)
    return out.filter(F.col("updated_at") >= F.lit(since)) if since is not None else out


def since_seconds(spark: SparkSession, text: str) -> float:
    """Epoch seconds of an ISO time; without offset, in the session's zone."""
    when = datetime.fromisoformat(text)  # ValueError if it is none
    if when.tzinfo is None:
        when = when.replace(tzinfo=ZoneInfo(spark.conf.get("spark.sql.session.timeZone")))
    return when.timestamp()


def lookup(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds ``cached_hash`` by (path, mtime, algo), null where unknown."""
    known = cache.filter("hash is not null").groupBy(*KEY).agg(F.min("hash").alias("cached_hash"))
    return entries.join(known, KEY, "left")


def has(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """The entries the cache holds with the same hash."""
    return entries.join(cache.select(*KEY, "hash").distinct(), [*KEY, "hash"], "left_semi")


def split_known(entries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known with their hash, unknown): only the second must be hashed."""
    both = lookup(entries, cache)
    return both.filter("cached_hash is not null"), both.filter("cached_hash is null").drop("cached_hash")


def first_written(rows: DataFrame, order: Column) -> DataFrame:
    """The first row by ``order`` for each (path, mtime, algo). Keys with a null
    are all kept apart from others, as one key per combination of nulls."""
    others = [c for c in rows.columns if c not in KEY]
    first = rows.groupBy(*KEY).agg(F.min_by(F.struct(*others), order).alias("r"))
    return first.select(*[F.col(c) if c in KEY else F.col(f"r.{c}").alias(c) for c in rows.columns])


def merge(mine: DataFrame, theirs: DataFrame, now: float | None = None) -> DataFrame:
    """Union by key; existing rows win, added ones are stamped ``now``."""
    rank = F.struct("__prio", F.col("updated_at"), F.col("hash"), F.col("size"), F.col("inode"))
    added = theirs.select(*mine.columns).withColumn("updated_at", F.lit(now).cast("double")) if now is not None else theirs.select(*mine.columns)
    both = mine.withColumn("__prio", F.lit(0)).unionByName(added.withColumn("__prio", F.lit(1)))
    return first_written(both, rank).drop("__prio")


def new_entries(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose key the cache does not have: first write wins."""
    return rows.join(cache.select(*KEY).distinct(), KEY, "left_anti")


def entry_id() -> Column:
    return F.xxhash64(*KEY)


# -- snapshots -----------------------------------------------------------------

def changes_between(first: DataFrame, second: DataFrame, key: list[str], same_algo: bool = False) -> DataFrame:
    """(status, path) between two snapshots' file rows: ``changed`` if both have
    the path with two hashes, else ``added`` / ``removed`` if a row, by ``key``,
    is in one only; paths in both of these (touched, same hash) are left out."""
    a = first.select("path", "algo", F.col("hash").alias("h1")).filter("h1 is not null").distinct()
    b = second.select("path", "algo", F.col("hash").alias("h2")).filter("h2 is not null").distinct()
    if same_algo:
        both = a.join(b, ["path", "algo"])
    else:
        both = a.drop("algo").join(b.drop("algo"), "path")
    changed = both.filter("h1 <> h2").select("path").distinct()
    only_a = first.join(second.select(*key).distinct(), key, "left_anti").select("path").distinct()
    only_b = second.join(first.select(*key).distinct(), key, "left_anti").select("path").distinct()
    marks = [(changed, "changed", 4), (only_b, "added", 1), (only_a, "removed", 2)]
    every = None
    for rows, _, bit in marks:
        part = rows.withColumn("bit", F.lit(bit))
        every = part if every is None else every.unionByName(part)
    seen = every.groupBy("path").agg(F.bit_or("bit").alias("m"))
    status = F.when(F.col("m") >= 4, "changed").when(F.col("m") == 1, "added").when(F.col("m") == 2, "removed")
    return seen.select(status.alias("status"), "path").filter("status is not null")


def below(diff: DataFrame, root: str) -> DataFrame:
    return diff.filter(under_root(F.col("path"), root))


def listed(snapshots: DataFrame) -> DataFrame:
    """Newest first; equal times by name."""
    return snapshots.orderBy(F.desc("created_at"), "name")


class HashCache:
    """Files, snapshots and links of a folder, as versioned tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.tables = {n: VersionedTable(spark, f"{root.rstrip('/')}/{n}", _schema(ddl))
                       for n, ddl in (("files", FILES), ("snapshots", SNAPSHOTS), ("links", LINKS))}

    def files(self) -> DataFrame:
        return self.tables["files"].read()

    def snapshots(self) -> DataFrame:
        return self._snapshot_rows().drop("uid")

    def links(self) -> DataFrame:
        """(snapshot, path, mtime, algo) of the snapshots there are."""
        names = self._snapshot_rows().select(F.col("name").alias("snapshot"), "uid")
        return self.tables["links"].read().join(names, "uid").select("snapshot", *KEY).distinct()

    def _snapshot_rows(self) -> DataFrame:
        return self.tables["snapshots"].read()

    def put(self, rows: DataFrame) -> None:
        rows = first_written(rows.select(*[f.name for f in _schema(FILES)]), F.struct("updated_at", "hash"))
        self._add("files", lambda known: new_entries(rows, known))

    def _add(self, name: str, new, tries: int = 5) -> None:
        """Append ``new(what the table holds)``, computed from one version."""
        table = self.tables[name]

        def attempt() -> int:
            version = table.latest()
            return table.append(new(table.read(version)), parent=version)

        retrying(attempt, tries)

    def get(self, path: str, mtime: float, algo: str) -> str | None:
        row = self.files().filter((F.col("path") == path) & (F.col("mtime") == mtime) & (F.col("algo") == algo)).select("hash").first()
        return row[0] if row else None

    def merge(self, other: HashCache, now: float | None = None) -> None:
        """Adopt another cache's entries, snapshots and links that are new
        here. Links go by natural keys, and only those of adopted snapshots."""
        now = float(time.time() // 1 if now is None else now)
        rows = first_written(other.files(), F.struct("updated_at", "hash"))
        self._add("files", lambda known: new_entries(rows, known).withColumn("updated_at", F.lit(now)), tries=10)
        theirs = other._snapshot_rows()
        adopted = theirs.join(self._snapshot_rows().select("name"), "name", "left_anti")
        links = other.tables["links"].read().join(adopted.select("uid"), "uid", "left_semi")
        self._add("links", lambda known: links.join(known, ["uid", *KEY], "left_anti"), tries=10)
        self._add("snapshots", lambda known: theirs.join(known.select("name"), "name", "left_anti"), tries=10)

    def drop_snapshot(self, name: str) -> None:
        """Its links go with it; an unknown name changes nothing."""
        self._replace(name, None)

    def _replace(self, name: str, row: DataFrame | None) -> None:
        """Put ``row`` in the place of a snapshot's row, in one commit. Links of
        what it was can't be seen from then on; they are removed afterwards."""
        table = self.tables["snapshots"]

        def attempt() -> list[str]:
            version = table.latest()
            old = [r[0] for r in table.read(version).filter(F.col("name") == name).select("uid").collect()]
            if old or row is not None:
                table.delete(F.col("name") == name, parent=version, instead=row)
            return old

        if old := retrying(attempt):
            retrying(lambda: self.tables["links"].delete(F.col("uid").isin(old)))

    def link(self, name: str, rows: DataFrame) -> None:
        """Add files to a snapshot; links that exist are not repeated."""
        row = self._snapshot_rows().filter(F.col("name") == name).select("uid").first()
        if row is None:
            raise ValueError(f"no snapshot {name!r}")
        self._link(row[0], rows)

    def _link(self, uid: str, rows: DataFrame) -> None:
        new = rows.select(F.lit(uid).alias("uid"), *KEY).distinct()
        self._add("links", lambda known: new.join(known.filter(F.col("uid") == uid), ["uid", *KEY], "left_anti"))

    def snapshot(self, name: str, path: str, rows: DataFrame, replace: bool = True, now: float | None = None) -> None:
        """Record ``rows`` under a name, in place of what it was or added to it."""
        known = self._snapshot_rows().filter(F.col("name") == name).limit(1).count() > 0
        if known and not replace:
            self.link(name, rows)
            return
        uid, made = uuid.uuid4().hex, float(time.time() // 1 if now is None else now)
        self._link(uid, rows)  # not seen until the snapshot's row is there
        row = self.spark.createDataFrame([(name, path, made, uid)], SNAPSHOTS)
        self._replace(name, row)

    def members(self, name: str) -> DataFrame:
        links = self.links().filter(F.col("snapshot") == name).select(*KEY)
        return self.files().join(links, KEY)

    def diff(self, first: str, second: str, force: bool = False, same_algo: bool = False) -> DataFrame:
        roots = {r[0]: r[1] for r in self.snapshots().filter(F.col("name").isin(first, second)).collect()}
        for name in (first, second):
            if name not in roots:
                raise ValueError(f"no snapshot {name!r}")
        if roots[first] != roots[second] and not force:
            raise ValueError(f"snapshots of different roots: {roots[first]!r}, {roots[second]!r}")
        return changes_between(self.members(first), self.members(second), KEY, same_algo)


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)

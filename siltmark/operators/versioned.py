"""Processing only new or changed records.

A versioned table is a set of immutable data files and, for each version, an
immutable manifest: the data files of that version and, for each of them, its
deletion vectors (positions of rows deleted since the file was written). The
record delta between two versions is found by comparing two manifests:

* rows of added files are inserts, rows of removed files are deletes;
* in a file both versions have, rows that only the later deletion vectors name
  are deletes, rows that only the earlier ones name are inserts.

Files both versions have unchanged are never read. A consumer saves the source
version it has processed in the same commit that publishes its output, so a
run that fails leaves neither output nor progress behind, and the next run
starts from the last version that was really processed.

Manifests are metadata of the size of the file list; each holds what changed
since its parent, and every ``FULL_EVERY``-th holds the whole list.

A writer names the version its rows were computed from; if another one has
committed since, its commit is refused (``CommitConflict``), and ``retrying``
computes the rows again from the new version.

Defined results: null values are ordinary values; rows repeated in the data
are repeated in the delta; an empty table has an empty delta; a target version
before the source version gives nothing for a consumer, which never goes back.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.session import Folder

FULL_EVERY = 16
#: Seconds before the second try, and what each further wait is longer by.
FIRST_WAIT, LONGER = 0.2, 1.25

Made = TypeVar("Made")


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


def retrying(attempt: Callable[[], Made], tries: int = 5) -> Made:
    """Repeats what lost a race, from its start, after growing waits that differ
    between writers; other errors, and the last conflict, are raised."""
    for n in range(tries):
        try:
            return attempt()
        except CommitConflict as conflict:
            if n + 1 == tries:
                raise RuntimeError(f"gave up after {tries} tries: {conflict}") from conflict
        time.sleep(FIRST_WAIT * LONGER**n * random.uniform(1.0, 1.5))
    raise ValueError(f"tries must be 1 or more, not {tries}")


class VersionedTable:
    """Append data files, delete rows, and read versions or deltas."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._versions = Folder(spark, f"{self.root}/_versions")
        self._loaded: dict[int, dict] = {}  # manifests never change
        self._seen: int | None = None

    # -- manifests ---------------------------------------------------------

    @staticmethod
    def _name(version: int) -> str:
        return f"{version:012d}.json"

    def latest(self) -> int:
        """The last committed version, 0 for a new table. Versions have no gaps,
        so after the first look only those since the last one are looked for."""
        if self._seen is None:
            names = self._versions.names()
            self._seen = max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)
        while self._versions.has(self._name(self._seen + 1)):
            self._seen += 1
        return self._seen

    def _load(self, version: int) -> dict:
        if version not in self._loaded:
            self._loaded[version] = json.loads(self._versions.read(self._name(version)))
        return self._loaded[version]

    def manifest(self, version: int) -> dict[str, list[str]]:
        """Data file -> its deletion vectors, as of ``version``."""
        chain = []
        while version:
            chain.append(self._load(version))
            if "full" in chain[-1]:
                break
            version -= 1
        files: dict[str, list[str]] = {}
        for m in reversed(chain):
            if "full" in m:
                files = dict(m["full"])
            else:
                for name in m["removed"]:
                    files.pop(name, None)
                files.update({name: [] for name in m["added"]})
                for name, vector in m["vectors"].items():
                    files[name] = [*files[name], vector]
        return files

    def meta(self, version: int) -> dict:
        return self._load(version)["meta"] if version else {}

    def commit(self, added=(), removed=(), vectors=None, meta=None, parent: int | None = None) -> int:
        """Publish the next version; all of it becomes visible at once."""
        parent = self.latest() if parent is None else parent
        version = parent + 1
        body = {"added": list(added), "removed": list(removed), "vectors": vectors or {}, "meta": meta or {}}
        if version % FULL_EVERY == 0:
            files = self.manifest(parent)
            for name in body["removed"]:
                files.pop(name, None)
            files.update({name: [] for name in body["added"]})
            for name, vector in body["vectors"].items():
                files[name] = [*files[name], vector]
            body["full"] = files
        if not self._versions.put_new(self._name(version), json.dumps(body).encode()):
            raise CommitConflict(f"version {version} of {self.root} exists")
        return version

    # -- data --------------------------------------------------------------

    def write_files(self, df: DataFrame) -> list[str]:
        """Write data files without publishing them. Returns their names, in
        order of the partitions that wrote them (see ``part_number``)."""
        folder = f"data/{uuid.uuid4().hex}"
        df.select(*[f.name for f in self.schema.fields]).write.parquet(f"{self.root}/{folder}")
        names = Folder(self.spark, f"{self.root}/{folder}").names()
        return [f"{folder}/{n}" for n in sorted(names) if n.endswith(".parquet")]

    def append(self, df: DataFrame, meta=None, parent: int | None = None) -> int:
        """``parent`` is the version ``df`` was computed from, if from this table."""
        parent = self.latest() if parent is None else parent
        return self.commit(added=self.write_files(df), meta=meta, parent=parent)

    def delete(self, condition, meta=None, parent: int | None = None, instead: DataFrame | None = None) -> int:
        """Delete rows by writing a deletion vector; no data file is rewritten.
        The rows of ``instead`` come in their place in the same commit."""
        parent = self.latest() if parent is None else parent
        files, name = self.manifest(parent), f"_vectors/{uuid.uuid4().hex}"
        live = self._rows(files, positions=True)
        live.filter(condition).select("__file", "__pos").write.parquet(f"{self.root}/{name}")
        # No longer than the manifest's own list of files.
        hit = [r[0] for r in self._vector(name).select("__file").distinct().collect()]
        if unknown := [f for f in hit if f not in files]:
            raise ValueError(f"deletion vector names files that version {parent} does not have: {unknown[:3]}")
        added = self.write_files(instead) if instead is not None else []
        return self.commit(added=added, vectors={f: name for f in hit}, meta=meta, parent=parent)

    def compact(self, files: list[str], partitions: int = 1, meta=None, parent: int | None = None) -> int:
        """Move the live rows of ``files`` into new files; no row changes."""
        parent = self.latest() if parent is None else parent
        known = self.manifest(parent)
        rows = self._rows({f: known[f] for f in files})
        return self.commit(added=self.write_files(rows.repartition(partitions)), removed=files, meta=meta, parent=parent)

    def _vector(self, name: str) -> DataFrame:
        return self.spark.read.schema("__file string, __pos long").parquet(f"{self.root}/{name}")

    def _scan(self, files: list[str], positions: bool) -> DataFrame:
        names = [f.name for f in self.schema.fields]
        if not files:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.select("*", F.lit("").alias("__file"), F.lit(0).cast("long").alias("__pos")) if positions else empty
        df = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in files])
        if not positions:
            return df
        # The end of the address is of our own making and needs no decoding, whatever the root is called.
        name = F.regexp_extract(F.col("_metadata.file_path"), "data/[0-9a-f]{32}/[^/]+$", 0)
        return df.select(*names, name.alias("__file"), F.col("_metadata.row_index").alias("__pos"))

    def _rows(self, files: dict[str, list[str]], positions: bool = False) -> DataFrame:
        """Rows of ``files`` that no deletion vector of theirs names."""
        marked = {f: v for f, v in files.items() if v}
        plain = self._scan([f for f in files if f not in marked], positions)
        if not marked:
            return plain
        rows = self._scan(list(marked), True).join(self._named(marked), ["__file", "__pos"], "left_anti")
        return plain.unionByName(rows if positions else rows.drop("__file", "__pos"))

    def _named(self, files: dict[str, list[str]]) -> DataFrame:
        """(__file, __pos) of the deletion vectors of ``files``. A vector may name
        other files too; positions are only looked up together with the file."""
        names = sorted({name for vectors in files.values() for name in vectors})
        if not names:
            return self.spark.createDataFrame([], "__file string, __pos long")
        return self.spark.read.schema("__file string, __pos long").parquet(*[f"{self.root}/{name}" for name in names])

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(self.latest() if version is None else version))

    def changes(self, since: int, until: int, net: bool = False) -> DataFrame:
        """The rows inserted and deleted between two versions, with
        ``_change`` = ``insert`` or ``delete``. ``net`` cancels rows that were
        only moved to another file (nothing is done for it if only files were
        added, as the manifests tell)."""
        old, new = self.manifest(since), self.manifest(until)
        added = {f: v for f, v in new.items() if f not in old}
        removed = {f: v for f, v in old.items() if f not in new}
        kept = [f for f in new if f in old and new[f] != old[f]]
        inserts = [self._rows(added)] if added else []
        deletes = [self._rows(removed)] if removed else []
        if kept:
            rows = self._scan(kept, True)
            before = self._named({f: [x for x in old[f] if x not in new[f]] for f in kept})
            after = self._named({f: [x for x in new[f] if x not in old[f]] for f in kept})
            shared = self._named({f: [x for x in new[f] if x in old[f]] for f in kept})
            key = ["__file", "__pos"]
            rows = rows.join(shared, key, "left_anti")
            deletes.append(rows.join(after, key, "left_semi").join(before, key, "left_anti").drop(*key))
            inserts.append(rows.join(before, key, "left_semi").join(after, key, "left_anti").drop(*key))
        parts = [(x, "insert") for x in inserts] + [(x, "delete") for x in deletes]
        parts = parts or [(self._scan([], False), "insert")]
        out = reduce(DataFrame.unionByName, [part.withColumn("_change", F.lit(kind)) for part, kind in parts])
        if not net or not deletes:
            return out
        names = [f.name for f in self.schema.fields]
        sign = F.when(F.col("_change") == "insert", 1).otherwise(-1)
        left = out.groupBy(*names).agg(F.sum(sign).alias("__n")).filter("__n <> 0")
        left = left.withColumn("_change", F.when(F.col("__n") > 0, "insert").otherwise("delete"))
        return left.withColumn("__i", F.explode(F.sequence(F.lit(1), F.abs("__n").cast("int")))).drop("__n", "__i")


class Consumer:
    """Reads a versioned table step by step into a versioned output table."""

    def __init__(self, source: VersionedTable, output: VersionedTable):
        self.source, self.output = source, output

    def processed(self) -> int:
        """The source version saved in the last output commit."""
        return int(self.output.meta(self.output.latest()).get("source_version", 0))

    def pending(self, until: int | None = None) -> tuple[int, int]:
        """(version processed, version to process); equal if nothing is new."""
        since = self.processed()
        until = self.source.latest() if until is None else until
        return since, max(since, until)

    def publish(self, files, since: int, until: int, **meta) -> int:
        """Output files and progress in one commit. Refused if the progress is
        not the one the files were made from."""
        parent = self.output.latest()
        done = int(self.output.meta(parent).get("source_version", 0))
        if done != since:
            raise CommitConflict(f"output is at source version {done}, not {since}")
        return self.output.commit(added=files, meta={"source_version": until, **meta}, parent=parent)

    def run(self, transform, until: int | None = None, net: bool = False, before_commit=lambda: None, **meta) -> int | None:
        """One run: process the delta with ``transform`` and publish it with the
        progress. ``before_commit`` is called when the output has been written
        but is not yet visible; if it raises, nothing has happened."""
        since, until = self.pending(until)
        if since == until:
            return None
        files = self.output.write_files(transform(self.source.changes(since, until, net)))
        before_commit()
        return self.publish(files, since, until, **meta)


def part_number(name: str) -> int:
    """The partition that wrote a data file."""
    return int(name.rpartition("/")[2].split("-")[1])

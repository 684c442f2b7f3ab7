"""File trees as DataFrames: a Python data source.

Options: ``paths`` (JSON list), ``filetype`` (f, d or a), ``force`` (ignore
nothing), ``algos`` (JSON list; each file is hashed while it is read, in chunks,
so files of any size fit), ``content`` (the bytes as a column), ``uncompress``
(hash and size of gzip files are those of what they hold), ``patterns`` (JSON
list). The driver lists only the first levels of the tree; every directory
found there is walked by a task of its own.

A directory with an ignored name or path is left out with all beneath it; links
to directories are not followed; files that can't be read are skipped, as are
roots that don't exist. Names that are not valid UTF-8 are percent-escaped.
"""

from __future__ import annotations

import gzip
import json
import os
import re
from collections.abc import Iterator
from urllib.parse import quote_from_bytes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import types as T

from siltmark.functions.hashes import hasher_maker
from siltmark.functions.paths import ignored_patterns, ignored_regex

CHUNK = 1 << 20
SPLIT_LEVELS = 2

STAT_FIELDS = [
    T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("dirname", T.StringType()),
    T.StructField("atime", T.DoubleType()), T.StructField("ctime", T.DoubleType()), T.StructField("mtime", T.DoubleType()),
    T.StructField("ino", T.LongType()), T.StructField("dev", T.LongType()), T.StructField("nlink", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("type", T.StringType()),
]


def _clean(text: str) -> str:
    raw = os.fsencode(text)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return quote_from_bytes(raw, safe="/ !#$&'()+,:;=@[]~")


class _Part(InputPartition):
    """A root: a file, one directory's own entries, or a whole subtree."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options.get("paths", "[]"))
        self.filetype = options.get("filetype", "f")
        self.force = options.get("force", "false").lower() == "true"
        self.content = options.get("content", "false").lower() == "true"
        self.uncompress = options.get("uncompress", "false").lower() == "true"
        self.algos = [hasher_maker(a) for a in json.loads(options.get("algos", "[]"))]
        self.patterns = json.loads(options["patterns"]) if "patterns" in options else ignored_patterns()

    def _skip(self):
        if self.force or not self.patterns:
            return lambda text: False
        ignored = re.compile(ignored_regex(self.patterns, r"\Z"))
        return lambda text: ignored.search(text) is not None

    def partitions(self):
        skip, parts = self._skip(), []
        for root in self.roots:
            if not root or not os.path.exists(root):
                continue
            if os.path.isfile(root):
                if not skip(root):
                    parts.append(_Part(root, "file"))
                continue
            level = [os.path.abspath(root)]
            if skip(level[0]):
                continue
            for _ in range(SPLIT_LEVELS):
                following = []
                for d in level:
                    parts.append(_Part(d, "own"))
                    following += self._subdirs(d, skip)
                level = following
            parts += [_Part(d, "tree") for d in level]
        return parts or [_Part("", "none")]

    @staticmethod
    def _subdirs(d: str, skip) -> list[str]:
        try:
            with os.scandir(d) as entries:
                dirs = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
        except OSError:
            return []
        return [os.path.join(d, n) for n in dirs if not skip(n) and not skip(os.path.join(d, n))]

    def _paths(self, part: _Part) -> Iterator[str]:
        if part.kind == "file":
            yield part.path
            return
        skip = self._skip()
        todo = [part.path] if part.kind != "none" else []
        while todo:
            d = todo.pop()
            if self.filetype in ("f", "a"):
                try:
                    with os.scandir(d) as entries:
                        names = sorted(e.name for e in entries if not e.is_dir())
                except OSError:
                    names = []
                yield from (os.path.join(d, n) for n in names if not skip(n) and os.path.isfile(os.path.join(d, n)))
            if self.filetype in ("d", "a"):
                yield d
            if part.kind == "tree":
                todo += reversed(self._subdirs(d, skip))

    def read(self, part: _Part):
        for path in self._paths(part):
            try:
                s = os.stat(path)
                is_dir = os.path.isdir(path)
                hashes, size, data = [None] * len(self.algos), s.st_size, None
                if not is_dir and (self.algos or self.content):
                    hashes, size, data = self._digest(path, s.st_size)
            except OSError:
                continue
            row = (_clean(path), _clean(os.path.basename(path)), _clean(os.path.dirname(path)), s.st_atime, s.st_ctime, s.st_mtime,
                   _signed(s.st_ino), s.st_dev, s.st_nlink, size, "dir" if is_dir else "file", *hashes)
            yield (*row, data) if self.content else row

    def _digest(self, path: str, size: int):
        packed = self.uncompress and path.lower().endswith(".gz")
        states, kept, n = [make() for make in self.algos], [], 0
        with (gzip.open if packed else open)(path, "rb") as f:
            while chunk := f.read(CHUNK):
                n += len(chunk)
                for s in states:
                    s.update(chunk)
                if self.content:
                    kept.append(chunk)
        return [s.hexdigest() for s in states], n if packed else size, b"".join(kept) if self.content else None


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "fstree"

    def schema(self):
        algos = [T.StructField(a, T.StringType()) for a in json.loads(self.options.get("algos", "[]"))]
        data = [T.StructField("content", T.BinaryType())] if self.options.get("content", "false").lower() == "true" else []
        return T.StructType([*STAT_FIELDS, *algos, *data])

    def reader(self, schema):
        return _TreeReader(self.options)


def scan_tree(spark: SparkSession, paths: list[str], filetype: str = "f", force: bool = False, algos: list[str] = (),
              content: bool = False, uncompress: bool = False, patterns: list[str] | None = None) -> DataFrame:
    """Rows of files (f), directories (d) or both (a) beneath ``paths``, without
    what ``patterns`` ignore (those of the environment if not given)."""
    for a in algos:
        hasher_maker(a)  # ValueError if there is none
    patterns = ignored_patterns() if patterns is None else patterns
    spark.dataSource.register(TreeSource)
    options = {"paths": json.dumps(list(paths)), "filetype": filetype, "force": str(force), "algos": json.dumps(list(algos)),
               "content": str(content), "uncompress": str(uncompress), "patterns": json.dumps(list(patterns))}
    return spark.read.format("fstree").options(**options).load()

"""Session helpers: the shared folder, written tables that cut lineage, and
access to the cluster's file system."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is this machine, a folder of this
    process is made; on a cluster every executor would see another one.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="siltmark-"))
        base = "file://" + _own[0]
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed by ``release`` or when this process
    ends."""
    path = f"{shared_root(spark)}/siltmark/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def release() -> None:
    """Remove what has been written so far; results that were to be read from it
    must have been used up."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            drop_path(spark, path)
        elif path.startswith(("/", "file:")):  # the session has ended
            shutil.rmtree(urlparse(path).path, ignore_errors=True)


def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may be gone already
        pass
    for folder in _own:
        shutil.rmtree(folder, ignore_errors=True)


atexit.register(_at_exit)


def drop_path(spark: SparkSession, path: str) -> None:
    filesystem(spark, path).delete(hadoop_path(spark, path), True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and
    survives the loss of any executor. Partition columns are not kept."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@cache
def _path_class(jvm):
    return jvm.org.apache.hadoop.fs.Path


def hadoop_path(spark: SparkSession, path: str):
    return _path_class(spark._jvm)(path)


def filesystem(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


class Folder:
    """Small files of metadata in one folder, which never change once written.

    On a file system that is mounted here they are handled directly, as every
    call to the JVM takes its time; elsewhere by Hadoop's interface."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._fs = spark, filesystem(spark, path)
        self._path = self._fs.makeQualified(hadoop_path(spark, path)).toString()
        self._local = "/" + self._path[5:].lstrip("/") if self._path.startswith("file:") else None
        self._context = None

    def _at(self, name: str):
        return hadoop_path(self._spark, f"{self._path}/{name}")

    def names(self) -> list[str]:
        if self._local is not None:
            return os.listdir(self._local) if os.path.isdir(self._local) else []
        here = hadoop_path(self._spark, self._path)
        return [s.getPath().getName() for s in self._fs.listStatus(here)] if self._fs.exists(here) else []

    def has(self, name: str) -> bool:
        return os.path.exists(f"{self._local}/{name}") if self._local is not None else self._fs.exists(self._at(name))

    def read(self, name: str) -> bytes:
        if self._local is not None:
            with open(f"{self._local}/{name}", "rb") as f:
                return f.read()
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put_new(self, name: str, data: bytes) -> bool:
        """Write a file so that it appears whole or not at all; False, and
        nothing is changed, if there is one of that name."""
        tmp = f".{uuid.uuid4().hex}.tmp"
        if self._local is not None:
            os.makedirs(self._local, exist_ok=True)
            with open(f"{self._local}/{tmp}", "wb") as f:
                f.write(data)
            try:
                os.link(f"{self._local}/{tmp}", f"{self._local}/{name}")
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self._local}/{tmp}")
            return True
        out = self._fs.create(self._at(tmp), True)
        out.write(bytearray(data))
        out.close()
        jvm = self._spark._jvm
        if self._context is None:
            self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._spark._jsc.hadoopConfiguration())
        try:
            no_overwrite = self._spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self._context.rename(self._at(tmp), self._at(name), no_overwrite)
        except Exception as error:
            self._fs.delete(self._at(tmp), False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

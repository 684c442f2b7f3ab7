"""Queries of the hashing, manifest, cache and snapshot operators over the
driver's tables. Documents stand for files with contents, the table ``files``
for a cache of hashed files, and its newest row per path for a manifest."""

from __future__ import annotations

import gzip
import hashlib
import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.functions import paths as P
from siltmark.functions.hashes import HASHES, content_hash, text_hash
from siltmark.operators import cache, digests, manifests, trees
from siltmark.plans.data_queries import table
from siltmark.session import shared_path
from siltmark.sources import manifests as formats
from siltmark.sources.fstree import scan_tree

ALGOS = list(HASHES)
DIFF = ("vault-01", "vault-02")
DIFF_ROOT = "/srv/vault/prj_001"
GLOB = "/srv/*/prj_0[0-4]*/?*/[!x]*.m*"
SINCE = "2024-05-06T14:53:20+02:00"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark, d) -> DataFrame:
    path = F.concat(F.lit("/data/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), F.encode("text", "utf-8").alias("content"), F.col("doc_id").cast("double").alias("mtime"))


def newest(files: DataFrame) -> DataFrame:
    """A row per path: the one updated last, of these the one with the largest id."""
    row = F.max_by(F.struct("id", "mtime", "algo", "hash", "size", "inode", "updated_at"), F.struct(F.coalesce("updated_at", F.lit(-1.0)), "id"))
    return files.groupBy("path").agg(row.alias("r")).select("path", "r.*")


def manifest(spark, d, name: str = "files") -> DataFrame:
    rows = newest(table(spark, d, name)).withColumn("name", P.basename(F.col("path"))).withColumn("dirname", P.dirname(F.col("path")))
    return manifests.wide_form(rows, ["path", "name", "dirname", "mtime", "size"], ALGOS)


def _hash_query(algo: str):
    def run(spark, d):
        return documents(spark, d).select("doc_id", content_hash(F.col("content"), algo).alias("hash"))

    return run


for _algo in ALGOS:
    QUERIES[f"hash_{_algo}"] = _hash_query(_algo)


#: Texts whose hashes are published or easily made elsewhere.
VECTORS = ["", "abc", "hello, world\n", "The quick brown fox jumps over the lazy dog"]


@query
def hash_vectors(spark, d):
    """Every algorithm over the texts of ``VECTORS``."""
    texts = spark.createDataFrame([(t,) for t in VECTORS], "text string")
    pairs = F.array(*[F.struct(F.lit(a).alias("algo"), text_hash(F.col("text"), a).alias("hash")) for a in ALGOS])
    return texts.select("text", F.explode(pairs).alias("x")).select("text", "x.algo", "x.hash")


@query
def hash_xxh64_paths(spark, d):
    return table(spark, d, "files").select("id", text_hash(F.col("path"), "xxh64").alias("hash"))


# -- paths ----------------------------------------------------------------------

def _files(spark, d, *columns):
    return table(spark, d, "files").select("id", *columns)


@query
def stat_projection(spark, d):
    p = F.col("path")
    return documents(spark, d).select("path", P.basename(p).alias("name"), P.dirname(p).alias("dirname"), F.octet_length("content").cast("long").alias("size"), "mtime")


@query
def manifest_scan(spark, d):
    return documents(spark, d).select("path", F.octet_length("content").cast("long").alias("size"), content_hash(F.col("content"), "md5").alias("md5"))


@query
def path_basename_dirname(spark, d):
    return _files(spark, d, P.basename(F.col("path")).alias("name"), P.dirname(F.col("path")).alias("dirname"))


@query
def path_normalize(spark, d):
    winding = F.concat("path", F.lit("/.././/"), F.col("id").cast("string"), F.lit("/x/.."))
    return _files(spark, d, P.normal_path(winding).alias("normal"), P.relative_path(winding, "/srv/vault").alias("relative"))


@query
def path_uncompressed(spark, d):
    return _files(spark, d, P.uncompressed_path(F.col("path")).alias("path"))


@query
def path_output(spark, d):
    """Records as they are written when packed files are unpacked, here to ten times their size."""
    rows = manifest(spark, d).select("path", "name", "size", (F.col("size") * 10).alias("unpacked"))
    return manifests.uncompressed(rows, "unpacked").select("path", "name", "size")


@query
def path_is_subpath(spark, d):
    return _files(spark, d, P.is_below(F.col("path"), "/srv/vault/").alias("below"))


@query
def paths_equal(spark, d):
    theirs = table(spark, d, "files_replica").select("id", F.concat(F.lit("//"), F.col("path"), F.lit("/.")).alias("other")).distinct()
    return _files(spark, d, "path").join(theirs, "id").select("id", "other", P.same_path(F.col("path"), F.col("other")).alias("equal"))


@query
def format_bytes(spark, d):
    return _files(spark, d, P.format_bytes(F.col("size")).alias("text"))


@query
def format_result(spark, d):
    line = P.result_line(F.col("updated_at"), F.coalesce("inode", F.lit("None")), F.col("algo"), F.coalesce("hash", F.lit("None")), F.col("path"))
    return table(spark, d, "files").filter("updated_at is not null").select("id", line.alias("line"))


@query
def mhl_timestamp(spark, d):
    return _files(spark, d, P.utc_stamp(F.col("mtime")).alias("stamp"))


@query
def ignore_filter(spark, d):
    return _files(spark, d, P.is_ignored(F.col("path")).alias("ignored"))


@query
def walk_prune(spark, d):
    return table(spark, d, "files").filter(~P.is_pruned(F.col("path"), "/")).select("id", "path")


@query
def drop_falsy(spark, d):
    return manifests.present(manifest(spark, d), "xxh64").select("path", F.col("xxh64").alias("hash"))


# -- cache ----------------------------------------------------------------------

COLUMNS = ["path", "mtime", "algo", "hash", "size", "inode", "updated_at"]


@query
def cache_scan(spark, d):
    return _files(spark, d, *COLUMNS)


@query
def cache_ids(spark, d):
    return table(spark, d, "files").select("id")


@query
def cache_query_glob(spark, d):
    return cache.query(_files(spark, d, *COLUMNS), GLOB, "xxh64")


@query
def cache_query_exact(spark, d):
    files = _files(spark, d, *COLUMNS)
    return cache.query(files, files.agg(F.max("path")).first()[0])


@query
def cache_query_since(spark, d):
    return cache.query(_files(spark, d, *COLUMNS), "*", "md5", cache.since_seconds(spark, SINCE))


@query
def cache_lookup(spark, d):
    return cache.lookup(table(spark, d, "files_replica").select("id", *cache.KEY), table(spark, d, "files")).select("id", "path", "mtime", "algo", "cached_hash")


@query
def cache_has(spark, d):
    return cache.has(table(spark, d, "files_replica").select("id", *cache.KEY, "hash"), table(spark, d, "files")).select("id", "path")


@query
def cache_hit_split(spark, d):
    known, new = cache.split_known(table(spark, d, "files_replica").select("id", *cache.KEY), table(spark, d, "files"))
    return known.select("id", F.lit(True).alias("hit")).unionByName(new.select("id", F.lit(False).alias("hit"))).distinct()


@query
def cache_merge(spark, d):
    return cache.merge(table(spark, d, "files").select(*COLUMNS), table(spark, d, "files_replica").select(*COLUMNS))


@query
def cache_put(spark, d):
    rank = F.struct("updated_at", "hash", "size", "inode")
    return cache.new_entries(cache.first_written(table(spark, d, "files_replica").select(*COLUMNS), rank), table(spark, d, "files"))


@query
def cache_store(spark, d):
    """Put through the stored cache: what files, then the replica, leave there."""
    store = cache.HashCache(spark, shared_path(spark, "cache"))
    for name in ("files", "files_replica"):
        store.put(table(spark, d, name).select(*COLUMNS))
    return store.files().groupBy("algo").agg(F.count(F.lit(1)).alias("n"))


@query
def mtime_changed(spark, d):
    ours, theirs = newest(table(spark, d, "files")), newest(table(spark, d, "files_replica"))
    both = ours.join(theirs.select("path", F.col("mtime").alias("live")), "path")
    return both.filter(manifests.mtime_changed(F.col("mtime"), F.col("live"))).select("path", "mtime", "live")


# -- digests ----------------------------------------------------------------------

def _hashed(spark, d, algo="md5"):
    return documents(spark, d).select("path", content_hash(F.col("content"), algo).alias("hash"))


@query
def checksum_file(spark, d):
    return documents(spark, d).select("path", content_hash(F.col("content"), "sha256").alias("hash"), F.octet_length("content").cast("long").alias("size"))


@query
def folder_hash(spark, d):
    return digests.folder_hashes(documents(spark, d).withColumn("folder", F.substring_index("path", "/", 3)), algo="md5")


@query
def checksum_gen(spark, d):
    """Every directory beneath /data and every file, with its hash."""
    folders = digests.every_folder(documents(spark, d), "/data", algo="md5")
    return folders.select(F.col("folder").alias("path"), "hash").unionByName(_hashed(spark, d))


@query
def checksum_path(spark, d):
    """Files and their folders. A file's hash is taken from the manifest beside
    it where that knows the file's time (here those in English), else computed."""
    p = F.col("path")
    docs = documents(spark, d).withColumn("name", P.basename(p)).withColumn("dirname", P.dirname(p))
    beside = docs.filter(F.col("dirname").endswith("/en")).select(F.col("dirname").alias("folder"), F.col("name").alias("path"), "mtime", content_hash(F.col("content"), "md5").alias("md5"))
    files = manifests.sidecar_hashes(docs, beside, "md5").select("path", F.coalesce("sidecar_hash", content_hash(F.col("content"), "md5")).alias("hash"))
    folders = digests.folder_hashes(docs, "dirname", algo="md5").select(F.col("dirname").alias("path"), "hash")
    return files.unionByName(folders)


@query
def composite_hash(spark, d):
    return digests.composite_hash(_hashed(spark, d), algo="md5")


@query
def dedupe_paths(spark, d):
    return digests.duplicates(_hashed(spark, d))


@query
def dedupe_overlap(spark, d):
    rows = _hashed(spark, d)
    return digests.duplicates(rows.unionByName(rows.filter(P.is_below(F.col("path"), "/data/askbench"))))


@query
def summary(spark, d):
    return digests.summary(table(spark, d, "files"))


# -- manifests --------------------------------------------------------------------

@query
def dedupe_manifests(spark, d):
    return manifests.dedupe(manifest(spark, d), manifest(spark, d, "files_replica"), "xxh64", "/mnt/a", "/mnt/b")


@query
def verify_manifest(spark, d):
    return manifests.verify(manifest(spark, d), manifest(spark, d, "files_replica"))


@query
def verify_manifest_gz_fallback(spark, d):
    recorded = manifest(spark, d).withColumn("path", P.uncompressed_path(F.col("path")))
    return manifests.verify(recorded, manifest(spark, d, "files_replica"), gzip_fallback=True)


@query
def compare_manifests(spark, d):
    return manifests.compare(manifest(spark, d), manifest(spark, d, "files_replica"), "xxh64")


@query
def sidecar_lookup(spark, d):
    theirs = manifest(spark, d, "files_replica").select(F.col("dirname").alias("folder"), F.col("name").alias("path"), "mtime", "xxh64")
    return manifests.sidecar_hashes(manifest(spark, d).select("path", "dirname", "name", "mtime"), theirs, "xxh64").select("path", "sidecar_hash")


@query
def json_roundtrip(spark, d):
    out = shared_path(spark, "json")
    formats.write_json(manifest(spark, d).drop("null"), out)
    return formats.read_json_lines(spark, out).select("path", "name", "mtime", "size", "md5", "xxh64", "c4")


@query
def txt_roundtrip(spark, d):
    out = shared_path(spark, "txt")
    formats.write_txt(manifests.present(manifest(spark, d), "xxh64").select("path", "xxh64"), out)
    return formats.read_txt(spark, out)


@query
def mhl_roundtrip(spark, d):
    out = shared_path(spark, "mhl")
    formats.write_xml(manifest(spark, d).select("path", "mtime", "size", "md5"), out)
    return formats.read_xml(spark, out).select("path", "lastmodificationdate", "size", "md5")


@query
def read_gz(spark, d):
    out = shared_path(spark, "gz")
    lines = table(spark, d, "raw_lines").repartition(1).sortWithinPartitions("line_id")
    lines.select("line").write.option("compression", "gzip").text(out)
    return scan_tree(spark, [out.removeprefix("file://")], algos=["md5"], uncompress=True).filter("name like '%.gz'").select("size", F.col("md5").alias("hash"))


@query
def json_whole(spark, d):
    """A manifest of another layout, all records in one line, parsed whole."""
    out = shared_path(spark, "json")
    fields = ["name", "mtime", "size", "md5", "xxh64", "c4"]
    record = F.struct(F.col("path").alias("key"), F.struct(*fields).alias("value"))
    by_part = manifest(spark, d).groupBy(F.pmod(F.xxhash64("path"), F.lit(64)).alias("part")).agg(F.map_from_entries(F.collect_list(record)).alias("m"))
    by_part.select("part", F.to_json("m").alias("value")).write.partitionBy("part").text(out)  # an object per file
    return formats.read_json_whole(spark, out).select("path", *fields)


#: The tree ``fs_walk`` makes: files and what they hold.
TREE = {"a.txt": b"one", "_b.txt": b"", ".hidden/c d.txt": "d\u00fcn".encode(), "e/f/g.bin": b"\0" * 1000, "e/f/old.bak": b"x", "e/.git/config": b"x", "e/build/h.txt": b"x", "e/i.txt.gz": gzip.compress(b"one", mtime=0)}


@query
def fs_walk(spark, d):
    """Files and folders of a tree, unpacked where they are packed, without what is ignored."""
    root = urlparse(shared_path(spark, "tree")).path
    for name, data in TREE.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    rows = scan_tree(spark, [root], filetype="a", algos=["md5"], uncompress=True)
    path = F.coalesce(F.nullif(F.substr("path", F.lit(len(root) + 2)), F.lit("")), F.lit("."))
    name = F.when(path == ".", ".").otherwise(F.col("name"))
    return rows.select(path.alias("path"), name.alias("name"), "type", F.when(F.col("type") == "file", F.col("size")).alias("size"), "md5",
                       (F.col("mtime") > 0).alias("has_time"), (F.col("ino") != 0).alias("has_inode"))


@query
def uncompress_then_plain(spark, d):
    """A packed file hashed unpacked, then as it is, with one cache: what each run says."""
    root = urlparse(shared_path(spark, "packed")).path
    os.makedirs(root)
    with open(f"{root}/a.txt.gz", "wb") as f:
        f.write(gzip.compress(b"hello", mtime=0))
    store, out = cache.HashCache(spark, shared_path(spark, "cache")), []
    for step, unpack in enumerate([True, False, False]):
        rows = trees.hash_tree(spark, [root], "md5", cache=store, uncompress=unpack)
        out += [(step, r["md5"] == hashlib.md5(b"hello").hexdigest(), r["cached"]) for r in rows.collect()]
        rows.unpersist()
    return spark.createDataFrame(out, "step int, of_contents boolean, cached boolean")


# -- snapshots ----------------------------------------------------------------------

def _members(spark, d, name: str) -> DataFrame:
    sid = table(spark, d, "snapshots").filter(F.col("name") == name).select(F.col("id").alias("snapshot_id"))
    ids = table(spark, d, "snapshot_files").join(sid, "snapshot_id").select(F.col("file_id").alias("id")).distinct()
    return table(spark, d, "files").join(ids, "id")


def _diff(spark, d, same_algo=False):
    return cache.changes_between(*[_members(spark, d, n) for n in DIFF], ["id"], same_algo)


@query
def snapshot_membership(spark, d):
    names = table(spark, d, "snapshots").select(F.col("id").alias("snapshot_id"), "name")
    links = table(spark, d, "snapshot_files").join(names, "snapshot_id").select("name", F.col("file_id").alias("id")).distinct()
    return links.join(table(spark, d, "files").select("id", "path", "algo", "hash"), "id").select("name", "path", "algo", "hash")


@query
def snapshot_list(spark, d):
    return cache.listed(table(spark, d, "snapshots")).select("name", "path", "created_at")


@query
def snapshot_diff_all(spark, d):
    return _diff(spark, d)


@query
def snapshot_diff_same_algo(spark, d):
    return _diff(spark, d, same_algo=True)


@query
def snapshot_diff_added(spark, d):
    return _diff(spark, d).filter("status = 'added'").select("path")


@query
def snapshot_diff_removed(spark, d):
    return _diff(spark, d).filter("status = 'removed'").select("path")


@query
def snapshot_diff_changed(spark, d):
    return _diff(spark, d).filter("status = 'changed'").select("path")


@query
def diff_under_root(spark, d):
    return cache.below(_diff(spark, d), DIFF_ROOT)


@query
def snapshot_replace(spark, d):
    """Two snapshots recorded, the first replaced, one link added twice; then
    merged into a cache that knows one of the names."""
    one, two = (cache.HashCache(spark, shared_path(spark, "cache")) for _ in range(2))
    rows = newest(table(spark, d, "files"))
    one.put(rows.select(*COLUMNS))
    md5, crc = (rows.filter(F.col("algo") == a) for a in ("md5", "crc32"))
    one.snapshot("a", "/", rows, now=1.0)
    one.snapshot("a", "/", md5, now=2.0)
    one.snapshot("b", "/srv", crc, now=3.0)
    one.link("b", crc)
    two.snapshot("b", "/other", rows.limit(0), now=4.0)
    two.merge(one, now=5.0)
    links = two.links().groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))
    return two.snapshots().join(links.withColumnRenamed("snapshot", "name"), "name", "left").fillna(0).select("name", "path", "created_at", "n")

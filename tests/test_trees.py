"""Trees of files, manifests, the cache, snapshots and the command line."""

import gzip
import hashlib
import json
import os
import xml.etree.ElementTree as ET

import pytest
import xxhash
from pyspark.sql import functions as F

from siltmark import cli
from siltmark.functions.hashes import HASHES
from siltmark.operators import cache, digests, manifests, trees
from siltmark.operators.versioned import VersionedTable
from siltmark.sources import manifests as formats
from siltmark.sources.fstree import scan_tree
from siltmark.streaming import ingest


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    write(root, {"a.txt": "foo", "b.txt": "bar", "c.txt": "foo", "nested/d.txt": "foo", "nested/e.txt": "bar", "nested/deep/er/f.txt": "", "_u/.hidden": "h",
                 ".git/config": "x", "build/sub/x": "y", "nested/dist/y": "z", "skip.tmp": "t", "odd 'name' \"q\" \\b.txt": "q", "z.txt.gz": gzip.compress(b"zipped")})
    return root


def names(df, root):
    return sorted(os.path.relpath(r["path"], root) for r in df.collect())


KEPT = sorted(["a.txt", "b.txt", "c.txt", "nested/d.txt", "nested/e.txt", "nested/deep/er/f.txt", "_u/.hidden", "odd 'name' \"q\" \\b.txt", "z.txt.gz"])


def test_scan(spark, tree):
    root = str(tree)
    assert names(scan_tree(spark, [root]), root) == KEPT
    assert len(names(scan_tree(spark, [root], force=True), root)) == 13
    assert names(scan_tree(spark, [root], filetype="d"), root) == [".", "_u", "nested", "nested/deep", "nested/deep/er"]
    assert len(names(scan_tree(spark, [root], filetype="a"), root)) == len(KEPT) + 5
    assert names(scan_tree(spark, [root + "/a.txt", root + "/skip.tmp", "/no/such", ""], filetype="d"), root) == ["a.txt"]
    assert scan_tree(spark, [str(tree / ".git")]).count() == 0  # an ignored root
    s = os.stat(tree / "a.txt")
    row = scan_tree(spark, [root + "/a.txt"], algos=["md5", "c4"], content=True).first()
    assert (row["mtime"], row["size"], row["ino"], row["type"]) == (s.st_mtime, 3, s.st_ino, "file")
    assert row["md5"] == hashlib.md5(b"foo").hexdigest() and bytes(row["content"]) == b"foo"
    with pytest.raises(ValueError):
        scan_tree(spark, [root], algos=["nope"])


def test_gzip_files_count_as_what_they_hold(spark, tree):
    row = scan_tree(spark, [str(tree / "z.txt.gz")], algos=["md5"], uncompress=True).first()
    assert row["size"] == 6 and row["md5"] == hashlib.md5(b"zipped").hexdigest()
    out = manifests.uncompressed(spark.createDataFrame([("w/sample.txt.gz", "sample.txt.gz", 999, 22)], "path string, name string, size long, n long"), "n").first()
    assert (out["path"], out["name"], out["size"]) == ("w/sample.txt", "sample.txt", 22)


def test_unreadable_and_strange_names(spark, tmp_path):
    write(tmp_path, {"ok": "1", "nl\nx": "2"})
    (tmp_path / "broken").symlink_to(tmp_path / "nowhere")
    with open(os.fsencode(tmp_path) + b"/\xff\xfe", "wb") as f:
        f.write(b"3")
    assert len(scan_tree(spark, [str(tmp_path)], algos=["md5"]).collect()) == 3


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["hash"], []).append(os.path.basename(r["path"]))
    return sorted(sorted(v) for v in out.values())


def test_duplicate_files(spark, tree):
    at = lambda *ns: [str(tree / n) for n in ns]
    dupes = lambda *ns: groups(trees.duplicate_files(spark, at(*ns), "md5"))
    assert dupes("a.txt", "b.txt") == [] and dupes("a.txt", "nested/e.txt") == []
    assert dupes("a.txt", "c.txt") == [["a.txt", "c.txt"]]
    assert dupes("a.txt", "a.txt") == [["a.txt", "a.txt"]]
    assert groups(trees.duplicate_files(spark, [str(tree), "/no/such", None], "md5")) == [["a.txt", "c.txt", "d.txt"], ["b.txt", "e.txt"]]
    assert trees.duplicate_files(spark, []).count() == 0


def test_folder_and_composite_hashes(spark, tree):
    data = b"".join((tree / n).read_bytes() for n in KEPT)
    assert trees.folder_hash(spark, str(tree), "md5") == hashlib.md5(data).hexdigest()
    assert trees.path_hash(spark, str(tree / "a.txt"), "md5") == hashlib.md5(b"foo").hexdigest()
    assert trees.path_hash(spark, str(tree / "a.txt"), "md5", "d") is None and trees.path_hash(spark, str(tree), filetype="f") is None
    out = {os.path.relpath(r["path"], tree): r["hash"] for r in trees.path_hashes(spark, str(tree), "md5", "a").collect()}
    assert out["nested"] == hashlib.md5(b"foobar").hexdigest()
    assert out["nested/d.txt"] == hashlib.md5(b"foo").hexdigest() and len(out) == len(KEPT) + 5
    assert trees.path_hashes(spark, str(tree), "null").count() == 0
    assert trees.path_hashes(spark, str(tree / "b.txt"), "md5", recursive=False).first()["hash"] == hashlib.md5(b"bar").hexdigest()
    entries = spark.createDataFrame([("file2", "h2"), ("file1", "h1"), ("file1", "h0"), (None, "x")], "path string, hash string")
    assert digests.composite_hash(entries).first()[0] == xxhash.xxh64_hexdigest("file1:h0\nfile1:h1\nfile2:h2")
    assert [r[0] for r in digests.composite_hash(entries.limit(0)).collect()] == [xxhash.xxh64_hexdigest("")]


def test_a_folder_of_many_batches(spark):
    df = spark.range(30_000).select(F.lit("f").alias("folder"), F.format_string("%06d", "id").alias("path"), F.encode(F.col("id").cast("string"), "utf-8").alias("content")).repartition(5)
    assert digests.folder_hashes(df, algo="md5").collect()[0]["hash"] == hashlib.md5("".join(map(str, range(30_000))).encode()).hexdigest()


RECORDS = [("/a/b/c1", "c1", 1.5, 3, "aa"), ('/a/"q" \\x/c2', "c2", 1700000000.123456, None, None), ("d e/ü", "ü", None, 0, "")]


def record_frame(spark, rows=RECORDS):
    return spark.createDataFrame(rows, "path string, name string, mtime double, size long, md5 string")


def whole(out):
    if os.path.isfile(out):
        return open(out).read()
    return "".join(open(f"{out}/{p}").read() for p in sorted(os.listdir(out)) if p.startswith("part"))


@pytest.mark.parametrize("single", [True, False])
def test_json_manifests(spark, tmp_path, single):
    out = f"{tmp_path}/m.json"
    formats.write_manifest(record_frame(spark), out, single=single)
    assert os.path.isfile(out) == single and os.listdir(tmp_path) != []
    assert json.loads(whole(out)) == {p: {k: v for k, v in (("name", n), ("mtime", m), ("size", s), ("md5", h)) if v is not None} for p, n, m, s, h in RECORDS}
    for df in (formats.read_json_lines(spark, out), *([formats.read_manifest(spark, out)] if single else [])):
        assert sorted(tuple(r) for r in df.select("path", "name", "mtime", "size", "md5").collect()) == sorted(RECORDS)
    formats.write_json(record_frame(spark, []), out, single=True)
    assert json.loads(whole(out)) == {} and [p for p in os.listdir(tmp_path) if not p.startswith(".")] == ["m.json"]
    assert formats.read_json(spark, out).count() == 0


def test_foreign_json(spark, tmp_path):
    (tmp_path / "m.json").write_text('{\n "x": {"md5": "1",\n "other": 5}, "y": {"size": 7}, "x": {"md5": "2"}}')
    (tmp_path / "bad.json").write_text("{ not json")
    assert sorted((r["path"], r["md5"], r["size"]) for r in formats.read_manifest(spark, f"{tmp_path}/m.json").collect()) == [("x", "2", None), ("y", None, 7)]
    assert formats.read_json(spark, f"{tmp_path}/bad.json").count() == 0
    assert formats.read_json(spark, f"{tmp_path}/m.json", extra={"other": "bigint"}).filter("other = 5").count() == 0  # the last x has none
    with pytest.raises(ValueError):
        formats.read_manifest(spark, "m.csv")


def test_text_manifests(spark, tmp_path):
    (tmp_path / "m.txt").write_text("aa /p/one two\nbb\n  cc /q  \ndd /p/one two\n\n \n")
    assert sorted(tuple(r) for r in formats.read_txt(spark, f"{tmp_path}/m.txt", "md5").collect()) == [("/p/one two", "dd"), ("/q", "cc")]
    formats.write_manifest(record_frame(spark, RECORDS[:1]), f"{tmp_path}/out.txt")
    assert formats.read_txt(spark, f"{tmp_path}/out.txt", "md5").first()[:] == ("/a/b/c1", "aa")
    with pytest.raises(ValueError):
        formats.write_txt(record_frame(spark).select("path"), f"{tmp_path}/x.txt")


def test_xml_manifests(spark, tmp_path):
    out = f"{tmp_path}/m.mhl"
    formats.write_manifest(record_frame(spark, [(f"{tmp_path}/in & <out>", "n", 1700000000.9, 5, "aa"), ("/z", "z", 0.0, None, None)]), out, single=True)
    root = ET.parse(out).getroot()
    assert root.tag == "hashlist" and root.get("version") == "1.1"
    first = next(h for h in root if h.findtext("md5"))
    assert [e.tag for e in first] == ["md5", "size", "lastmodificationdate", "name", "hashdate", "file"]
    assert first.findtext("lastmodificationdate") == "2023-11-14T22:13:20Z"
    rows = sorted((r["path"], r["size"], r["md5"]) for r in formats.read_manifest(spark, out).collect())
    assert rows == [("/z", 0, ""), ("in & <out>", 5, "aa")]


def test_verify_and_compare_trees(spark, tree, tmp_path):
    out = f"{tmp_path}/hash.json"
    trees.hash_tree(spark, [str(tree)], "md5", out, start=str(tree)).unpersist()
    recorded = formats.read_manifest(spark, out)
    assert sorted(r["path"] for r in recorded.collect()) == sorted(k.replace("\\", "/") for k in KEPT)
    assert trees.verify_tree(recorded, str(tree)).count() == 0
    write(tree, {"a.txt": "changed", "b.txt": "bar"})
    os.utime(tree / "a.txt", (1, 1))
    os.utime(tree / "b.txt", (1, 1))  # touched, same content
    (tree / "c.txt").unlink()
    assert [tuple(r) for r in trees.verify_tree(recorded, str(tree)).collect()] == [("md5", hashlib.md5(b"changed").hexdigest(), str(tree / "a.txt"))]
    packed = spark.createDataFrame([("z.txt", 0.0, hashlib.md5(b"zipped").hexdigest()), ("gone", 0.0, "x")], "path string, mtime double, md5 string")
    assert trees.verify_tree(packed, str(tree), uncompress=True).count() == 0
    write(tree, {"z.txt.gz": gzip.compress(b"other")})
    assert [tuple(r) for r in trees.verify_tree(packed, str(tree), uncompress=True).collect()] == [("md5", hashlib.md5(b"other").hexdigest(), str(tree / "z.txt"))]


def test_compare_is_null_safe(spark):
    a = [("p1", "n1", "h"), ("p2", "n2", None), ("p3", "n3", "h3"), ("p4", None, None), ("p5", "n5", "x")]
    b = [("p1", "zz", "h"), ("q2", "n2", None), ("p3", "n3", "other"), ("q4", None, None)]
    frame = lambda rows: spark.createDataFrame(rows, "path string, name string, md5 string")
    assert sorted(tuple(r) for r in manifests.compare(frame(a), frame(b), "md5").collect()) == [("md5", "h3", "p3"), ("md5", "x", "p5")]


def test_dedupe_of_manifests_uses_live_hashes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, md5 string")
    t, s = frame([("a", "1"), ("b", "2"), ("c", ""), ("d", None), ("e", "5")]), frame([("a", "1"), ("b", "x"), ("c", ""), ("d", None), ("f", "5")])
    assert [tuple(r) for r in manifests.dedupe(t, s, "md5", "/t", "/s/").collect()] == [("/t/a", "/s/a")]
    misses = spark.createDataFrame([("md5", "2", "b"), ("xxh64", "9", "a")], "algo string, hash string, path string")
    assert sorted(r["target"] for r in manifests.dedupe(t, s, "md5", source_misses=misses).collect()) == ["a", "b"]


def test_sidecar_needs_the_same_time(spark):
    entries = spark.createDataFrame([("/d/a", "/d", "a", 1.0), ("/d/b", "/d", "b", 2.0)], "path string, dirname string, name string, mtime double")
    side = spark.createDataFrame([("/d", "a", 1.0, "h"), ("/d", "b", 9.0, "h")], "folder string, path string, mtime double, md5 string")
    assert {r["name"]: r["sidecar_hash"] for r in manifests.sidecar_hashes(entries, side, "md5").collect()} == {"a": "h", "b": None}


def entries(spark, rows):
    return spark.createDataFrame(rows, cache.FILES)


def test_first_write_wins(spark, tmp_path):
    store = cache.HashCache(spark, f"file://{tmp_path}/c")
    store.put(entries(spark, [("p", 1.0, "sha256", "hash", 1, "i", 5.0), ("p", 1.0, "sha256", "late", 1, "i", 6.0)]))
    store.put(entries(spark, [("p", 1.0, "sha256", "new", 1, "i", 1.0), ("p", 2.0, "sha256", "h2", 1, "i", 7.0)]))
    assert store.get("p", 1.0, "sha256") == "hash" and store.get("p", 2.0, "sha256") == "h2" and store.get("p", 3.0, "md5") is None
    assert cache.has(entries(spark, [("p", 1.0, "sha256", "hash", 1, "i", 0.0), ("p", 1.0, "sha256", "no", 1, "i", 0.0)]), store.files()).count() == 1
    q = lambda *a: sorted(r["mtime"] for r in cache.query(store.files(), *a).collect())
    assert q("p") == [1.0, 2.0] and q("[o-q]", "sha256", 6.0) == [2.0] and q("p", "md5") == [] and q("P*") == []
    assert cache.since_seconds(spark, "1970-01-02") == 86400.0 and cache.since_seconds(spark, "1970-01-01T01:00:00+01:00") == 0.0
    with pytest.raises(ValueError):
        cache.since_seconds(spark, "yesterday")


def test_snapshots(spark, tmp_path):
    store = cache.HashCache(spark, f"file://{tmp_path}/c")
    first = [("/r/a", 1.0, "md5", "1", 1, "i", 1.0), ("/r/b", 1.0, "md5", "2", 1, "i", 1.0), ("/r/c", 1.0, "md5", "3", 1, "i", 1.0), ("/r/t", 1.0, "md5", "4", 1, "i", 1.0)]
    second = [first[0], ("/r/b", 2.0, "md5", "22", 1, "i", 2.0), ("/r/t", 2.0, "md5", "4", 1, "i", 2.0), ("/r/n/d", 2.0, "md5", "5", 1, "i", 2.0)]
    store.put(entries(spark, first))
    store.put(entries(spark, second))
    store.snapshot("one", "/r", entries(spark, first), now=1.0)
    store.snapshot("two", "/r", entries(spark, second), now=2.0)
    diff = lambda *a, **k: sorted(tuple(r) for r in store.diff(*a, **k).collect())
    assert diff("one", "two") == [("added", "/r/n/d"), ("changed", "/r/b"), ("removed", "/r/c")]
    assert [tuple(r) for r in cache.below(store.diff("one", "two"), "/r/n").collect()] == [("added", "/r/n/d")]
    assert diff("two", "two") == []
    store.link("one", entries(spark, first[:1]))
    assert store.members("one").count() == 4
    store.snapshot("one", "/q", entries(spark, first[:1]), now=3.0)
    assert store.members("one").count() == 1
    with pytest.raises(ValueError):
        store.diff("one", "two")
    assert len(diff("one", "two", force=True)) == 3
    with pytest.raises(ValueError):
        store.diff("one", "none")
    assert [r["name"] for r in cache.listed(store.snapshots()).collect()] == ["one", "two"]
    store.drop_snapshot("none")
    store.drop_snapshot("two")
    assert store.members("two").count() == 0 and store.snapshots().count() == 1 and store.files().count() == 7
    other = cache.HashCache(spark, f"file://{tmp_path}/d")
    other.snapshot("one", "/kept", entries(spark, []), now=9.0)
    other.merge(store, now=10.0)
    assert other.snapshots().first()["path"] == "/kept" and other.links().count() == 0
    assert {r["updated_at"] for r in other.files().collect()} == {10.0}


def test_diff_across_algorithms(spark):
    rows = lambda *rs: entries(spark, [(p, m, a, h, 1, "i", 1.0) for p, m, a, h in rs])
    one, two = rows(("p", 1.0, "md5", "1"), ("q", 1.0, "md5", None)), rows(("p", 1.0, "md5", "1"), ("p", 1.0, "crc32", "2"), ("q", 2.0, "md5", "x"))
    assert [tuple(r) for r in cache.changes_between(one, two, cache.KEY).collect()] == [("changed", "p")]
    assert [tuple(r) for r in cache.changes_between(one, two, cache.KEY, same_algo=True).collect()] == [("added", "p")]


def test_hashing_reuses_the_cache(spark, tree, tmp_path):
    store = cache.HashCache(spark, f"file://{tmp_path}/c")
    run = lambda **k: {os.path.relpath(r["path"], tree): (r["cached"], r["md5"]) for r in trees.hash_tree(spark, [str(tree)], "md5", cache=store, **k).collect()}
    first = run(snapshot="s1")
    assert set(first) == set(KEPT) and not any(c for c, _ in first.values())
    write(tree, {"a.txt": "new text"})
    os.utime(tree / "a.txt", (5, 5))
    second = run(snapshot="s2")
    assert {n for n, (c, _) in second.items() if not c} == {"a.txt"} and second["b.txt"][1] == first["b.txt"][1]
    assert store.members("s1").count() == store.members("s2").count() == len(KEPT)  # reused files are linked too
    assert [tuple(r) for r in store.diff("s1", "s2").collect()] == [("changed", str(tree / "a.txt"))]
    assert not any(c for c, _ in run(force=True).values())
    with pytest.raises(ValueError):
        trees.hash_tree(spark, [str(tree)], "nope")


def test_command_line(spark, tree, tmp_path, capsys, monkeypatch):
    db, out = f"file://{tmp_path}/db", f"{tmp_path}/m.json"
    say = lambda *a: (cli.main([*a, "--db", db], spark), capsys.readouterr().out)
    code, text = say(str(tree), "-a", "md5", "-o", out, "--snapshot", "s1", "-s", "-v")
    assert code == 0 and f"files: {len(KEPT)}" in text and hashlib.md5(b"foo").hexdigest() in text
    assert say(str(tree / "a.txt"), "-a", "md5", "--cache")[1].rstrip().endswith("(cached)")
    assert say("-q", str(tree) + "/*.txt", "-a", "md5")[1].count("\n") == 7
    write(tree, {"a.txt": "new"})
    os.utime(tree / "a.txt", (5, 5))
    say(str(tree), "-a", "md5", "--snapshot", "s2")
    assert say("--diff", "s1", "s2")[1] == f"~ {tree}/a.txt\n" and say("--diff", "s1", "s2", "-r", "/else")[1] == ""
    assert say("--list-snapshots")[1].count("\n") == 2
    assert say("--verify", out)[1] == f"md5 {tree}/a.txt\n"
    assert say("--verify", out, out)[1] == "" and say("--verify", "a", "b", "c")[0] == 2
    monkeypatch.chdir(tmp_path)
    assert say("--verify") == (0, "file not found: hash.json\n")
    assert say("--merge", db)[0] == 0 and say("--update-cache")[0] == 0
    assert say("/no/such")[0] == 2 and say(str(tree), "-a", "nope")[0] == 2 and say("--diff", "s1", "none")[0] == 2
    beside = lambda *a: (lambda x: (x.outfile, x.root, x.paths))(cli.parser().parse_args(list(a)))
    assert beside("-or", "d/x.json", "p") == ("d/x.json", "d", ["p"]) and beside("p", "-or", "x.json") == ("x.json", ".", ["p"])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.txt").write_text("foo")
    monkeypatch.chdir(tmp_path / "sub")
    assert say("-a", "md5", "-o", f"{tmp_path}/cwd.json")[0] == 0  # no path is the current folder
    assert [r["md5"] for r in formats.read_manifest(spark, f"{tmp_path}/cwd.json").collect()] == [hashlib.md5(b"foo").hexdigest()]
    monkeypatch.setenv("SILTMARK_IGNORE", "*.txt")
    assert "files: 0" in say("-a", "md5", "-s")[1]
    monkeypatch.delenv("SILTMARK_IGNORE")
    monkeypatch.setenv("SILTMARK_X", "maybe")
    assert cli.env_bool("SILTMARK_X", True) and not cli.env_bool("SILTMARK_Y", False)


def test_streamed_batches_are_added_once(spark, tmp_path):
    store = cache.HashCache(spark, f"file://{tmp_path}/c")
    batch = lambda n: entries(spark, [(f"p{n}", 1.0, "md5", "h", 1, "i", float(n))])
    assert ingest.put_batch(store, batch(0), 0, "s") and ingest.put_batch(store, batch(1), 1, "s")
    assert not ingest.put_batch(store, batch(1), 1, "s") and ingest.put_batch(store, batch(1), 1, "t")
    src = f"{tmp_path}/src"
    for n in (2, 3, 2):
        batch(n).write.mode("append").parquet(src)
        stream = spark.readStream.schema(cache.FILES).parquet(src)
        q = ingest.stream_into(stream, store, f"{tmp_path}/check")
        q.awaitTermination()
    assert sorted(r["path"] for r in store.files().collect()) == ["p0", "p1", "p2", "p3"]


def test_summary(spark):
    out = digests.summary(spark.createDataFrame([(1 << 20,), (None,)], "size long"), seconds=2.0).first()
    assert (out["files"], out["bytes"], out["files_per_s"], out["mb_per_s"]) == (2, 1 << 20, 1.0, 0.5)
    assert digests.summary(spark.createDataFrame([], "size long")).first()["bytes"] == 0


def test_long_and_wide_forms(spark):
    rows = spark.createDataFrame([("p", "md5", "1"), ("q", "c4", None)], "path string, algo string, hash string")
    wide = manifests.wide_form(rows, ["path"], list(HASHES))
    assert [tuple(r) for r in manifests.long_form(wide).collect()] == [("p", "md5", "1")]


def test_unpacked_hashes_stay_out_of_the_cache(spark, tree, tmp_path):
    store = cache.HashCache(spark, f"file://{tmp_path}/c")
    packed = hashlib.md5((tree / "z.txt.gz").read_bytes()).hexdigest()
    run = lambda **k: {os.path.basename(r["path"]): (r["md5"], r["cached"]) for r in trees.hash_tree(spark, [str(tree)], "md5", cache=store, **k).collect()}
    assert run(uncompress=True, snapshot="s")["z.txt.gz"] == (hashlib.md5(b"zipped").hexdigest(), False)
    assert store.files().count() == 0 and store.snapshots().count() == 0
    assert run()["z.txt.gz"] == (packed, False) and run()["z.txt.gz"] == (packed, True)
    assert run(uncompress=True)["z.txt.gz"] == (hashlib.md5(b"zipped").hexdigest(), False)


def test_put_computes_again_when_it_loses_a_race(spark, tmp_path, monkeypatch):
    one, two = (cache.HashCache(spark, f"file://{tmp_path}/c") for _ in range(2))
    row = lambda value: entries(spark, [("p", 1.0, "md5", value, 1, "i", 1.0)])
    write_files, raced = VersionedTable.write_files, []

    def write_then_lose(table, df):
        files = write_files(table, df)
        if not raced:
            raced.append(True)
            two.put(row("first"))
        return files

    monkeypatch.setattr(VersionedTable, "write_files", write_then_lose)
    one.put(row("second"))
    assert [(r["path"], r["hash"]) for r in one.files().collect()] == [("p", "first")]


def test_a_snapshot_appears_with_its_last_commit(spark, tmp_path, monkeypatch):
    store = cache.HashCache(spark, f"file://{tmp_path}/c")
    rows = entries(spark, [("/r/a", 1.0, "md5", "1", 1, "i", 1.0), ("/r/b", 1.0, "md5", "2", 1, "i", 1.0)])
    store.put(rows)
    store.snapshot("s", "/r", rows, now=1.0)

    def crash(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.tables["snapshots"], "delete", crash)
        for name in ("s", "new"):
            with pytest.raises(OSError):
                store.snapshot(name, "/r", rows.limit(1), now=2.0)
    assert store.members("s").count() == 2 and store.members("new").count() == 0 and store.links().count() == 2
    other = cache.HashCache(spark, f"file://{tmp_path}/d")
    with monkeypatch.context() as m:
        m.setattr(other.tables["snapshots"], "append", crash)
        with pytest.raises(OSError):
            other.merge(store, now=3.0)
    assert other.links().count() == 0
    other.merge(store, now=4.0)
    assert other.links().count() == 2 and other.members("s").count() == 2
    with pytest.raises(ValueError):
        store.link("unknown", rows)


def test_json_of_either_layout(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{\n    "a": {"md5": "1"},\n    "b {": {"md5": "2", "size": 5}\n}\n')
    (tmp_path / "spread.json").write_text('{\n    "a": {"md5": "1",\n "size": 3},\n    "b": {"md5": "2"}\n}\n')
    (tmp_path / "pair.json").write_text('{\n"a": {"md5": "1"}, "b": {"md5": "2"}\n}\n')
    plans = {}
    for name in ("lines", "spread", "pair"):
        df = formats.read_manifest(spark, f"{tmp_path}/{name}.json")
        assert sorted(r["md5"] for r in df.collect()) == ["1", "2"]
        plans[name] = "monotonically_increasing_id" in df._jdf.queryExecution().toString()
    assert plans == {"lines": True, "spread": False, "pair": False}


def test_folder_hashes_of_files_sort_paths_only(spark, tree):
    files = scan_tree(spark, [str(tree)])
    plan = digests.every_folder(files, str(tree), content=None, algo="md5")._jdf.queryExecution().executedPlan().toString()
    assert "binary" not in plan and "content" not in plan
    nested = {r["path"]: r["hash"] for r in trees.path_hashes(spark, str(tree), "md5", "d").collect()}
    joined = b"".join((tree / n).read_bytes() for n in sorted(KEPT))
    assert nested[str(tree)] == hashlib.md5(joined).hexdigest() == trees.folder_hash(spark, str(tree), "md5")


def test_shared_folder_on_a_cluster_must_be_named(spark, monkeypatch):
    from types import SimpleNamespace

    from siltmark.session import shared_root

    sc = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_root(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: None)))
    assert shared_root(spark)


def test_progress_is_shown_on_a_terminal(spark):
    import io
    import time

    class Terminal(io.StringIO):
        def isatty(self):
            return True

    terminal, plain = Terminal(), io.StringIO()
    for out in (terminal, plain):
        with cli.progress(spark, 0.01, out):
            spark.range(0, 1000, 1, 8).selectExpr("count(distinct id)").collect()
            time.sleep(0.1)
    assert "tasks" in terminal.getvalue() and plain.getvalue() == ""

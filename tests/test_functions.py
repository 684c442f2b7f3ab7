"""Hashes against the public libraries, paths against the standard library."""

import fnmatch
import hashlib
import os.path
import random
import zlib

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltmark.functions import hashes as H
from siltmark.functions import paths as P

LIBRARY = {
    "md5": lambda b: hashlib.md5(b).hexdigest(), "sha256": lambda b: hashlib.sha256(b).hexdigest(), "sha512": lambda b: hashlib.sha512(b).hexdigest(),
    "crc32": lambda b: f"{zlib.crc32(b):08x}", "xxh64": lambda b: xxhash.xxh64_hexdigest(b), "xxh3_64": lambda b: xxhash.xxh3_64_hexdigest(b),
    "xxh3_128": lambda b: xxhash.xxh3_128_hexdigest(b), "null": lambda b: "", "c4": lambda b: H.c4_text(hashlib.sha512(b).digest()),
}


@pytest.mark.parametrize("algo", list(H.HASHES))
def test_every_length_around_block_edges(spark, algo):
    r = random.Random(algo)
    data = [r.randbytes(n) for n in [*range(140), 1000, 4095, 65537]] + [None]
    df = spark.createDataFrame([(bytearray(b) if b is not None else None,) for b in data], "content binary").repartition(3)
    out = {None if x["content"] is None else bytes(x["content"]): x["h"] for x in df.select("content", H.content_hash(F.col("content"), algo).alias("h")).collect()}
    assert out == {b: None if b is None else LIBRARY[algo](b) for b in data}


@pytest.mark.parametrize("algo", list(H.HASHES))
def test_hashers_take_data_in_parts(algo):
    state = H.hasher(algo)
    for part in (b"some data", b"", b"more data  "):
        state.update(part)
    assert state.hexdigest() == LIBRARY[algo](b"some datamore data  ")


def test_golden_text(spark):
    df = spark.createDataFrame([("hello, world\n",)], "t string")
    assert df.select(H.text_hash(F.col("t"))).first()[0] == "abdc2a61f1f91f4c"
    assert H.hasher("xxh64").hexdigest() == xxhash.xxh64_hexdigest(b"")


def base58(n):
    return base58(n // 58) + H.C4_ALPHABET[n % 58] if n else ""


@given(st.one_of(st.binary(min_size=64, max_size=64), st.integers(0, 58**12).map(lambda n: n.to_bytes(64, "big"))))
@settings(max_examples=200, deadline=None)
def test_c4_is_base_58_filled_up_on_the_right(digest):
    text = "c4" + base58(int.from_bytes(digest, "big")).ljust(88, "1")
    assert len(text) == 90 and H.c4_text(digest) == text and H.c4_texts(digest + digest) == [text, text]


def test_published_c4_of_nothing():
    assert H.hasher("c4").hexdigest() == "c459dsjfscH38cYeXXYogktxf4Cd9ibshE3BHUo6a58hBXmRQdZrAkZzsWcbWtDg5oQstpDuni4Hirj75GEmTc1sFT"


class Length:
    """A hasher of one's own."""

    def __init__(self):
        self.n = 0

    def update(self, data):
        self.n += len(data)

    def hexdigest(self):
        return f"{self.n:04x}"


def test_added_algorithms(spark, monkeypatch):
    monkeypatch.setattr(H, "HASHES", dict(H.HASHES))
    monkeypatch.setattr(H, "_ADDED", {})
    H.register("length", lambda c: F.lower(F.lpad(F.hex(F.octet_length(c).cast("long")), 4, "0")), Length)
    assert spark.range(1).select(H.text_hash(F.lit("abc"), "length")).first()[0] == "0003"
    state = H.hasher("length")
    state.update(b"abc")
    assert state.hexdigest() == "0003"
    H.register("column_only", lambda c: c)
    with pytest.raises(ValueError):
        H.hasher("column_only")


def test_links_are_resolved(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "real" / "f").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "real")
    df = spark.createDataFrame([(f"{tmp_path}/link/f",), (None,)], "p string")
    real = [r[0] for r in df.select(P.real_path(F.col("p"))).collect()]
    assert real == [os.path.realpath(tmp_path / "real" / "f"), None]
    resolved = df.withColumn("p", P.real_path(F.col("p")))
    start = os.path.realpath(tmp_path / "real")
    assert resolved.select(P.relative_path(F.col("p"), start), P.is_below(F.col("p"), start)).first()[:] == ("f", True)


def test_patterns_and_manifest_name_of_the_environment(monkeypatch):
    assert P.ignored_patterns() == P.IGNORED
    monkeypatch.setenv("SILTMARK_FILE", "sums.json")
    assert P.ignored_patterns()[0] == "sums.json" and P.ignored_patterns()[1:] == P.IGNORED[1:]
    monkeypatch.setenv("SILTMARK_IGNORE", "*.log,tmp")
    assert P.ignored_patterns() == ["*.log", "tmp"]



def test_many_c4_texts_at_once():
    r = random.Random(1)
    digests = [r.randbytes(64) for _ in range(500)] + [bytes(64), bytes(63) + b"\1", b"\0\0" + r.randbytes(62), b"\xff" * 64, bytes(62) + b"\x3a\0"]
    assert H.c4_texts(b"".join(digests)) == [H.c4_text(d) for d in digests]
    assert H.c4_texts(b"") == []


def test_registry(spark):
    with pytest.raises(ValueError):
        H.content_hash(F.lit(b""), "nope")
    with pytest.raises(ValueError):
        H.hasher("nope")
    H.register("length", lambda c: F.octet_length(c).cast("string"))
    try:
        assert spark.range(1).select(H.content_hash(F.lit(b"abc"), "length")).first()[0] == "3"
    finally:
        del H.HASHES["length"]


PATHS = ["/a/b/c.txt", "/a//b/./c/../d", "a/../../b", "..", "/..", "/", ".", "a", "x/", "/x/", "//a", "", "/a/b.GZ", "a.tar.gz", ".gz", "/é/ b/\n.x"]


def column(spark, values, expression):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "p string")
    out = {r["p"]: r["o"] for r in df.select("p", expression(F.col("p")).alias("o")).collect()}
    out.pop(None)
    return out


def test_path_expressions(spark):
    assert column(spark, PATHS, P.basename) == {p: os.path.basename(p) for p in PATHS}
    assert column(spark, [p for p in PATHS if "//" not in p], P.dirname) == {p: os.path.dirname(p) for p in PATHS if "//" not in p}
    want = {p: os.path.normpath(p).replace("//", "/") for p in PATHS}
    assert column(spark, PATHS, P.normal_path) == want
    assert column(spark, PATHS, P.uncompressed_path) == {p: p[:-3] if p.lower().endswith(".gz") else p for p in PATHS}
    below = column(spark, ["/a/b/c/d.txt", "/a/b/c", "/a/b/cd", "/a/b/x/../c/e"], lambda c: P.is_below(c, "/a/b/c/"))
    assert below == {"/a/b/c/d.txt": True, "/a/b/c": False, "/a/b/cd": False, "/a/b/x/../c/e": True}
    rel = column(spark, ["/r/s/t", "/r/s", "/rs/t", "u\\v"], lambda c: P.relative_path(c, "/r/s"))
    assert rel == {"/r/s/t": "t", "/r/s": "/r/s", "/rs/t": "/rs/t", "u\\v": "u/v"}
    root = column(spark, ["/r", "/r/x", "/rx", "/"], lambda c: P.under_root(c, "/r/"))
    assert root == {"/r": True, "/r/x": True, "/rx": False, "/": False}


GLOBS = ["*", "a*", "*.md", "?b", "[ab]*", "[!a]b", "[a-c]?", "x[", "x[]]y", "a[*]b", "a.b", "a\\b", "+(a)", "[^a]b", "/a/*/c", "ab", "[!]]x", "{a}", "a|b"]
NAMES = ["", "a", "ab", "bb", "cb", "x[", "x]y", "a*b", "a.b", "axb", "a\\b", "+(a)", "^b", "/a/b/c", "/a/b/d/c", "q.md", "q.md\n", "]x", "yx", "{a}", "a|b"]


def test_globs_match_as_the_standard_library_does(spark):
    for g in GLOBS:
        assert column(spark, NAMES, lambda c: P.matches_glob(c, g)) == {n: fnmatch.fnmatchcase(n, g) for n in NAMES}, g


def test_ignored_paths_float_at_the_start(spark):
    names = ["/x/mydist", "dist", "/dist/x", "/a/.git/x", "a.gitignore", "a~", "~/x", "hash.json", "myhash.json", "hash.jsonx", "x.tmp", "x.tmp2", "build\n", "a.pyc", "ok"]
    import re
    expected = {n: any(re.search(fnmatch.translate(p), n) for p in P.IGNORED) for n in names}
    assert column(spark, names, P.is_ignored) == expected
    assert expected["/x/mydist"] and expected["/a/.git/x"] and not expected["/dist/x"]
    assert column(spark, names, lambda c: P.is_ignored(c, ["*"])) == {n: True for n in names}
    assert column(spark, names, lambda c: P.is_ignored(c, [])) == {n: False for n in names}


def test_pruned_paths(spark):
    names = ["/r/a/b", "/r/dist/a", "/r/a/.git/c/d", "/r/a/x.tmp", "/r/venv1", "/r/x.tmp/y", "/r/disty/y"]
    assert column(spark, names, lambda c: P.is_pruned(c, "/r")) == dict(zip(names, [False, True, True, True, True, True, False]))
    outside = column(spark, ["/dist/r/a", "/dist/r/build/a"], lambda c: P.is_pruned(c, "/dist/r"))
    assert outside == {"/dist/r/a": False, "/dist/r/build/a": True}


def test_texts(spark):
    sizes = [0, 1023, 1024, 1152, 1536, 5 * 1024**2, 3 * 1024**4, 2**60]

    def text(n):
        for unit in ["B", "KB", "MB", "GB", "TB"]:
            if n < 1024:
                return f"{n:.2f} {unit}"
            n /= 1024
        return f"{n:.2f} PB"

    df = spark.createDataFrame([(s,) for s in sizes], "n long")
    assert [r[0] for r in df.select(P.format_bytes(F.col("n"))).collect()] == [text(s) for s in sizes]
    line = spark.createDataFrame([(1.7e9, "12", "md5", "ab", "/p")], "t double, i string, a string, h string, p string")
    row = line.select(P.result_line(*[F.col(c) for c in "tiahp"]), P.utc_stamp(F.lit(-1.5))).first()
    assert row[0] == f"{'2023-11-14T22:13:20':<20} {'12':<10} {'md5:ab':<35} /p" and row[1] == "1969-12-31T23:59:58Z"

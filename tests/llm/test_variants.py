"""Formatting variants against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltmark.llm import queries, variants

FILES = "id long, path string, inode string, algo string, mtime double, hash string, size long, tbl string, n long, canon string"


def alnum(s):
    return None if s is None else "".join(c for c in s.lower() if c.isalnum())


def brute(rows, key):
    groups = defaultdict(set)
    for r in rows:
        groups[key(r)].add(r[0])
    return Counter((min(g), i) for g in groups.values() for i in g if i != min(g))


def got(df):
    return Counter(tuple(r) for r in df.select("keep_id", "copy_id").collect())


def make(n, seed):
    r = random.Random(seed)
    spell = lambda s: None if s is None else r.choice([s, s.upper(), f" {s}.", s.replace("/", "\\"), s.replace("b", "-b")])
    base = [("/a/b", "12"), ("/é/ab", "7"), ("/A/bc", None), (None, "12"), ("", ""), ("...", "#")]
    rows = []
    for i in range(n):
        p, inode = r.choice(base)
        rows.append((n - i, spell(p), spell(inode), r.choice(["md5", None]), r.choice([1.0, None]), r.choice(["h", None]), r.choice([1, None]), "x", 5, "y"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("is_hot", [False, True])
def test_copies_of_file_rows(spark, seed, is_hot, request):
    if is_hot:
        request.getfixturevalue("hot")
    rows = make(400, seed)
    out = variants.copies(spark.createDataFrame(rows, FILES).repartition(3), "id", *variants.file_rows())
    assert got(out) == brute(rows, lambda r: (alnum(r[1]), alnum(r[2]), *r[3:7]))


def test_counts_are_whole(spark):
    rows = make(300, 3)
    out = variants.records(spark.createDataFrame(rows, FILES), "id", *variants.file_rows()).collect()
    assert sum(r["copies"] for r in out) == 300
    expected = Counter((alnum(r[1]), alnum(r[2]), *r[3:7]) for r in rows)
    assert sorted(r["copies"] for r in out) == sorted(expected.values())


def test_records_of_both_tables(spark, tmp_path):
    rows = make(200, 4)
    spark.createDataFrame(rows, FILES).write.parquet(f"{tmp_path}/files.parquet")
    lines = [(i + 1, x) for i, x in enumerate(LINES[:8] + LINES[:1])]
    spark.createDataFrame(lines, "line_id long, line string").write.parquet(f"{tmp_path}/raw_lines.parquet")
    groups = defaultdict(list)
    for r in rows:
        groups[(alnum(r[1]), alnum(r[2]), *r[3:7])].append(r)
    expected = Counter(("files", min(r[0] for r in g), len(g), len({r[1:3] for r in g})) for g in groups.values())
    expected.update([("raw_lines", 1, 7, 6), ("raw_lines", 7, 1, 1), ("raw_lines", 8, 1, 1)])
    out = queries.p3_records(spark, str(tmp_path))
    assert Counter(tuple(r) for r in out.select("tbl", "keep_id", "copies", "spellings").collect()) == expected


LINES = [
    '{"path": "/a/Hash b.txt", "inode": "12", "size": 5, "algo": "md5", "hash": "AB"}',
    "hash=ab; ALGO=MD5; size=5; Inode=12; path=/a/hash b.txt;",
    "[PATH: /a/hash_b.txt] [inode: #12] [size: 5] [algo: md5] [hash: ab]",
    "path :/a/hash b.txt\tinode :12\tsize :5\talgo :md5\thash :ab.",
    "path = '/a/hash b.txt',inode = '12',size = '5',algo = 'md5',hash = 'ab' ",
    "«path»\u00a0= /a/hash b.txt; inode\u3000= 12; size = 5; algo = md5; hash = ab",
    "path=/a/hash b.txt; inode=12; size=6; algo=md5; hash=ab",
    "path=/a/hash b.txt; inode=12; size=5; algo=md5",
    "path=/a/hash b.txt; inode=12; size=5; algo=md5; hash=",
    "", None, "   ", "nothing here",
]


def test_lines_in_several_notations(spark):
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(LINES + LINES[:1])], "line_id long, line string")
    out = got(variants.copies(df, "line_id", *variants.entry_lines()))
    assert out == Counter({(1, 2): 1, (1, 3): 1, (1, 4): 1, (1, 5): 1, (1, 6): 1, (1, 14): 1, (10, 12): 1, (10, 13): 1})


def test_very_long_values(spark):
    long = "/" + "ab-" * 200_000
    line = f"hash=1{';' * 100_000} path={long}; inode=1; size=1; algo=x"
    df = spark.createDataFrame([(1, line), (2, line.upper()), (3, line + "c")], "line_id long, line string")
    assert got(variants.copies(df, "line_id", *variants.entry_lines())) == Counter({(1, 2): 1})


def test_groups_are_of_equal_texts_not_of_equal_hashes(spark, monkeypatch):
    """With a hash of two values everything meets everything, and is told apart."""
    from siltmark.operators import skew

    weak = lambda *columns: f"pmod(xxhash64({', '.join(f'`{c}`' for c in columns)}), 2)"
    monkeypatch.setattr(skew, "hash_of", weak)
    monkeypatch.setattr(variants, "hash_of", weak)
    rows = make(250, 6)
    out = variants.copies(spark.createDataFrame(rows, FILES), "id", *variants.file_rows())
    assert got(out) == brute(rows, lambda r: (alnum(r[1]), alnum(r[2]), *r[3:7]))


def test_grouping_keys_are_the_canonical_columns(spark):
    found = variants.survivors(spark.createDataFrame(make(9, 1), FILES), "id", *variants.file_rows())
    plan = variants.groups(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "xxhash64" not in plan and all(c in plan.split("\n")[0] for c in ("__c_path", "__c_inode", "__hash", "__size", "__mtime", "__algo"))


def test_empty_table(spark):
    assert variants.copies(spark.createDataFrame([], FILES), "id", *variants.file_rows()).count() == 0


def test_fields_are_found_as_named(spark):
    lines = [x for x in LINES if x] + ["path=inode:5", "xpath=1 path2=3 size=4", "\x01hash\x02=a\x01b"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    rows = df.select("line", variants.marked_fields(F.col("line")).alias("m"), variants.fields_in_order(F.col("line")).alias("c")).collect()
    start = re.compile(r"(?i)(?<![^\W_])(path|inode|size|algo|hash)[\s\"'«»]*[=:]")
    for r in rows:
        line = r["line"].replace("\x01", " ").replace("\x02", " ")
        marks = list(start.finditer(line))
        want = [(m[1], line[m.end():(marks[i + 1].start() if i + 1 < len(marks) else None)]) for i, m in enumerate(marks)]
        assert [tuple(x.split("\x02")) for x in r["m"].split("\x01")[1:]] == want
        assert r["c"] == "\x01".join(sorted(f"{n.lower()}\x02{alnum(v)}" for n, v in want))

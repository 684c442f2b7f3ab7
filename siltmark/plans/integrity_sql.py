"""SQL that ``integrity_queries`` are checked against."""

from __future__ import annotations

from siltmark.functions.paths import IGNORED
from siltmark.plans.integrity_queries import ALGOS, COLUMNS, DIFF, DIFF_ROOT, SINCE, VECTORS

_DOCS = "docs AS (SELECT doc_id, text, '/data/' || coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/' || doc_id || '.txt' AS path FROM documents)"
_DIRNAME = "(CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END)"
_BYTES = "octet_length(encode(text))"


def _newest(name: str, table: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE rn, regexp_extract(path, '[^/]*$') AS name, {_DIRNAME} AS dirname FROM (
SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(updated_at, -1) DESC, id DESC) AS rn FROM {table}) WHERE rn = 1)"""


_M1, _M2 = _newest("m1", "files"), _newest("m2", "files_replica")

# XXH64 and CRC-32 after their public specifications, in 128-bit arithmetic.
_P1, _P2, _P3, _P4, _P5 = (f"{p}::UHUGEINT" for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_MASK = f"{2**64 - 1}::UHUGEINT"


def _m(x: str) -> str:
    return f"(({x}) & {_MASK})"


def _rotl(x: str, r: int) -> str:
    return f"({_m(f'({x}) * {2**r}::UHUGEINT')} | (({x}) // {2**(64 - r)}::UHUGEINT))"


def _word(o: str, n: int) -> str:
    swapped = " || ".join(f"substr(h, 2 * ({o}) + {2 * i + 1}, 2)" for i in reversed(range(n)))
    return f"(('0x' || {swapped})::UBIGINT)::UHUGEINT"


def _round(v: str, w: str) -> str:
    return _m(f"{_rotl(_m(f'{v} + {_m(f'{w} * {_P2}')}'), 31)} * {_P1}")


def _lane(init: str, i: int) -> str:
    words = f"list_transform(range(n // 32), lambda s: {_word(f's * 32 + {8 * i}', 8)})"
    return f"list_reduce({words}, lambda v, w: {_round('v', 'w')}, {init})"


def _fold(v: str) -> str:
    return f"xor(x, {_round('0::UHUGEINT', v)})"


_XXH64 = f"""WITH b AS (SELECT <id> AS id, hex(<text>) AS h, octet_length(encode(<text>)) AS n FROM <table>),
l AS (SELECT *, {_lane(_m(f'{_P1} + {_P2}'), 0)} AS v1, {_lane(_P2, 1)} AS v2, {_lane('0::UHUGEINT', 2)} AS v3, {_lane(f'({2**64}::UHUGEINT - {_P1})', 3)} AS v4 FROM b),
s AS (SELECT *, {_m(f"{_rotl('v1', 1)} + {_rotl('v2', 7)} + {_rotl('v3', 12)} + {_rotl('v4', 18)}")} AS x FROM l),
s1 AS (SELECT * REPLACE ({_m(f"{_fold('v1')} * {_P1} + {_P4}")} AS x) FROM s),
s2 AS (SELECT * REPLACE ({_m(f"{_fold('v2')} * {_P1} + {_P4}")} AS x) FROM s1),
s3 AS (SELECT * REPLACE ({_m(f"{_fold('v3')} * {_P1} + {_P4}")} AS x) FROM s2),
s4 AS (SELECT * REPLACE ({_m(f"{_fold('v4')} * {_P1} + {_P4}")} AS x) FROM s3),
t AS (SELECT id, h, n, {_m(f"(CASE WHEN n >= 32 THEN x ELSE {_P5} END) + n::UHUGEINT")} AS x, n // 32 * 32 AS o FROM s4),
t8 AS (SELECT id, h, n, o + (n - o) // 8 * 8 AS o, list_reduce(list_transform(range((n - o) // 8), lambda i: {_word('o + i * 8', 8)}),
  lambda v, w: {_m(f"{_rotl(f"xor(v, {_round('0::UHUGEINT', 'w')})", 27)} * {_P1} + {_P4}")}, x) AS x FROM t),
t4 AS (SELECT id, h, n, o + (n - o) // 4 * 4 AS o, list_reduce(list_transform(range((n - o) // 4), lambda i: {_word('o + i * 4', 4)}),
  lambda v, w: {_m(f"{_rotl(f"xor(v, {_m(f'w * {_P1}')})", 23)} * {_P2} + {_P3}")}, x) AS x FROM t8),
t1 AS (SELECT id, list_reduce(list_transform(range(n - o), lambda i: {_word('o + i', 1)}),
  lambda v, w: {_m(f"{_rotl(f"xor(v, {_m(f'w * {_P5}')})", 11)} * {_P1}")}, x) AS x FROM t4),
f1 AS (SELECT id, {_m(f"xor(x, x // {2**33}::UHUGEINT) * {_P2}")} AS x FROM t1),
f2 AS (SELECT id, {_m(f"xor(x, x // {2**29}::UHUGEINT) * {_P3}")} AS x FROM f1)
SELECT id AS <id>, printf('%016x', xor(x, x // {2**32}::UHUGEINT)::UBIGINT) AS hash FROM f2"""


def _xxh64(table: str, key: str, text: str) -> str:
    return _XXH64.replace("<table>", table).replace("<id>", key).replace("<text>", text)


_CRC32 = """WITH t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: xor(c // 2, (c % 2) * 3988292384), i) AS v FROM range(256) r(i))),
b AS (SELECT doc_id, hex(text) AS h, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, printf('%08x', xor(list_reduce(list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)) AS hash FROM b, t"""


def _ignored(path: str) -> str:
    """Patterns of one star at an end: tied to the end of the path or not."""
    return "(" + " OR ".join(f"contains({path}, '{p[:-1]}')" if p.endswith("*") else f"ends_with({path}, '{p.lstrip('*')}')" for p in IGNORED) + ")"


def _normal(path: str) -> str:
    parts = f"list_transform(list_filter(string_split({path}, '/'), lambda p: p NOT IN ('', '.')), lambda p: [p])"

    def text(at_top: str) -> str:
        step = f"CASE WHEN p[1] <> '..' THEN k || p WHEN len(k) > 0 AND k[-1] <> '..' THEN k[:-2] ELSE {at_top} END"
        return f"array_to_string(list_reduce({parts}, lambda k, p: {step}, []::VARCHAR[]), '/')"

    return f"(CASE WHEN starts_with({path}, '/') THEN '/' || {text('k')} WHEN {text('k || p')} = '' THEN '.' ELSE {text('k || p')} END)"


_COLS = ", ".join(COLUMNS)
_ALGO_LIST = ", ".join(f"'{a}'" for a in ALGOS)


def _diff_sql(same_algo: bool = False) -> str:
    a, b = DIFF
    algo = "AND x.algo = y.algo" if same_algo else ""
    return f"""WITH x AS (SELECT DISTINCT f.* FROM snapshots s JOIN snapshot_files l ON l.snapshot_id = s.id JOIN files f ON f.id = l.file_id WHERE s.name = '{a}'),
y AS (SELECT DISTINCT f.* FROM snapshots s JOIN snapshot_files l ON l.snapshot_id = s.id JOIN files f ON f.id = l.file_id WHERE s.name = '{b}'),
c AS (SELECT DISTINCT x.path FROM x JOIN y ON x.path = y.path AND x.hash <> y.hash {algo}),
a AS (SELECT DISTINCT path FROM y WHERE id NOT IN (SELECT id FROM x) AND path NOT IN (SELECT path FROM c)),
r AS (SELECT DISTINCT path FROM x WHERE id NOT IN (SELECT id FROM y) AND path NOT IN (SELECT path FROM c)),
d AS (SELECT 'changed' AS status, path FROM c UNION ALL SELECT 'added', path FROM a WHERE path NOT IN (SELECT path FROM r)
UNION ALL SELECT 'removed', path FROM r WHERE path NOT IN (SELECT path FROM a))
"""


_VERIFY = """FROM {left} JOIN m2 n ON n.path = {at} AND n.algo = m.algo
WHERE m.hash <> '' AND n.hash <> '' AND n.hash <> m.hash AND m.mtime IS DISTINCT FROM n.mtime"""
_FOLDERS = f"WITH {_DOCS}, e AS (SELECT text, path, unnest(['/data', regexp_extract(path, '^/[^/]*/[^/]*'), regexp_replace(path, '/[^/]*$', '')]) AS folder FROM docs)"

# Digests of the texts of VECTORS, from the algorithms' public libraries.
_VECTORS = """
  (0, 'null', ''),
  (0, 'md5', 'd41d8cd98f00b204e9800998ecf8427e'),
  (0, 'sha256', 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855'),
  (0, 'sha512', 'cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce47d0d13c5d85f2b0ff8318d2877eec2f63b931bd47417a81a538327af927da3e'),
  (0, 'crc32', '00000000'),
  (0, 'xxh64', 'ef46db3751d8e999'),
  (0, 'xxh3_64', '2d06800538d394c2'),
  (0, 'xxh3_128', '99aa06d3014798d86001c324468d497f'),
  (0, 'c4', 'c459dsjfscH38cYeXXYogktxf4Cd9ibshE3BHUo6a58hBXmRQdZrAkZzsWcbWtDg5oQstpDuni4Hirj75GEmTc1sFT'),
  (1, 'null', ''),
  (1, 'md5', '900150983cd24fb0d6963f7d28e17f72'),
  (1, 'sha256', 'ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad'),
  (1, 'sha512', 'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f'),
  (1, 'crc32', '352441c2'),
  (1, 'xxh64', '44bc2cf5ad770999'),
  (1, 'xxh3_64', '78af5f94892f3950'),
  (1, 'xxh3_128', '06b05ab6733a618578af5f94892f3950'),
  (1, 'c4', 'c45S4rnaTNWonxss1u8LzsaJdEph1AJhWUF4sh2waXKMsutyfAxg4ybUeuXVWS9HdNcEypmeXn8FZGonD4w1rj9DZp'),
  (2, 'null', ''),
  (2, 'md5', '22c3683b094136c3398391ae71b20f04'),
  (2, 'sha256', '853ff93762a06ddbf722c4ebe9ddd66d8f63ddaea97f521c3ecc20da7c976020'),
  (2, 'sha512', 'f65f341b35981fda842b09b2c8af9bcdb7602a4c2e6fa1f7d41f0974d3e3122f268fc79d5a4af66358f5133885cd1c165c916f80ab25e5d8d95db46f803c782c'),
  (2, 'crc32', 'f4247453'),
  (2, 'xxh64', 'abdc2a61f1f91f4c'),
  (2, 'xxh3_64', '660687edec075653'),
  (2, 'xxh3_128', 'aef7d73364a11a632fc4faefcc422cb8'),
  (2, 'c4', 'c45vhGWHMBc5V15tZXUfgSf49jMCjsE8jQ5KuN4TUat9g4nSUXSjoepKLLK8oBavZMUqx1m13H9GUu2iyRsyFAyffh'),
  (3, 'null', ''),
  (3, 'md5', '9e107d9d372bb6826bd81d3542a419d6'),
  (3, 'sha256', 'd7a8fbb307d7809469ca9abcb0082e4f8d5651e46d3cdb762d02d0bf37c9e592'),
  (3, 'sha512', '07e547d9586f6a73f73fbac0435ed76951218fb7d0c8d788a309d785436bbb642e93a252a954f23912547d1e8a3b5ed6e1bfd7097821233fa0538f3db854fee6'),
  (3, 'crc32', '414fa339'),
  (3, 'xxh64', '0b242d361fda71bc'),
  (3, 'xxh3_64', 'ce7d19a5418fb365'),
  (3, 'xxh3_128', 'ddd650205ca3e7fa24a1cc2e3a8a7651'),
  (3, 'c4', 'c4AA3ASLQfdQwGxaam2okv9uTopf28Piy2pskrf6vQ35fsAKCBzQAv31LTcwMcp3hpDqF4vxgvu3UoPSAN4qZ3Ygd1')
"""
# What a walk over the tree of fs_walk finds.
_TREE = """
  ('a.txt', 'a.txt', 'file', 3, 'f97c5d29941bfb1b2fdab0874906ab82'),
  ('_b.txt', '_b.txt', 'file', 0, 'd41d8cd98f00b204e9800998ecf8427e'),
  ('.hidden/c d.txt', 'c d.txt', 'file', 4, 'a00b51be30613a85e5dbc199e8c45a76'),
  ('e/f/g.bin', 'g.bin', 'file', 1000, 'ede3d3b685b4e137ba4cb2521329a75e'),
  ('e/i.txt.gz', 'i.txt.gz', 'file', 3, 'f97c5d29941bfb1b2fdab0874906ab82'),
  ('.', '.', 'dir', NULL, NULL),
  ('.hidden', '.hidden', 'dir', NULL, NULL),
  ('e', 'e', 'dir', NULL, NULL),
  ('e/f', 'f', 'dir', NULL, NULL)
"""

ORACLES = {
    "hash_vectors": "SELECT [" + ", ".join("'" + t.replace("\n", "' || chr(10) || '") + "'" for t in VECTORS) + f"][i + 1] AS text, algo, hash FROM (VALUES {_VECTORS}) v(i, algo, hash)",
    "fs_walk": f"SELECT *, true AS has_time, true AS has_inode FROM (VALUES {_TREE}) v(path, name, type, size, md5)",
    "uncompress_then_plain": "SELECT * FROM (VALUES (0, true, false), (1, false, false), (2, false, true)) v(step, of_contents, cached)",
    "hash_null": "SELECT doc_id, '' AS hash FROM documents",
    "hash_md5": "SELECT doc_id, md5(text) AS hash FROM documents",
    "hash_sha256": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "hash_crc32": _CRC32,
    "hash_xxh64": _xxh64("documents", "doc_id", "text"),
    "hash_xxh64_paths": _xxh64("files", "id", "path"),
    "stat_projection": f"WITH {_DOCS} SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS dirname, {_BYTES} AS size, doc_id::DOUBLE AS mtime FROM docs",
    "manifest_scan": f"WITH {_DOCS} SELECT path, {_BYTES} AS size, md5(text) AS md5 FROM docs",
    "path_basename_dirname": f"SELECT id, regexp_extract(path, '[^/]*$') AS name, {_DIRNAME} AS dirname FROM files",
    "path_normalize": f"""WITH n AS (SELECT id, {_normal("(path || '/.././/' || id || '/x/..')")} AS normal FROM files)
SELECT id, normal, CASE WHEN starts_with(normal, '/srv/vault/') THEN substr(normal, 12) ELSE normal END AS relative FROM n""",
    "path_uncompressed": "SELECT id, regexp_replace(path, '(?i)\\.gz$', '') AS path FROM files",
    "path_output": f"WITH {_M1} SELECT regexp_replace(path, '(?i)\\.gz$', '') AS path, regexp_replace(name, '(?i)\\.gz$', '') AS name, CASE WHEN path ILIKE '%.gz' THEN size * 10 ELSE size END AS size FROM m1",
    "path_is_subpath": "SELECT id, starts_with(path, '/srv/vault/') AS below FROM files",
    "paths_equal": f"""WITH o AS (SELECT DISTINCT id, '//' || path || '/.' AS other FROM files_replica)
SELECT id, other, {_normal('path')} = {_normal('other')} AS equal FROM files JOIN o USING (id)""",
    "format_bytes": "SELECT id, CASE " + " ".join(f"WHEN size < {1024**(i + 1)} THEN printf('%.2f {u}', size / {1024**i}.0::DOUBLE)" for i, u in enumerate(["B", "KB", "MB", "GB", "TB"])) + " END AS text FROM files",
    "format_result": """SELECT id, printf('%-20s %-10s %-35s %s', strftime(to_timestamp(floor(updated_at)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S'),
coalesce(inode, 'None'), algo || ':' || coalesce(hash, 'None'), path) AS line FROM files WHERE updated_at IS NOT NULL""",
    "mhl_timestamp": "SELECT id, strftime(to_timestamp(floor(mtime)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM files",
    "ignore_filter": f"SELECT id, {_ignored('path')} AS ignored FROM files",
    "walk_prune": f"""WITH p AS (SELECT id, path, string_split(ltrim(path, '/'), '/') AS parts FROM files),
a AS (SELECT id, path, parts[-1] AS name, list_transform(range(0, len(parts)), lambda i: '/' || array_to_string(parts[1:i], '/')) AS above FROM p)
SELECT id, path FROM a WHERE NOT {_ignored('name')} AND NOT list_bool_or(list_transform(above, lambda q: {_ignored('q')}))""",
    "drop_falsy": f"WITH {_M1} SELECT path, hash FROM m1 WHERE algo = 'xxh64' AND hash <> ''",
    "cache_scan": f"SELECT id, {_COLS} FROM files",
    "cache_ids": "SELECT id FROM files",
    "cache_query_glob": f"SELECT id, {_COLS} FROM files WHERE algo = 'xxh64' AND regexp_full_match(path, '(?s)/srv/.*/prj_0[0-4].*/..*/[^x].*\\.m.*')",
    "cache_query_exact": f"SELECT id, {_COLS} FROM files WHERE path = (SELECT max(path) FROM files)",
    "cache_query_since": f"SELECT id, {_COLS} FROM files WHERE algo = 'md5' AND updated_at >= epoch(TIMESTAMPTZ '{SINCE}')",
    "cache_lookup": """WITH k AS (SELECT path, mtime, algo, min(hash) AS cached_hash FROM files WHERE hash IS NOT NULL GROUP BY ALL)
SELECT r.id, r.path, r.mtime, r.algo, cached_hash FROM files_replica r LEFT JOIN k USING (path, mtime, algo)""",
    "cache_has": "SELECT r.id, r.path FROM files_replica r WHERE EXISTS (SELECT 1 FROM files f WHERE f.path = r.path AND f.mtime = r.mtime AND f.algo = r.algo AND f.hash = r.hash)",
    "cache_hit_split": "SELECT DISTINCT r.id, EXISTS (SELECT 1 FROM files f WHERE f.path = r.path AND f.mtime = r.mtime AND f.algo = r.algo AND f.hash IS NOT NULL) AS hit FROM files_replica r",
    "cache_merge": f"""WITH b AS (SELECT {_COLS}, 0 AS prio FROM files UNION ALL SELECT {_COLS}, 1 FROM files_replica)
SELECT {_COLS} FROM b QUALIFY row_number() OVER (PARTITION BY path, mtime, algo ORDER BY prio, updated_at NULLS FIRST, hash NULLS FIRST, size NULLS FIRST, inode NULLS FIRST) = 1""",
    "cache_put": f"""WITH b AS (SELECT {_COLS} FROM files_replica QUALIFY row_number() OVER (PARTITION BY path, mtime, algo
ORDER BY updated_at NULLS FIRST, hash NULLS FIRST, size NULLS FIRST, inode NULLS FIRST) = 1)
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.path = b.path AND f.mtime = b.mtime AND f.algo = b.algo)""",
    "cache_store": "SELECT algo, count(*) AS n FROM (SELECT DISTINCT path, mtime, algo FROM files UNION SELECT DISTINCT path, mtime, algo FROM files_replica) GROUP BY algo",
    "mtime_changed": f"WITH {_M1}, {_M2} SELECT path, m1.mtime, m2.mtime AS live FROM m1 JOIN m2 USING (path) WHERE m1.mtime <> m2.mtime",
    "checksum_file": f"WITH {_DOCS} SELECT path, sha256(text) AS hash, {_BYTES} AS size FROM docs",
    "folder_hash": f"WITH {_DOCS} SELECT regexp_extract(path, '^/[^/]*/[^/]*') AS folder, md5(string_agg(text, '' ORDER BY path)) AS hash FROM docs GROUP BY 1",
    "checksum_gen": f"{_FOLDERS} SELECT folder AS path, md5(string_agg(text, '' ORDER BY path)) AS hash FROM e GROUP BY folder UNION ALL SELECT path, md5(text) FROM docs",
    "checksum_path": f"""WITH {_DOCS} SELECT path, md5(text) AS hash FROM docs
UNION ALL SELECT regexp_replace(path, '/[^/]*$', ''), md5(string_agg(text, '' ORDER BY path)) FROM docs GROUP BY 1""",
    "composite_hash": f"WITH {_DOCS} SELECT md5(string_agg(path || ':' || md5(text), chr(10) ORDER BY path, md5(text))) AS hash FROM docs",
    "dedupe_paths": f"WITH {_DOCS} SELECT md5(text) AS hash, count(*) OVER (PARTITION BY md5(text)) AS n_files, path FROM docs QUALIFY n_files > 1",
    "dedupe_overlap": f"""WITH {_DOCS}, u AS (SELECT text, path FROM docs UNION ALL SELECT text, path FROM docs WHERE starts_with(path, '/data/askbench/'))
SELECT md5(text) AS hash, count(*) OVER (PARTITION BY md5(text)) AS n_files, path FROM u QUALIFY n_files > 1""",
    "summary": "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files",
    "dedupe_manifests": f"""WITH {_M1}, {_M2} SELECT '/mnt/a/' || path AS target, '/mnt/b/' || path AS source FROM m1 JOIN m2 USING (path)
WHERE m1.algo = 'xxh64' AND m2.algo = 'xxh64' AND m1.hash = m2.hash AND m1.hash <> ''""",
    "verify_manifest": f"WITH {_M1}, {_M2} SELECT m.algo, n.hash, m.path " + _VERIFY.format(left="m1 m", at="m.path"),
    "verify_manifest_gz_fallback": f"""WITH {_M1}, {_M2}, g AS (SELECT *, regexp_replace(path, '(?i)\\.gz$', '') AS p FROM m1),
m AS (SELECT g.*, CASE WHEN p IN (SELECT path FROM m2) THEN p ELSE p || '.gz' END AS at FROM g)
SELECT m.algo, n.hash, m.p AS path """ + _VERIFY.format(left="m", at="m.at"),
    "compare_manifests": f"""WITH {_M1}, {_M2}, a AS (SELECT path, name, CASE WHEN algo = 'xxh64' THEN hash END AS hash FROM m1),
b AS (SELECT path, name, CASE WHEN algo = 'xxh64' THEN hash END AS hash FROM m2)
SELECT 'xxh64' AS algo, hash, path FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.path = a.path AND b.hash IS NOT DISTINCT FROM a.hash)
AND NOT EXISTS (SELECT 1 FROM b WHERE b.name = a.name AND b.hash IS NOT DISTINCT FROM a.hash)""",
    "sidecar_lookup": f"""WITH {_M1}, {_M2} SELECT m1.path, CASE WHEN m2.algo = 'xxh64' THEN m2.hash END AS sidecar_hash
FROM m1 LEFT JOIN m2 ON m2.dirname = m1.dirname AND m2.name = m1.name AND m2.mtime = m1.mtime""",
    "json_roundtrip": f"WITH {_M1} SELECT path, name, mtime, size, " + ", ".join(f"CASE WHEN algo = '{a}' THEN hash END AS {a}" for a in ("md5", "xxh64", "c4")) + " FROM m1",
    "json_whole": f"WITH {_M1} SELECT path, name, mtime, size, " + ", ".join(f"CASE WHEN algo = '{a}' THEN hash END AS {a}" for a in ("md5", "xxh64", "c4")) + " FROM m1",
    # A line break within a path ends its line; white space around a line is lost.
    "txt_roundtrip": f"""WITH {_M1}, l AS (SELECT path AS src, regexp_split_to_array(hash || ' ' || path, '\\r\\n|\\r|\\n') AS parts FROM m1 WHERE algo = 'xxh64' AND hash <> ''),
t AS (SELECT src, i, regexp_replace(parts[i], '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS line FROM (SELECT src, parts, unnest(range(1, len(parts) + 1)) AS i FROM l))
SELECT substr(line, instr(line, ' ') + 1) AS path, arg_max(substr(line, 1, instr(line, ' ') - 1), (src, i)) AS xxh64 FROM t WHERE contains(line, ' ') GROUP BY 1""",
    "mhl_roundtrip": f"""WITH {_M1} SELECT replace({_normal('path')}, '\\', '/') AS path, strftime(to_timestamp(floor(mtime)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS lastmodificationdate,
coalesce(size, 0) AS size, coalesce(CASE WHEN algo = 'md5' THEN hash END, '') AS md5 FROM m1""",
    "read_gz": "WITH t AS (SELECT string_agg(line || chr(10), '' ORDER BY line_id) AS text FROM raw_lines) SELECT octet_length(encode(text)) AS size, md5(text) AS hash FROM t",
    "snapshot_membership": "SELECT DISTINCT ON (s.name, f.id) s.name, path, algo, hash FROM (SELECT id AS sid, name FROM snapshots) s JOIN snapshot_files l ON l.snapshot_id = s.sid JOIN files f ON f.id = l.file_id",
    "snapshot_list": "SELECT name, path, created_at FROM snapshots",
    "snapshot_diff_all": _diff_sql() + "SELECT * FROM d",
    "snapshot_diff_same_algo": _diff_sql(True) + "SELECT * FROM d",
    "snapshot_diff_added": _diff_sql() + "SELECT path FROM d WHERE status = 'added'",
    "snapshot_diff_removed": _diff_sql() + "SELECT path FROM d WHERE status = 'removed'",
    "snapshot_diff_changed": _diff_sql() + "SELECT path FROM d WHERE status = 'changed'",
    "diff_under_root": _diff_sql() + f"SELECT * FROM d WHERE path = '{DIFF_ROOT}' OR starts_with(path, '{DIFF_ROOT}/')",
    "snapshot_replace": f"""WITH {_M1} SELECT 'a' AS name, '/' AS path, 2.0::DOUBLE AS created_at, count(*) AS n FROM m1 WHERE algo = 'md5'
UNION ALL SELECT 'b', '/other', 4.0::DOUBLE, 0""",
}

"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltmark.llm import mixing, packing, repetition, sql, tokens, variants
from siltmark.session import cut


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_found(spark, d):
    files = variants.copies(_table(spark, d, "files"), "id", *variants.file_rows()).withColumn("tbl", F.lit("files"))
    lines = variants.copies(_table(spark, d, "raw_lines"), "line_id", *variants.entry_lines()).withColumn("tbl", F.lit("raw_lines"))
    return files.unionByName(lines).select("tbl", "keep_id", "copy_id")


def p3_copies(spark, d):
    """One record per entry line, with its number of copies and spellings."""
    return variants.records(_table(spark, d, "raw_lines"), "line_id", *variants.entry_lines())


def p3_records(spark, d):
    """One record per entry of both tables, with its number of copies and spellings."""
    files = variants.records(_table(spark, d, "files"), "id", *variants.file_rows()).withColumn("tbl", F.lit("files"))
    lines = variants.records(_table(spark, d, "raw_lines"), "line_id", *variants.entry_lines()).withColumn("tbl", F.lit("raw_lines"))
    return files.unionByName(lines).select("tbl", "keep_id", "copies", "spellings")


def _sized(spark, d, *keep):
    return tokens.token_sizes(_table(spark, d, "documents"), "text", list(keep))


def _packed(spark, d):
    capacity = _table(spark, d, "packs").agg(F.max("capacity")).first()[0]
    return packing.pack(_sized(spark, d, "doc_id"), "tokens", ["doc_id"], capacity), capacity


def p8_packing(spark, d):
    """The container of every document, or of its pieces."""
    return _packed(spark, d)[0]


def p8_fill(spark, d):
    packed, capacity = _packed(spark, d)
    return packing.fill_report(packed, "tokens", capacity)


def p8_found(spark, d):
    return packing.split_items(p8_packing(spark, d), ["doc_id"])


def _mixed(spark, d, **options):
    sized = _sized(spark, d, "doc_id", "source", "votes").withColumn("w", 1 + F.log1p(F.greatest(F.coalesce("votes", F.lit(0)), F.lit(0))))
    return mixing.mix(cut(sized, "sized"), _table(spark, d, "mix_targets"), **options)


def p9_mix(spark, d):
    """The documents used, with their copies."""
    return _mixed(spark, d)[0]


def p9_shares(spark, d):
    return _mixed(spark, d)[1]


def p9_weighted(spark, d):
    """Shares where documents of more votes are drawn more often."""
    return _mixed(spark, d, weight="w")[1]


def p9_exact(spark, d):
    """Shares in a mix of the size at which those that can be reached are exact."""
    return _mixed(spark, d, base="exact")[1]


def p9_found(spark, d):
    """The sources of which all documents have been used as often as allowed, in vain."""
    return _mixed(spark, d)[1].filter("not reachable").select("source")


def _judged(spark, d):
    return repetition.judge(_table(spark, d, "documents"), written=lambda df: cut(df, "measures"))


def p10_documents(spark, d):
    """Measures and verdicts of every document and its host."""
    return _judged(spark, d).withColumn("rate", F.round("rate", 9))


def p10_words(spark, d):
    return repetition.measures(_table(spark, d, "documents"), "doc_id", "text", "source").select(F.col("doc").alias("doc_id"), "n_words", "repeated_words")


def p10_hosts(spark, d):
    """Documents, failures and shrunk rate of every host."""
    judged = cut(repetition.with_rules(repetition.measures(_table(spark, d, "documents"), "doc_id", "text", "source")), "measures")
    return repetition.host_verdicts(judged).withColumn("rate", F.round("rate", 9))


def p10_found(spark, d):
    """Of the documents that came back from the join with their hosts' verdicts."""
    return _judged(spark, d).filter("words_fail and host_bad is not null").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (
    p3_found, p3_copies, p3_records, p8_found, p8_packing, p8_fill, p9_found, p9_mix, p9_shares, p9_weighted, p9_exact, p10_found, p10_documents, p10_words, p10_hosts)}

_LETTERS = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_SIGN = r"""[\s\p{Z}"''`«»“”‘’„‚‹›]*[=:]"""


def _field_sql(name: str) -> str:
    rest = rf"regexp_extract(line, '(?is)(?:\A|[^\p{{L}}\p{{N}}]){name}{_SIGN}(.*)\z', 1)"
    return _LETTERS.format(rf"regexp_replace({rest}, '(?is)[^\p{{L}}\p{{N}}](?:path|inode|size|algo|hash){_SIGN}.*\z', '')") + f" AS {name}"


_LINES = f"lines AS (SELECT line_id, {', '.join(_field_sql(f) for f in variants.LINE_FIELDS)} FROM raw_lines)"
_WORDS = "WITH " + sql.WORDS
ORACLES = {
    "p8_found": f"WITH {sql.TOKENS} SELECT doc_id FROM n WHERE n > (SELECT max(capacity) FROM packs)",
    "p9_found": f"""WITH {sql.TOKENS} SELECT t.source FROM mix_targets t LEFT JOIN (SELECT source, sum(n) AS n FROM n GROUP BY source) h USING (source)
WHERE coalesce(h.n, 0) * max_repeats < target_share * (SELECT sum(n) FROM n)""",
    "p10_hosts": _WORDS + ", " + sql.RULES + "SELECT host, docs, failures, round(rate, 9) AS rate, rate > 0.2 AS host_bad FROM r2",
    "p10_documents": _WORDS + ", " + sql.RULES + """SELECT doc_id, j.source, n_words, repeated_words, line_share, paragraph_share, sentence_share, words_fail, lines_fail, paragraphs_fail,
sentences_fail, round(rate, 9) AS rate, rate > 0.2 AS host_bad FROM j JOIN r2 ON j.source IS NOT DISTINCT FROM host""",
    "p10_found": _WORDS + "SELECT doc_id FROM c WHERE repeated_words * 10 > n_words * 3",
    "p10_words": _WORDS + "SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(repeated_words, 0) AS repeated_words FROM documents LEFT JOIN c USING (doc_id)",
    "p3_found": f"""WITH {_LINES}, a AS (
SELECT 'files' AS tbl, id AS copy_id, min(id) OVER (PARTITION BY {_LETTERS.format('path')}, {_LETTERS.format('inode')}, algo, mtime, hash, size) AS keep_id FROM files
UNION ALL SELECT 'raw_lines', line_id, min(line_id) OVER (PARTITION BY path, inode, size, algo, hash) FROM lines)
SELECT tbl, keep_id, copy_id FROM a WHERE keep_id <> copy_id""",
    "p3_copies": f"""WITH {_LINES} SELECT min(line_id) AS keep_id, count(*) AS copies, count(DISTINCT line) AS spellings
FROM lines JOIN raw_lines USING (line_id) GROUP BY path, inode, size, algo, hash""",
    "p3_records": f"""WITH {_LINES}
SELECT 'files' AS tbl, min(id) AS keep_id, count(*) AS copies, count(DISTINCT (path, inode)) AS spellings
FROM files GROUP BY {_LETTERS.format('path')}, {_LETTERS.format('inode')}, algo, mtime, hash, size
UNION ALL SELECT 'raw_lines', min(line_id), count(*), count(DISTINCT line)
FROM (SELECT lines.*, line FROM lines JOIN raw_lines USING (line_id)) GROUP BY path, inode, size, algo, hash""",
}

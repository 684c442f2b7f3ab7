"""Duplicates hidden by formatting differences.

Records alike but for white space, letter case, punctuation or order of fields
are one record. Three steps, each on less data than the one before:

1. byte-identical raw rows are collapsed, with counts, in each task first;
2. only the distinct survivors are canonicalised;
3. survivors are grouped again on their full canonical text, counts summed.

A group is of rows whose canonical columns are equal as they are; no digest
stands for them. Which row is a copy of which is looked up by joins on a hash of
the columns, which are then compared whole. Only rows that may have a partner go
into these joins (see ``prefilter``), and hot keys (see ``skew``) are spread over
salts.

Defined results: a null value is alike to null only; an empty text, or one
without letters and digits, is alike to every other such text; a line that
does not name a field differs from one that names it without a text; lines that
name no field are alike; of copies the smallest id is kept, and equal ids are
one row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.operators.prefilter import maybe_among
from siltmark.operators.skew import hash_of, hot_keys, skew_join
from siltmark.session import cut

#: The fields an entry line names.
LINE_FIELDS = ["path", "inode", "size", "algo", "hash"]


def letters_digits(c: Column) -> Column:
    """Letters and digits alone, lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


#: Stand before a field's name, and between name and text.
_FIELD, _TEXT = "\x01", "\x02"


def marked_fields(line: Column, names: list[str] = LINE_FIELDS) -> Column:
    """The line with every name of a field, and its = or :, between two control
    characters. One pass; the pattern never looks further back than one
    character, so time is linear in the length of the line."""
    sign = r"[\s\p{Z}\"'`«»“”‘’„‚‹›]*[=:]"
    pattern = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(names) + ")" + sign
    return F.regexp_replace(F.translate(line, _FIELD + _TEXT, "  "), pattern, f"{_FIELD}$1{_TEXT}")


def fields_in_order(line: Column, names: list[str] = LINE_FIELDS) -> Column:
    """Canonical text of a line: its fields' letters and digits in lower case,
    the fields sorted by name. What stands before the first name is ignored."""
    plain = F.regexp_replace(F.lower(marked_fields(line, names)), r"[^\p{L}\p{N}\x01\x02]+", "")
    parts = F.split(plain, _FIELD)
    return F.array_join(F.array_sort(F.slice(parts, F.lit(2), F.size(parts))), _FIELD)


def survivors(rows: DataFrame, id_col: str, raw: dict[str, Column], canonical, keep_raw: bool = False) -> DataFrame:
    """Steps 1 and 2, a row per distinct raw row: the raw columns as ``__<name>``,
    ``first`` and ``n``. ``canonical`` makes other forms of some of them, which
    come as ``__c_<name>``, in place of the raw ones unless these are kept."""
    keys = [f"__{k}" for k in raw]
    rows = rows.select(F.col(id_col).alias("__id"), *[c.alias(f"__{k}") for k, c in raw.items()])
    distinct = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))
    forms = canonical({k: F.col(f"__{k}") for k in raw})
    return distinct.select(*[c.alias(f"__c_{k}") for k, c in forms.items()], *[f"__{k}" for k in raw if keep_raw or k not in forms], "first", "n")


def _canon(found: DataFrame) -> list[str]:
    """The columns that together are the full canonical text of a row."""
    forms = [c for c in found.columns if c.startswith("__c_")]
    return forms + [c for c in found.columns if c.startswith("__") and c not in forms and f"__c_{c[2:]}" not in forms]


def groups(found: DataFrame) -> DataFrame:
    """Step 3: canonical columns, keep_id, copies, spellings from ``survivors``."""
    return found.groupBy(*_canon(found)).agg(F.min("first").alias("keep_id"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("spellings"))


def records(rows: DataFrame, id_col: str, raw: dict[str, Column], canonical) -> DataFrame:
    """(keep_id, copies, spellings): one record per entry."""
    return groups(survivors(rows, id_col, raw, canonical)).select("keep_id", "copies", "spellings")


def copies(rows: DataFrame, id_col: str, raw: dict[str, Column], canonical) -> DataFrame:
    """(keep_id, copy_id): every row that is not the kept one of its copies."""
    found = cut(survivors(rows, id_col, raw, canonical, keep_raw=True), "survivors")
    canon, keys = _canon(found), [f"__{k}" for k in raw]
    # Records of several spellings: their survivors are told which row is kept.
    several = cut(groups(found).filter("spellings > 1").select(*canon, "keep_id", "spellings"), "groups")
    hot = hot_keys(several.selectExpr(f"{hash_of(*canon)} AS k", "spellings"), total=found.count(), n="spellings")
    joined = skew_join(maybe_among(found, several, canon), several.drop("spellings"), canon, "inner", hot)
    spelled = cut(joined.select(*keys, "first", "n", "keep_id"), "spelled")
    other = spelled.filter("first <> keep_id").select("keep_id", F.col("first").alias("copy_id"))
    # Rows written alike byte by byte: only those have to be looked up one by one.
    alike = found.filter("n > 1").select(*keys, "first", "n")
    known = spelled.filter("n > 1").select(*keys, "keep_id")
    alike = skew_join(alike, known, keys, "left", hot.limit(0)).withColumn("keep_id", F.coalesce("keep_id", "first"))
    alike = cut(alike, "alike")
    hot = hot_keys(alike.selectExpr(f"{hash_of(*keys)} AS k", "n"), total=rows.count(), n="n")
    every = rows.select(F.col(id_col).alias("copy_id"), *[c.alias(f"__{k}") for k, c in raw.items()])
    same = skew_join(maybe_among(every, alike, keys), alike.drop("n"), keys, "inner", hot)
    return other.unionByName(same.filter("copy_id <> first").select("keep_id", "copy_id"))


def file_rows() -> tuple[dict[str, Column], object]:
    """Raw columns and canonical form of a table of hashed files."""
    raw = {c: F.col(c) for c in ("path", "inode", "algo", "mtime", "hash", "size")}
    return raw, lambda c: {"path": letters_digits(c["path"]), "inode": letters_digits(c["inode"])}


def entry_lines() -> tuple[dict[str, Column], object]:
    """Raw column and canonical form of lines naming the five fields."""
    return {"line": F.col("line")}, lambda c: {"line": fields_in_order(c["line"])}

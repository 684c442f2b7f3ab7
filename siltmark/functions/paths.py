"""Path expressions, ignore patterns and human-readable forms."""

from __future__ import annotations

import os
import posixpath
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Patterns of files and directories that are not hashed.
IGNORED = [
    "hash.json", "*~", "~*", "*.aspera-ckpt", "*.bak", "*.pyc", "*.pyo", "*.partial", "*.swp", "*.tmp", ".git*",
    ".pytest_cache*", ".smbdelete*", ".svn*", "@eaDir*", "dist", "build", ".venv*", "venv*", "#recycle*", "#snapshot*",
    ".jetpart*", "*.egg-info", "__pycache__", ".cache", ".DS_Store", "Thumbs.db", "desktop.ini", ".Trash*", "lost_found",
]
MANIFEST_NAME = "hash.json"


def ignored_patterns() -> list[str]:
    """The patterns in force: $SILTMARK_IGNORE (separated by commas), or the
    usual ones with the manifest's own name, $SILTMARK_FILE."""
    own = os.environ.get("SILTMARK_IGNORE")
    return own.split(",") if own is not None else [manifest_name(), *IGNORED[1:]]


def manifest_name() -> str:
    return os.environ.get("SILTMARK_FILE", MANIFEST_NAME)


def glob_regex(pattern: str) -> str:
    """Body of a regular expression for a shell pattern, in the syntax Java and
    Python share. ``*`` crosses ``/``; an unclosed ``[`` stands for itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1 + pattern.startswith("!", i))
            if end < 0:
                out.append(r"\[")
                continue
            body = pattern[i:end]
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", body[negated:])
            out.append(f"[{'^' * negated}{body}]")
            i = end + 1
        else:
            out.append(re.escape(c) if not c.isalnum() and c.isascii() else c)
    return "".join(out)


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def matches_glob(path: Column, pattern: str) -> Column:
    """The whole path matches; its literal start is a separate test that
    reaches the scan."""
    literal = re.match(r"[^*?\[]*", pattern).group()
    test = path.rlike(rf"\A(?s:{glob_regex(pattern)})\z")
    return path.startswith(literal) & test if literal else test


def ignored_regex(patterns: list[str] = IGNORED, end: str = r"\z") -> str:
    """Patterns are tied to the end of a path but may start anywhere in it; so a
    star at the start says nothing, and one at the end unties it."""
    loose = [glob_regex(p.strip("*")) for p in patterns if p.endswith("*")]
    tied = [glob_regex(p.lstrip("*")) for p in patterns if not p.endswith("*")]
    if "" in loose:
        return "(?s:)"  # a lone star
    parts = loose + ([f"(?:{'|'.join(tied)}){end}"] if tied else [])
    return f"(?s:{'|'.join(parts)})" if parts else r"(?!)"


def is_ignored(path: Column, patterns: list[str] = IGNORED) -> Column:
    return path.rlike(ignored_regex(patterns))


def ancestors(path: Column) -> Column:
    """Directories above an absolute path: /a/b/c has /, /a, /a/b."""
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    upto = F.sequence(F.lit(0), F.size(parts) - 1)
    return F.transform(upto, lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def is_pruned(path: Column, root: str, patterns: list[str] = IGNORED) -> Column:
    """A file beneath ``root`` is left out if its name or the absolute path of a
    directory between root and file is ignored. Directories are looked at one
    by one only if some part of the path would do."""
    name = basename(path)
    maybe = path.rlike(ignored_regex(patterns, "/"))
    root = root.rstrip("/") or "/"
    inside = F.filter(ancestors(path), lambda d: (d == root) | d.startswith(root.rstrip("/") + "/"))
    return is_ignored(name, patterns) | maybe & F.exists(inside, lambda d: is_ignored(d, patterns))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; the root keeps its slash."""
    head = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*\\z", "")).otherwise(F.lit(""))
    return F.when((head == "") & path.startswith("/"), F.lit("/")).otherwise(head)


def normal_path(path: Column) -> Column:
    """Lexical normal form: no empty, ``.`` or resolvable ``..`` parts."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(kept: Column, p: Column) -> Column:
        top = F.try_element_at(kept, F.lit(-1))
        pop = (p == "..") & F.coalesce(top != "..", F.lit(False))
        drop = (p == "..") & rooted & (F.size(kept) == 0)
        return F.when(pop, F.slice(kept, F.lit(1), F.size(kept) - 1)).when(drop, kept).otherwise(F.concat(kept, F.array(p)))

    kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    text = F.array_join(kept, "/")
    return F.when(path.isNull(), None).when(rooted, F.concat(F.lit("/"), text)).when(text == "", F.lit(".")).otherwise(text)


def relative_path(path: Column, start: str) -> Column:
    """Normal form, relative to ``start`` if strictly below it. Lexical: links
    are resolved by ``real_path``, where the paths are of files that are there."""
    clean = normal_path(path)
    base = posixpath.normpath(start)
    below = base.rstrip("/") + "/" if base != "/" else "//"
    out = F.when(clean.startswith(below), F.substr(clean, F.lit(len(below) + 1))).otherwise(clean)
    return F.replace(out, F.lit("\\"), F.lit("/"))


@pandas_udf(T.StringType())
def _real_path(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else os.path.realpath(p))


def real_path(path: Column) -> Column:
    """The path with its links resolved, on the file system of the executors. A
    column of its own: the lexical functions here take columns, not such calls."""
    return _real_path(path)


def same_path(a: Column, b: Column) -> Column:
    return normal_path(a) == normal_path(b)


def is_below(path: Column, directory: str) -> Column:
    return normal_path(path).startswith(posixpath.normpath(directory).rstrip("/") + "/")


def under_root(path: Column, root: str) -> Column:
    """The root itself or anything below it."""
    root = root.rstrip("/")
    return (path == (root or "/")) | path.startswith(root + "/")


def is_gzip(path: Column) -> Column:
    return F.lower(path).endswith(".gz")


def uncompressed_path(path: Column) -> Column:
    return F.when(is_gzip(path), F.substring(path, F.lit(1), F.length(path) - 3)).otherwise(path)


# The forms of sizes, times and result lines below.

def format_bytes(n: Column) -> Column:
    """Size in steps of 1024 with two decimals, ties to even."""
    out = F.format_string("%.2f PB", F.bround(n / F.lit(float(1024**5)), 2))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        out = F.when(n < F.lit(1024 ** (power + 1)), F.format_string(f"%.2f {unit}", F.bround(n / F.lit(float(1024**power)), 2))).otherwise(out)
    return F.when(n.isNotNull(), out)


def utc_stamp(seconds: Column) -> Column:
    """Whole seconds in the form 2024-01-31T23:59:59Z; the session is in UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def result_line(updated_at: Column, inode: Column, algo: Column, value: Column, path: Column) -> Column:
    """Time, inode, algo:hash and path in padded columns; session time zone."""
    stamp = F.date_format(F.timestamp_seconds(F.floor(updated_at)), "yyyy-MM-dd'T'HH:mm:ss")
    return F.format_string("%-20s %-10s %-35s %s", stamp, inode, F.concat_ws(":", algo, value), path)

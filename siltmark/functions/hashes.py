"""Content hashes as column expressions.

Every entry of the registry maps a binary column to the hash's text form; null
content has a null hash. md5, sha256, sha512, crc32 and xxh64 are built-in
expressions and stay inside generated code; xxh3 and c4 need Arrow UDFs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

DEFAULT_ALGO = "xxh64"

#: Fixed value: hashing this long with Spark's own seed leaves state 0, so that
#: the next column is hashed with seed 0 as the public XXH64 does by default.
XXH64_ZERO_STATE = -365884300664092260

#: Fixed value: the base-58 alphabet of c4 identifiers.
C4_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
C4_DIGITS = 88


_PAIRS = [a + b for a in C4_ALPHABET for b in C4_ALPHABET]
_CHUNK = 58**10


def c4_text(digest: bytes) -> str:
    """Identifier of a SHA-512 digest: the number in base 58 after "c4", filled
    up on the right with the digit of zero. Ten digits are split off the large
    number at a time, and taken apart by twos."""
    n, texts = int.from_bytes(digest, "big"), []
    while n:
        n, chunk = divmod(n, _CHUNK)
        for _ in range(5):
            chunk, pair = divmod(chunk, 58 * 58)
            texts.append(_PAIRS[pair])
    zero = C4_ALPHABET[0]
    return "c4" + "".join(reversed(texts)).lstrip(zero).ljust(C4_DIGITS, zero)


def c4_texts(digests: bytes) -> list[str]:
    """``c4_text`` of many digests, one after another in ``digests``: long
    division of all of them at once, by 58**5, in limbs of 32 bits."""
    limbs = np.frombuffer(digests, ">u4").reshape(-1, 16).astype(np.uint64)
    base, digits = np.uint64(58**5), np.empty((len(limbs), 90), np.uint8)
    for at in range(85, -1, -5):
        rest = np.zeros(len(limbs), np.uint64)
        for j in range(16):
            part = (rest << np.uint64(32)) | limbs[:, j]
            limbs[:, j] = part // base
            rest = part - limbs[:, j] * base
        for d in range(at + 4, at - 1, -1):
            rest, digits[:, d] = rest // np.uint64(58), rest % np.uint64(58)
    some = digits.any(axis=1)
    lead = np.where(some, (digits != 0).argmax(axis=1), 90)
    text = np.frombuffer(C4_ALPHABET.encode(), np.uint8)[digits].tobytes().decode("ascii")
    zero = C4_ALPHABET[0]
    return ["c4" + text[90 * i + k : 90 * i + 90].ljust(C4_DIGITS, zero) for i, k in enumerate(lead.tolist())]


@pandas_udf(T.StringType())
def _xxh3_64(content: pd.Series) -> pd.Series:
    import xxhash

    return content.map(lambda b: None if b is None else xxhash.xxh3_64_hexdigest(b))


@pandas_udf(T.StringType())
def _xxh3_128(content: pd.Series) -> pd.Series:
    import xxhash

    return content.map(lambda b: None if b is None else xxhash.xxh3_128_hexdigest(b))


@pandas_udf(T.StringType())
def _c4(sha512_hex: pd.Series) -> pd.Series:
    known = sha512_hex.notna()
    out = pd.Series([None] * len(sha512_hex), index=sha512_hex.index, dtype=object)
    out[known] = c4_texts(bytes.fromhex("".join(sha512_hex[known])))
    return out


def _xxh64(content: Column) -> Column:
    value = F.xxhash64(F.lit(XXH64_ZERO_STATE).cast("long"), content)
    return F.when(content.isNotNull(), F.lower(F.lpad(F.hex(value), 16, "0")))


#: Name -> expression, in the order used wherever several algorithms are tried.
HASHES: dict[str, Callable[[Column], Column]] = {
    "null": lambda c: F.when(c.isNotNull(), F.lit("")),
    "md5": F.md5,
    "sha256": lambda c: F.sha2(c, 256),
    "sha512": lambda c: F.sha2(c, 512),
    "crc32": lambda c: F.lower(F.lpad(F.hex(F.crc32(c)), 8, "0")),
    "xxh64": _xxh64,
    "xxh3_64": lambda c: _xxh3_64(c),
    "xxh3_128": lambda c: _xxh3_128(c),
    "c4": lambda c: _c4(F.sha2(c, 512)),
}


#: Name -> maker of an object with ``update(bytes)`` and ``hexdigest()``, of added algorithms.
_ADDED: dict[str, Callable] = {}


def register(name: str, expression: Callable[[Column], Column], maker: Callable | None = None) -> None:
    """Add an algorithm under its own name: an expression over contents and, for
    files too large for a column value, a maker of incremental hashers (which
    goes to the tasks, so it must be picklable)."""
    HASHES[name] = expression
    if maker is not None:
        _ADDED[name] = maker


def content_hash(content: Column, algo: str = DEFAULT_ALGO) -> Column:
    if algo not in HASHES:
        raise ValueError(f"unknown hash algorithm {algo!r}; known: {', '.join(HASHES)}")
    return HASHES[algo](content)


def text_hash(text: Column, algo: str = DEFAULT_ALGO) -> Column:
    """Hash of the text's UTF-8 bytes."""
    return content_hash(F.encode(text, "utf-8"), algo)


class _Crc32:
    def __init__(self):
        self._value = 0

    def update(self, data: bytes) -> None:
        self._value = zlib.crc32(data, self._value)

    def hexdigest(self) -> str:
        return f"{self._value:08x}"


class _Null:
    def update(self, data: bytes) -> None:
        pass

    def hexdigest(self) -> str:
        return ""


class _C4:
    def __init__(self):
        self._sha = hashlib.sha512()

    def update(self, data: bytes) -> None:
        self._sha.update(data)

    def hexdigest(self) -> str:
        return c4_text(self._sha.digest())


def hasher_maker(algo: str) -> Callable:
    """What makes an incremental hasher. Tasks are handed the maker, not the
    name: the registry of another process may not know it."""
    import xxhash

    makers = {"null": _Null, "md5": hashlib.md5, "sha256": hashlib.sha256, "sha512": hashlib.sha512, "crc32": _Crc32,
              "xxh64": xxhash.xxh64, "xxh3_64": xxhash.xxh3_64, "xxh3_128": xxhash.xxh3_128, "c4": _C4, **_ADDED}
    if algo not in makers:
        raise ValueError(f"unknown hash algorithm {algo!r}; known: {', '.join(makers)}")
    return makers[algo]


def hasher(algo: str):
    """An incremental hasher, for streams too large for a column value."""
    return hasher_maker(algo)()

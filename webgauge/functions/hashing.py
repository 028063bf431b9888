"""Content digests and 64-bit text fingerprints.

The fingerprint of a text is built from its tokens: runs of three tokens (all but the
last run) are hashed to 64 bits, and each output bit is the majority of the inverted
input bits, in reverse order.  ``simhash`` does this in Arrow batches; ``simhash_sql``
is the same as one column expression, for engines without Python.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

try:
    import regex
except ImportError:  # pragma: no cover
    regex = None

WIDTH = 3
MEMO = 100_000  # words whose hashes a worker holds
TOKEN_PATTERN = "[\\p{L}\\p{N}]+"


def tokens(text: Column) -> Column:
    """Letters-and-digits tokens of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def java_hash(word: Column) -> Column:
    """The 32-bit string hash over UTF-16 units, as an unsigned number."""
    units = F.encode(word, "UTF-16BE")
    step = F.sequence(F.lit(1), F.expr("1") * (F.octet_length(units) / 2).cast("int"))
    unit = lambda i: F.conv(F.substr(F.hex(units), (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("long")
    value = F.aggregate(step, F.lit(0).cast("long"), lambda a, i: (a * 31 + unit(i)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.length(word) == 0, F.lit(0).cast("long")).otherwise(value)


def shingle_keys(words: Column, width: int = WIDTH, include_last: bool = False) -> Column:
    """Distinct runs of ``width`` tokens, each as one string.

    Strings are told apart by their hashes, arrays pair by pair; and a slice copies all of its array,
    so tokens are taken one by one.  Between tokens stands \\0; of a token, \\1a is \\1, \\1b is \\0, \\1c is null.
    """
    last = F.size(words) - width + (1 if include_last else 0)
    odd = lambda w: F.contains(w, F.lit("\0")) | F.contains(w, F.lit("\1"))
    escaped = lambda w: F.replace(F.replace(w, F.lit("\1"), F.lit("\1a")), F.lit("\0"), F.lit("\1b"))
    plain = F.transform(words, lambda w: F.when(w.isNull(), F.lit("\1c")).when(odd(w), escaped(w)).otherwise(w))
    runs = lambda p: F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.concat_ws("\0", *[F.get(p, i + k) for k in range(width)]))
    found = F.transform(F.array(plain), lambda p: F.array_distinct(runs(p)))[0]  # plain is worked out once
    return F.when(last >= 1, found).otherwise(F.array().cast("array<string>"))


def shingles(words: Column, width: int = WIDTH, include_last: bool = False) -> Column:
    """Distinct runs of ``width`` tokens; the last run is dropped unless asked for."""
    back = lambda w: F.when(w != "\1c", F.replace(F.replace(w, F.lit("\1b"), F.lit("\0")), F.lit("\1a"), F.lit("\1")))
    return F.transform(shingle_keys(words, width, include_last), lambda key: F.transform(F.split(key, "\0"), back))


def shingle_hash(run: Column) -> Column:
    """First eight bytes, signed, of the MD5 of the tokens' 32-bit hashes."""
    units = F.concat_ws("", F.transform(run, lambda w: F.lpad(F.hex(java_hash(w)), 8, "0")))
    return F.conv(F.substring(F.md5(F.unhex(units)), 1, 16), 16, -10).cast("long")


def simhash_sql(words: Column, width: int = WIDTH, include_last: bool = False) -> Column:
    """Fingerprint of a token array as a column expression."""
    hashes = F.array_distinct(F.transform(shingles(words, width, include_last), shingle_hash))

    def with_bit(acc: Column, bit: Column) -> Column:
        zeros = F.size(F.filter(hashes, lambda h: F.call_function("shiftrightunsigned", h, bit).bitwiseAND(F.lit(1).cast("long")) == 0))
        return acc.bitwiseOR(F.when(2 * zeros > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(63) - bit)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), with_bit)


def _java_hash(word: str) -> bytes:
    value = 0
    units = word.encode("utf-16-be", "surrogatepass")
    for k in range(0, len(units), 2):
        value = (value * 31 + units[k] * 256 + units[k + 1]) & 0xFFFFFFFF
    return value.to_bytes(4, "big")


_PLAIN = re.compile(r"[^\W_]+")
_SEGMENT = regex.compile(r"(?w)\b(?=[\p{L}\p{N}]).+?\b", regex.V1) if regex else None
_TOKEN = regex.compile(TOKEN_PATTERN) if regex else _PLAIN


def tokenize(text: str, mode: str = "regex") -> list[str]:
    """Tokens of a text: ``regex`` as in ``tokens``; ``uax29`` at Unicode word boundaries."""
    if mode == "uax29" and _SEGMENT is not None:
        return [w.lower() for w in _SEGMENT.findall(text)]
    return _TOKEN.findall(text.lower())


def fingerprint(words: list[str], width: int = WIDTH, include_last: bool = False, memo: dict | None = None) -> int:
    """Fingerprint of a token list."""
    n = len(words) - width + (1 if include_last else 0)
    if n <= 0:
        return 0
    memo = {} if memo is None else memo
    parts = []
    for w in words:
        h = memo.get(w)
        if h is None:
            if len(memo) > MEMO:
                memo.clear()
            h = memo[w] = _java_hash(w)
        parts.append(h)
    digests = {hashlib.md5(b"".join(parts[k : k + width])).digest()[:8] for k in range(n)}
    # unpacked bit 0 is the highest one; output bit 63 - i is the vote on input bit i
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    zeros = len(bits) - bits.sum(axis=0)
    chosen = (2 * zeros > len(bits)).astype(np.uint8)[::-1]
    return int(np.packbits(chosen).view(">i8")[0])


@F.arrow_udf(LongType())
def simhash(text: pa.Array) -> pa.Array:
    """Fingerprint of a text (regex tokens); null for null.  Of an Arrow batch one text at a time is a Python string."""
    memo: dict = {}
    return pa.array((None if (t := x.as_py()) is None else fingerprint(tokenize(t), memo=memo) for x in text), pa.int64())


@F.pandas_udf(LongType())
def simhash_words(text: pd.Series) -> pd.Series:
    """Fingerprint of a text (Unicode word boundaries); null for null."""
    memo: dict = {}
    return pd.Series([None if t is None else fingerprint(tokenize(t, "uax29"), memo=memo) for t in text], dtype="Int64")


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def md5_stripped(content: Column) -> Column:
    """MD5 in hexadecimal without leading zeros."""
    return F.regexp_replace(F.md5(content), "^0+(?=.)", "")

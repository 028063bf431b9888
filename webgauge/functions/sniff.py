"""Media types, status classes and character sets."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SNIFFED = 131_072
# fixed values: substrings of media types whose text is of use
QUALIFYING = ["pdf", "word", "powerpoint", "office", "excel", "html", "sgml", "xml", "text", "rtf"]
_DECLARED = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)
_MARKS = [(codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF32_LE, "UTF-32LE"), (codecs.BOM_UTF32_BE, "UTF-32BE"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")]


def mime_qualifies(mime: Column) -> Column:
    return F.coalesce(F.lower(mime).rlike("|".join(QUALIFYING)), F.lit(False))


def status_qualifies(code: Column) -> Column:
    """2xx; what is no number counts as 200."""
    return F.coalesce(code.try_cast("int"), F.lit(200)).between(200, 299)


def is_html(mime: Column) -> Column:
    return F.coalesce(mime.startswith("text/html"), F.lit(False))


def mime_type(content: Column) -> Column:
    """Media type of a payload by its first bytes (stateless)."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    case = F.when(head.startswith("25504446"), "application/pdf")
    # fixed values: signatures of file formats
    for mark, kind in [("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("424D", "image/bmp"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("D0CF11E0", "application/msword"), ("7B5C727466", "application/rtf")]:
        case = case.when(head.startswith(mark), kind)
    case = case.when(text.rlike("^\\s*(?:<\\?xml[^>]*>\\s*)?(?:<!--[\\s\\S]*?-->\\s*)*<(?:!doctype\\s+html|html|head|body|title|h1|p|div|script|table|a )"), "text/html")
    case = case.when(text.rlike("^\\s*<\\?xml"), "application/xml").when(F.length(content) == 0, None)
    return case.when(text.rlike("[\\x00-\\x08\\x0E-\\x1A]"), "application/octet-stream").otherwise("text/plain")


def charset(content: bytes) -> str:
    """Byte-order mark, else UTF-8 if valid, else the declared set, else windows-1252."""
    head = content[:SNIFFED]
    for mark, name in _MARKS:
        if head.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, len(content) <= SNIFFED)
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    declared = _DECLARED.search(head)
    if declared:
        try:
            return codecs.lookup(declared.group(1).decode("ascii")).name
        except LookupError:
            pass
    return "windows-1252"


# tried in this order on the bytes from the first non-ASCII one on; a multi-byte set must decode them strictly
_MULTIBYTE = ["utf-8", "euc_jp", "shift_jis", "euc_kr", "gb18030", "big5"]


def charset_alt(content: bytes) -> str:
    """A second opinion, from the bytes alone: plain ASCII reads as UTF-8; else the first set that
    decodes the non-ASCII part into letters mostly; UTF-8 if there is none."""
    head = content[:SNIFFED]
    first = next((k for k, b in enumerate(head) if b >= 0x80), None)
    if first is None:
        return "UTF-8"
    part = head[first:]
    for name in _MULTIBYTE:
        try:
            text = codecs.getincrementaldecoder(name)().decode(part, len(content) <= SNIFFED)
        except UnicodeDecodeError:
            continue
        strange = [c for c in text if ord(c) >= 0x80]
        if name == "utf-8" or sum(c.isalpha() for c in strange) * 10 >= len(strange) * 8 and not any("\ue000" <= c <= "\uf8ff" for c in strange):
            return "UTF-8" if name == "utf-8" else name
    text = part.decode("windows-1252", "replace")
    strange = [c for c in text if ord(c) >= 0x80]
    return "windows-1252" if sum(c.isalpha() for c in strange) * 2 >= len(strange) else "UTF-8"


def decode(content: bytes | None) -> str | None:
    return None if content is None else content.decode(charset(content), "replace")


@F.pandas_udf(StringType())
def detect_charset(content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else charset(c) for c in content])

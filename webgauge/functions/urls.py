"""URL functions.

``absolute_url`` resolves links by path segments rather than by the RFC: the base's
query goes, a link's query and fragment are part of its last segment, an empty link is
the base's folder.  ``strict_rfc=True`` resolves by the RFC instead.
"""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(url: Column, name: str) -> Column:
    """A part of a URL (PROTOCOL, HOST, AUTHORITY, PATH, ...), null if it cannot be parsed."""
    return F.try_parse_url(url, F.lit(name))


def path(url: Column) -> Column:
    """The decoded path; empty if the URL cannot be parsed."""
    return F.coalesce(F.try_url_decode(F.replace(part(url, "PATH"), F.lit("+"), F.lit("%2B"))), part(url, "PATH"), F.lit(""))


def is_http(url: Column) -> Column:
    return url.rlike("^https?://")


def in_domain(url: Column, domain: Column | str) -> Column:
    """Whether an http(s) URL's host is the domain or below it (case matters)."""
    domain = F.lit(domain) if isinstance(domain, str) else domain
    host = part(url, "HOST")
    return F.coalesce(is_http(url) & ((host == domain) | F.endswith(host, F.concat(F.lit("."), domain))), F.lit(False))


def strip_www(domain: Column) -> Column:
    """Drops the first label if the domain begins with www."""
    return F.when(domain.startswith("www"), F.regexp_replace(domain, "^[^.]*\\.", "")).otherwise(domain)


def proper_prefixes(url: Column) -> Column:
    """scheme://authority/s1/../si for each i from 1 to one less than the number of path segments; null if unparsable."""
    names = F.filter(F.split(path(url), "/"), lambda s: s != "")
    slash = path(url).endswith("/").cast("int")
    n = F.size(names) - 1 + slash
    base = F.concat(part(url, "PROTOCOL"), F.lit("://"), part(url, "AUTHORITY"), F.lit("/"))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(base, F.array_join(F.slice(names, 1, i), "/")))).otherwise(F.array().cast("array<string>"))


def resolve(base: str | None, link: str | None, strict_rfc: bool = False) -> str | None:
    if base is None or link is None:
        return None
    if link.startswith(("http://", "https://")):
        return link
    try:
        root = urlsplit(base)
        if not root.scheme or not root.netloc:
            return None
        if strict_rfc:
            return urljoin(base, link)
    except ValueError:
        return None
    stack = [] if link.startswith("/") else [s for s in root.path.split("/")[1:]]
    while stack and stack[-1] == "":
        stack.pop()
    if not link.startswith("/") and not base.endswith("/"):
        if stack:
            stack.pop()
        elif root.path == "/":
            return None
    names = link.split("/")
    while names and names[-1] == "" and len(names) > 1:
        names.pop()
    for k, name in enumerate(names):
        if name == "..":
            if stack:
                stack.pop()
        elif name != "." and not (k == 0 and link.startswith("/")):
            stack.append(name)
    return f"{root.scheme}://{root.netloc}/" + "/".join(stack)


def absolute_url(base: Column | str, link: Column | str) -> Column:
    """``resolve`` as a column expression."""
    base, link = (F.col(c) if isinstance(c, str) else c for c in (base, link))
    none = F.array().cast("array<string>")
    root = lambda k: F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)", k)
    rooted = link.startswith("/")
    path = F.split(F.regexp_replace(root(3), "/+$", ""), "/")
    folder = F.slice(path, 2, F.size(path))
    here = F.when(rooted, none).when(base.endswith("/"), folder).otherwise(F.slice(folder, 1, F.greatest(F.size(folder) - 1, F.lit(0))))
    names = F.split(F.regexp_replace(link, "(?<=[^/])/+$", ""), "/")
    names = F.when(link.rlike("^/+$"), none).when(rooted, F.slice(names, 2, F.size(names))).otherwise(names)
    step = lambda at, name: F.when(name == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).when(name == ".", at).otherwise(F.concat(at, F.array(name)))
    target = F.concat(F.lower(root(1)), F.lit("://"), root(2), F.lit("/"), F.array_join(F.aggregate(names, here, step), "/"))
    nowhere = (root(2) == "") | ~rooted & ~base.endswith("/") & (F.size(folder) == 0) & (root(3) == "/")
    return F.when(base.isNull() | link.isNull(), None).when(link.rlike("^https?://"), link).when(~nowhere, target)


def status_code(first_line: Column) -> Column:
    """Status of an HTTP status line; null if there is none."""
    return F.when(first_line.startswith("HTTP"), F.try_element_at(F.split(first_line, " "), F.lit(2)).try_cast("int"))


def location_header(header: Column) -> Column:
    """Value of the first header line that begins with Location."""
    return F.nullif(F.trim(F.regexp_extract(header, "(?m)^Location[^:\\r\\n]*:([^\\r\\n]*)", 1)), F.lit(""))

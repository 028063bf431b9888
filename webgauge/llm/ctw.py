"""Operator 10: language-model scoring by context-tree weighting over bytes.

Model.  A text is its UTF-8 bytes, A-Z folded, and an end symbol.  Each byte is
eight binary decisions.  The context of a decision is the bits of the byte so far
and up to ``DEPTH`` preceding bytes.  Every context of every length keeps a
Krichevsky-Trofimov estimator; the weighted probability of a node is half its own
estimate plus half the product over its children (Willems, Shtarkov and Tjalkens,
1995).  Learning is counting, so it is order-free: the counts of all
(DEPTH + 1)-byte grams of the training texts hold every node, and the weighted
probabilities follow from them bottom-up.  A text's score is the log10 of the
predictive probability that the trained tree gives to its bytes, each decision
mixing the estimates of all depths by their posterior weights.

Beside it stands the base score, an add-0.1 unigram model of words.

Plan.  Pass 1 counts words and grams of the training texts (merged per slice,
dealt out packed by hash).  Grams are dealt by their ``DEALT`` = 3 latest context bytes, so a
part holds whole subtrees, and the most frequent pair of bytes is spread over 256 of them;
the levels above have at most 255 nodes for each pair of bytes that occurs (in UTF-8 text
a few thousand pairs; never more than 65,536), which the driver finishes.  There are as
many parts as hold about ``PART_BYTES`` of training text each, within limits.
Pass 2 scores all texts.  The ``HOT_WORDS`` and ``HOT_GRAMS`` most
frequent entries are broadcast (fixed size); all other occurrences go, packed, to
the part that holds their counts and are added there, so every occurrence is scored
with its true count and in double precision.

Edge cases: null text is empty and has the end token alone; a row with null doc_id
is not held out and not learned from; rows repeated in full are scored (and counted
in training) each; extra columns are ignored; an empty table gives no rows; without
training texts N and V are 0 and all nodes are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .batches import blobs, int64, pieces, split_by
from .common import materialize, read, remainder

DEPTH = 5
DEALT = 3
PART_BYTES = 8 << 20
MOST_PARTS = 1 << 14
START, END = 0xFE, 0xFF  # no byte of UTF-8
HOT_WORDS = 1 << 18
HOT_GRAMS = 1 << 19
ADD = 0.1
MERGE = 400_000  # distinct entries held by a task before they are sent on
SEND = 250_000  # occurrences of other entries held by a task
PIECE = 1 << 19
CELL = 256  # occurrences in a packed row
U = np.uint64

_LOG_HALF = float(np.log(0.5))


# ---- grams and nodes -------------------------------------------------------------------------


def grams(column: pa.Array, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of grams (context bytes and the byte, latest lowest) with the index of their text."""
    data, offsets = K.buffers(column)
    k, n = 0, len(offsets) - 1
    while k < n:  # some texts, or a part of a long one, at a time
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + K.CHUNK, side="right")) - 1)
        if stop == k + 1 and offsets[stop] - offsets[k] > 2 * K.CHUNK:
            lo, hi = int(offsets[k]), int(offsets[stop])
            for at in range(lo, hi, K.CHUNK):
                to = min(at + K.CHUNK, hi)
                before = K.LOWER[data[max(lo, at - depth) : at]]
                run = np.concatenate([np.full(depth - len(before), START, np.uint8), before, K.LOWER[data[at:to]], np.full(int(to == hi), END, np.uint8)])
                keys = _keys(run, depth)
                yield keys, np.full(len(keys), k)
        else:
            sizes = np.diff(offsets[k : stop + 1])
            run = np.full(int(sizes.sum()) + (depth + 1) * (stop - k), START, np.uint8)
            begins = np.concatenate(([0], np.cumsum(sizes + depth + 1)))[:-1] + depth
            shift = np.repeat(begins - offsets[k:stop], sizes)
            run[np.arange(offsets[k], offsets[stop]) + shift] = K.LOWER[data[offsets[k] : offsets[stop]]]
            run[begins + sizes] = END
            keys = _keys(run, depth)
            real = run[depth:] != START
            yield keys[real], np.repeat(np.arange(k, stop), sizes + 1)
        k = stop


def _keys(run: np.ndarray, depth: int) -> np.ndarray:
    keys = np.zeros(max(0, len(run) - depth), U)
    for k in range(depth + 1):
        keys |= run[depth - k : len(run) - k].astype(U) << U(8 * k)
    return keys


def dealt(depth: int) -> int:
    """The number of context bytes by which grams are dealt, which is the shallowest level of a part."""
    return min(DEALT, depth)


def gram_part(keys: np.ndarray, parts: int, depth: int) -> np.ndarray:
    return (K.mix((keys >> U(8)) & U((1 << 8 * dealt(depth)) - 1)) % U(parts)).astype(np.int64)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting x above 8."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    low = x < 8
    y = np.where(low, x + 8, x)
    if low.any():
        part = x[low]
        product = np.ones_like(part)
        for k in range(8):
            product *= part + k
        shift[low] = np.log(product)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def decisions(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits: (context << 8 | bits so far) and the bit."""
    byte, context = keys & U(255), (keys >> U(8)) << U(8)
    for i in range(8):
        yield context | U(1 << i) | (byte >> U(8 - i)), (byte >> U(7 - i)) & U(1)


def _fold(nodes, *columns):
    order = np.argsort(nodes, kind="stable")
    nodes = nodes[order]
    first = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1]))) if len(nodes) else np.zeros(0, np.int64)
    return (nodes[first], *[np.add.reduceat(c[order], first) if len(first) else c for c in columns])


class Level:
    """Nodes of one depth: sorted keys, P(1), and the posterior weight of the node's own estimate."""

    def __init__(self, nodes, zeros, ones, below):
        self.nodes, self.zeros, self.ones = nodes, zeros, ones
        own = log_kt(zeros, ones)
        if below is None:
            self.log, self.weight = own, np.ones(len(nodes))
        else:
            self.log = np.logaddexp(own, below) + _LOG_HALF
            self.weight = np.exp(np.minimum(own + _LOG_HALF - self.log, 0))
        self.one = (ones + 0.5) / (zeros + ones + 1.0)

    def above(self, depth: int) -> Level:
        """The level whose contexts are one byte shorter; ``depth`` is its depth."""
        mask = U((1 << (8 * depth + 8)) - 1)
        return Level(*_fold(self.nodes & mask, self.zeros, self.ones, self.log))

    def blend(self, keys, deeper):
        at, there = K.find(self.nodes, keys)
        if not len(self.nodes):
            return deeper
        w = self.weight[at]
        return np.where(there, w * self.one[at] + (1 - w) * deeper, deeper)


def subtrees(keys: np.ndarray, counts: np.ndarray, depth: int) -> list[Level]:
    """Levels depth, depth - 1, ..., dealt(depth) of the contexts in a part, of sorted keys."""
    folded = []
    for node, bit in decisions(keys):  # in the order of the keys, so equal nodes are neighbours
        ones = counts * bit.astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(x, first) if len(first) else x for x in (counts, ones)]
        folded.append((node[first], sums[0] - sums[1], sums[1]))
    nodes, zeros, ones = (np.concatenate(c) for c in zip(*folded, strict=True))
    order = np.argsort(nodes, kind="stable")
    found = [Level(nodes[order], zeros[order], ones[order], None)]
    for d in range(depth - 1, dealt(depth) - 1, -1):
        found.append(found[-1].above(d))
    return found


def no_subtrees(depth: int) -> list[Level]:
    return [Level(np.zeros(0, U), np.zeros(0), np.zeros(0), None)] * (depth - dealt(depth) + 1)


def log10_of(keys: np.ndarray, levels: list[Level], depth: int) -> np.ndarray:
    """log10 of the predictive probability of each gram; levels from the deepest to the root."""
    total = np.zeros(len(keys))
    for node, bit in decisions(keys):
        p = np.full(len(keys), 0.5)
        for d, level in zip(range(depth, -1, -1), levels, strict=True):
            p = level.blend(node & U((1 << (8 * d + 8)) - 1), p)
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return total


# ---- counting --------------------------------------------------------------------------------

_PACK = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
WORD_KIND, GRAM_KIND = 0, 1


class _Merger:
    """Sums counts by key, and gives them up in packed rows."""

    def __init__(self, kind: int, parts: int, depth: int):
        self.kind, self.parts, self.depth, self.keys, self.counts, self.size = kind, parts, depth, [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = K.tally(keys)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)

    def full(self) -> bool:
        if self.size > 2 * MERGE:
            k, c = K.tally(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [k], [c], len(k)
        return self.size > MERGE and len(self.keys) == 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            keys, counts = K.tally(np.concatenate(self.keys), np.concatenate(self.counts))
            at = gram_part(keys, self.parts, self.depth) if self.kind == GRAM_KIND else (keys % U(self.parts)).astype(np.int64)
            for k, (v, c) in split_by(at, self.parts, keys, counts.astype(np.int64)):
                yield pa.RecordBatch.from_pydict({"kind": [self.kind], "part": [k], "keys": [v.tobytes()], "counts": [c.astype(np.uint32).tobytes()]}, schema=_PACK)
        self.keys, self.counts, self.size = [], [], 0


def _count(parts: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, byte_grams = _Merger(WORD_KIND, parts, depth), _Merger(GRAM_KIND, parts, depth)
        for batch in pieces(batches, 0, PIECE):
            words.add(K.words(batch.column(0))[0])
            for keys, _ in grams(batch.column(0), depth):
                byte_grams.add(keys)
                if byte_grams.full():
                    yield from byte_grams.rows()
            if words.full():
                yield from words.rows()
        yield from words.rows()
        yield from byte_grams.rows()

    return run


_COUNTED = "kind int, part long, keys binary, counts binary, total long, entries long, sizes array<long>"
_COUNTED_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("entries", pa.int64()), ("sizes", pa.list_(pa.int64()))])


def _sum(table: pa.Table) -> pa.Table:
    keys, counts = K.tally(blobs(table["keys"], U), blobs(table["counts"], np.uint32).astype(np.int64))
    sizes = np.bincount(np.log2(counts).astype(np.int64), minlength=63)
    return pa.table(
        {"kind": [table["kind"][0].as_py()], "part": [table["part"][0].as_py()], "keys": [keys.tobytes()], "counts": [counts.astype(np.int64).tobytes()], "total": [int(counts.sum())], "entries": [len(keys)], "sizes": [sizes.tolist()]},
        schema=_COUNTED_ARROW,
    )


def _floor_count(counted: DataFrame, kind: int, limit: int) -> int:
    """Least count (a power of two) such that at most ``limit`` entries have it."""
    rows = counted.where(F.col("kind") == kind).agg(F.array(*[F.sum(F.col("sizes")[k]) for k in range(63)])).first()[0]
    total, least = 0, 63
    while least > 0 and total + (rows[least - 1] or 0) <= limit:
        least -= 1
        total += rows[least] or 0
    return 1 << least


def _collect_hot(rows: DataFrame, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts, values) rows -> sorted keys of entries counted floor times at least, and their values."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c, v in zip(*(batch.column(i) for i in range(3)), strict=True):
                top = np.frombuffer(c.as_buffer(), np.int64) >= floor
                yield pa.RecordBatch.from_pydict({"k": [np.frombuffer(k.as_buffer(), U)[top].tobytes()], "v": [np.frombuffer(v.as_buffer(), np.float64)[top].tobytes()]})

    got = rows.mapInArrow(keep, "k binary, v binary").collect()
    keys = np.concatenate([np.frombuffer(r[0], U) for r in got] or [np.zeros(0, U)])
    values = np.concatenate([np.frombuffer(r[1], np.float64) for r in got] or [np.zeros(0)])
    order = np.argsort(keys)
    return keys[order], values[order]


class HashTable:
    """Open addressing with four probes; a key that finds no place is left out (and so is not hot)."""

    PROBES = 4

    def __init__(self, keys: np.ndarray, values: np.ndarray, kind=np.float64):
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, U(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << bits, kind)
        rest = np.arange(len(keys))
        for probe in range(self.PROBES):
            slot = self._slot(keys[rest], probe)
            free = np.flatnonzero(self.keys[slot] == U(0xFFFFFFFFFFFFFFFF))
            slot, first = np.unique(slot[free], return_index=True)
            chosen = rest[free[first]]
            self.keys[slot], self.values[slot] = keys[chosen], values[chosen]
            rest = np.setdiff1d(rest, chosen, assume_unique=True)

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((K.mix(keys) >> self.shift).astype(np.int64) + probe) & self.mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent) and whether they are there."""
        slot = self._slot(keys, 0)
        there = self.keys[slot] == keys
        values = self.values[slot] * there
        rest = np.flatnonzero(~there)
        for _ in range(1, self.PROBES):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & self.mask
            hit = self.keys[slot[rest]] == keys[rest]
            found = rest[hit]
            there[found] = True
            values[found] = self.values[slot[found]]
            rest = rest[~hit]
        return values, there


# ---- the model and the scores ----------------------------------------------------------------


def _tops(depth: int):
    """Packed gram counts of a part -> its share of the level above its own."""
    mask = U((1 << 8 * dealt(depth)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1), strict=True):
                level = subtrees(np.frombuffer(k.as_buffer(), U), np.frombuffer(c.as_buffer(), np.int64), depth)[-1]
                nodes, zeros, ones, log = _fold(level.nodes & mask, level.zeros, level.ones, level.log)
                yield pa.RecordBatch.from_pydict({"node": nodes.astype(np.int64), "zeros": zeros, "ones": ones, "log": log})

    return run


_TOP_KINDS = (np.int64, np.int64, np.int64, np.float64)


def _pack_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(kind) for c, kind in zip(batch.columns, _TOP_KINDS, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["node", "zeros", "ones", "log"])


def _upper(byte_counts: DataFrame, depth: int) -> list[Level]:
    """The levels dealt(depth) - 1, ..., 0."""
    tops = byte_counts.mapInArrow(_tops(depth), "node long, zeros long, ones long, log double")
    tops = tops.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("log"))
    rows = tops.mapInArrow(_pack_tops, "node binary, zeros binary, ones binary, log binary").collect()
    node, zeros, ones, log = (np.concatenate([np.frombuffer(r[k], kind) for r in rows] or [np.zeros(0, kind)]) for k, kind in enumerate(_TOP_KINDS))
    order = np.argsort(node)
    levels = [Level(node[order].view(U), zeros[order], ones[order], log[order])]
    for d in range(dealt(depth) - 2, -1, -1):
        levels.append(levels[-1].above(d))
    return levels


def _evaluate(depth: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1), strict=True):
                keys, counts = np.frombuffer(k.as_buffer(), U), np.frombuffer(c.as_buffer(), np.int64)
                values = log10_of(keys, [*subtrees(keys, counts, depth), *shared.value], depth)
                yield pa.RecordBatch.from_pydict({"keys": [k.as_py()], "counts": [c.as_py()], "values": [values.tobytes()]})

    return run


def _word_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, c in zip(batch.column(0), batch.column(1), strict=True):
            values = np.log10(np.frombuffer(c.as_buffer(), np.int64) + ADD)
            yield pa.RecordBatch.from_pydict({"keys": [k.as_py()], "counts": [c.as_py()], "values": [values.tobytes()]})


_SCORED = pa.schema(
    [("kind", pa.int32()), ("part", pa.int64()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("words", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
    + [("keys", pa.binary()), ("rids", pa.binary()), ("times", pa.binary())]
)
_SCORED_SQL = "kind int, part long, rid long, doc_id long, held_out boolean, words long, known long, base double, score double, keys binary, rids binary, times binary"


def _score(parts: int, depth: int, shared):
    """Documents -> a row each with what the broadcast entries give, and packed rows of all other occurrences."""

    def cold(kind: int, keys: list[np.ndarray], rids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, r = np.concatenate(keys), np.concatenate(rids)
        order = np.lexsort((k, r))
        k, r = k[order], r[order]
        first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1]))))
        times = np.diff(np.append(first, len(k))).astype(np.uint32)
        k, r = k[first], r[first]
        at = gram_part(k, parts, depth) if kind == GRAM_KIND else (k % U(parts)).astype(np.int64)
        rows: dict[str, list] = {c: [] for c in ("part", "keys", "rids", "times")}
        for p, (v, w, t) in split_by(at, parts, k, r, times):
            for lo in range(0, len(v), CELL):  # small cells: a reader holds thousands of rows at once
                for c, x in (("part", p), ("keys", v[lo : lo + CELL].tobytes()), ("rids", w[lo : lo + CELL].tobytes()), ("times", t[lo : lo + CELL].tobytes())):
                    rows[c].append(x)
        n = len(rows["part"])
        rows["kind"] = [kind] * n
        yield pa.RecordBatch.from_pydict({c.name: rows.get(c.name, [None] * n) for c in _SCORED}, schema=_SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, byte_grams = shared.value
        held: dict[int, tuple[list, list]] = {WORD_KIND: ([], []), GRAM_KIND: ([], [])}
        for batch in pieces(batches, 3, PIECE):
            rids = int64(batch.column(0))
            hashes, at = K.words(batch.column(3))
            values, there = words.get(hashes)
            sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
            score = np.zeros(batch.num_rows)
            owner = np.repeat(rids, np.diff(at))
            if not there.all():
                held[WORD_KIND][0].append(hashes[~there])
                held[WORD_KIND][1].append(owner[~there])
            for keys, text in grams(batch.column(3), depth):
                logs, hot = byte_grams.get(keys)
                score += np.bincount(text, weights=logs, minlength=batch.num_rows)
                if not hot.all():
                    held[GRAM_KIND][0].append(keys[~hot])
                    held[GRAM_KIND][1].append(rids[text[~hot]])
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, -1, np.int32)), none.cast(pa.int64()), batch.column(0), batch.column(1).cast(pa.int64()), batch.column(2)]
                + [pa.array(np.diff(at)), pa.array(sums(there).astype(np.int64)), pa.array(sums(values)), pa.array(score)]
                + [none.cast(pa.binary())] * 3,
                schema=_SCORED,
            )
            for kind, (k, r) in held.items():
                if sum(map(len, k)) > SEND:
                    yield from cold(kind, k, r)
                    held[kind] = ([], [])
        for kind, (k, r) in held.items():
            if k:
                yield from cold(kind, k, r)

    return run


def _add_cold(depth: int, shared):
    """Counts of a part and the occurrences sent to it -> what they add to each document."""
    schema = pa.schema([("rid", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(counted: pa.Table, sent: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return schema.empty_table()
        keys, counts = blobs(counted["keys"], U), blobs(counted["counts"], np.int64)
        asked, rids, times = blobs(sent["keys"], U), blobs(sent["rids"], np.int64), blobs(sent["times"], np.uint32).astype(np.int64)
        distinct, index = np.unique(asked, return_inverse=True)
        known = base = score = np.zeros(len(distinct))
        if sent["kind"][0].as_py() == GRAM_KIND:
            score = log10_of(distinct, [*(subtrees(keys, counts, depth) if len(keys) else no_subtrees(depth)), *shared.value], depth)
        else:
            at, there = K.find(keys, distinct)
            known = there.astype(float)
            base = np.log10((counts[at] * there if len(keys) else 0) + ADD + known * 0)
        rid, *sums = _fold(rids, *[(x[index] * times) for x in (known, base, score)])
        return pa.table([rid, np.rint(sums[0]).astype(np.int64), sums[1], sums[2]], schema=schema)

    return run


def score_documents(docs: DataFrame, held_out, depth: int = DEPTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Scores every row; rows for which ``held_out`` (a boolean column) is not false are not learned from.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"), (~held_out).alias("learn"))
    learned = docs.where("learn").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2 * shuffles, min(learned[1] // PART_BYTES, MOST_PARTS))
    packed = docs.where("learn").select("text").mapInArrow(_count(parts, depth), "kind int, part long, keys binary, counts binary")
    counted = materialize(packed.groupBy("kind", "part").applyInArrow(_sum, _COUNTED))
    ends = learned[0]
    word_total, word_kinds = counted.where(F.col("kind") == WORD_KIND).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("entries"), F.lit(0))).first()
    n, v = word_total + ends, word_kinds + (ends > 0)

    byte_counts = counted.where(F.col("kind") == GRAM_KIND).select("keys", "counts")
    upper = spark.sparkContext.broadcast(_upper(byte_counts, depth))
    scored = materialize(byte_counts.mapInArrow(_evaluate(depth, upper), "keys binary, counts binary, values binary"))
    words = counted.where(F.col("kind") == WORD_KIND).select("keys", "counts").mapInArrow(_word_values, "keys binary, counts binary, values binary")
    hot = spark.sparkContext.broadcast(
        (HashTable(*_collect_hot(words, _floor_count(counted, WORD_KIND, HOT_WORDS))), HashTable(*_collect_hot(scored, _floor_count(counted, GRAM_KIND, HOT_GRAMS))))
    )
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    first = materialize(numbered.mapInArrow(_score(parts, depth, hot), _SCORED_SQL))
    sent = first.where("kind >= 0").select("kind", "part", "keys", "rids", "times")
    added = counted.select("kind", "part", "keys", "counts").groupBy("kind", "part").cogroup(sent.groupBy("kind", "part")).applyInArrow(_add_cold(depth, upper), "rid long, known long, base double, score double")
    added = materialize(added.groupBy("rid").agg(*[F.sum(c).alias(f"more_{c}") for c in ("known", "base", "score")]))
    hot.destroy()
    upper.destroy()
    rows = first.where("kind < 0").select("rid", "doc_id", "held_out", "words", "known", "base", "score").join(added, "rid", "left")
    sure = lambda c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))
    tokens = F.col("words") + 1
    return rows.select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (sure("known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (sure("base") + float(np.log10(ends + ADD)) - tokens * float(np.log10(n + ADD * (v + 1)))).alias("base_score"),
        sure("score").alias("score"),
    )


def op10_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)

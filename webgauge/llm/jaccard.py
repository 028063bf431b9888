"""Operator 3: exact n-gram Jaccard join in the metric space of Jaccard distance.

Documents are sets of 5-word shingles; two link when 100 * intersection >= 75 *
union, that is at distance 1 - J of at most 1/4.  J distance is a metric, and the
join follows the scheme of pivots, Voronoi regions and triangle-inequality
windows, in these steps:

1. Documents with one and the same set are one point (a class).
2. Pivots.  Nearly all pairs of texts are at distance 1, where pivots drawn at
   random tell nothing, so the pivots are chosen by content.  Order the shingles
   of the corpus by any fixed rule; two sets within 1/4 share one of their first
   ``n // 4 + 1`` shingles each.  For each shingle, the least class that has it
   among its first ones leads a region, and all that have it so belong to it: a
   document goes to its own region and is replicated into the others that it
   borders on.  Thus each pair within 1/4 meets in a region, whatever the order;
   the order (rare shingles first) only keeps regions small.  Such a pair also
   shares about an eighth of a set within a prefix half as long again, so a class with
   fewer shared shingles there has no partner and has left before.  The class that
   leads a region is its pivot.
3. Each region is dealt out in chunks, with the pivot in each, and the distance
   of every member to the pivot is computed exactly.  Members within 1/4 link to it.
4. Window.  Of a region there remain the members that did not link, and those that
   did whose distance to the pivot is at least the least of the former less 1/4;
   by the triangle inequality no other member can link to an unlinked one, and two
   that linked are connected already.  What remains is joined again in the same
   way: each unlinked member is the next pivot, with windows over the distances to
   the first one.  Large remainders are split into pairs of blocks.

Step 4 compares every pair that is left, so no link between different texts is
missed that matters to a component.

Order of shingles: those seen in several documents of one task are counted over
the corpus; the ``ORDER_SIZE`` most frequent go last, by magnitude of their count,
and the rest by hash.  This table has a fixed size limit and changes no result.

Plan: three scans of the texts; shuffled are eight bytes for each shingle of the
prefixes (packed, dealt by hash), and the sets of those classes alone that may have a
partner.  A shingle that more than ``LIGHT`` classes of a slice have goes on with the least
of them only, so no part grows with a large group.

Edge cases: null texts and texts without words are empty, link with nothing and
are their own component; fewer than five words form one shingle; rows repeated in
full and ties are members of one class; a null doc_id takes part, and a component
takes its smallest non-null doc_id; extra columns are ignored; an empty table
gives no rows.  Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .batches import blobs, groups, int64, pieces, split_by
from .common import components, key_filter, materialize, passes, read, row_key

WIDTH = 5
SLICE = 2_000_000  # shingles handled at once
PAIR_SLICE = 4_000_000  # and among classes that may have a partner: the larger, the fewer regions a class is in
ORDER_SIZE = 1 << 20
LIGHT = 64
CHUNK = 128
BLOCK = 512


def set_id(s: np.ndarray) -> int:
    """A set's 64-bit id, from two independent sums over its members."""
    a = int(K.mix(s).sum(dtype=np.uint64))
    b = int(K.mix(s ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64))
    both = np.array([a, b, len(s)], dtype=np.uint64)
    return int(K.mix(K.mix(both[:1]) ^ K.mix(both[1:2] + both[2:])).view(np.int64)[0])


def prefix_lengths(n: int) -> tuple[int, int]:
    """(first, long): two sets within distance 1/4 share one of their ``first`` least
    shingles, and ``shared_least`` of their ``long`` least ones."""
    apart = n - -(-3 * n // 4)  # so many members may be missing from the other set
    return apart + 1, min(n, apart + max(1, n // 8))


def shared_least(n):
    """How many of its ``long`` least shingles a set of n members has in common with any
    set within 1/4: that set has 3/4 n members at least, and the smaller prefix decides."""
    return F.greatest(F.lit(1), F.floor(F.ceil(3 * n / 4) / 8))


def _binary(x: np.ndarray) -> bytes:
    return x.tobytes()


def _profile(parts: int):
    """Documents -> one row each (set size and id), and rows with counts of shingles that repeat in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            values, counts = K.tally(np.concatenate(held) if held else np.zeros(0, np.uint64))
            again = counts > 1
            values, counts = values[again], counts[again]
            for k, (v, c) in split_by((values % np.uint64(parts)).astype(np.int64), parts, values, counts):
                yield pa.RecordBatch.from_pydict(
                    {"key": [None], "doc_id": [None], "n": [0], "id": [None], "part": [k], "shingles": [_binary(v)], "counts": [_binary(c.astype(np.int64))]}, schema=_PROFILE
                )

        for batch in pieces(batches, 2):
            ns, ids = [], []
            for s in K.shingle_sets(batch.column(2), WIDTH):
                ns.append(len(s))
                ids.append(set_id(s) if len(s) else None)
                if len(s) and ids[-1] not in seen:
                    seen.add(ids[-1])
                    held.append(s)
                    size += len(s)
            rows = batch.num_rows
            none = pa.nulls(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(ids, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())],
                schema=_PROFILE,
            )
            if size > SLICE:
                yield from flush()
                held, seen, size = [], set(), 0
        yield from flush()

    return run


_PROFILE = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("part", pa.int32()), ("shingles", pa.binary()), ("counts", pa.binary())])


def _sum_counts(table: pa.Table) -> pa.Table:
    values, counts = K.tally(blobs(table["shingles"], np.uint64), blobs(table["counts"], np.int64))
    sizes = np.bincount(np.minimum(np.log2(counts).astype(np.int64), 62), minlength=63) if len(counts) else np.zeros(63, np.int64)
    return pa.table({"shingles": [_binary(values)], "counts": [_binary(counts)], "sizes": [sizes.tolist()]}, schema=pa.schema([("shingles", pa.binary()), ("counts", pa.binary()), ("sizes", pa.list_(pa.int64()))]))


def _frequent(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) with the magnitude of their counts; ORDER_SIZE at most."""
    summed = materialize(profile.where("part is not null").select("part", "shingles", "counts").groupBy("part").applyInArrow(_sum_counts, "shingles binary, counts binary, sizes array<long>"))
    sizes = np.array([r[0] for r in summed.agg(*[F.array(*[F.sum(F.col("sizes")[k]) for k in range(63)])]).collect()][0], dtype=object)
    total, least = 0, 63
    while least > 2 and total + (sizes[least - 1] or 0) <= ORDER_SIZE:
        least -= 1
        total += sizes[least] or 0
    floor = 1 << least

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, c = blobs(batch.column(0), np.uint64), blobs(batch.column(1), np.int64)
            top = c >= floor
            yield pa.RecordBatch.from_pydict({"v": [_binary(v[top])], "c": [_binary(np.log2(np.maximum(c[top], 1)).astype(np.uint8))]})

    rows = summed.select("shingles", "counts").mapInArrow(keep, "v binary, c binary").collect()
    v = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    c = np.concatenate([np.frombuffer(r[1], np.uint8) for r in rows] or [np.zeros(0, np.uint8)])
    order = np.argsort(v)
    return v[order], c[order]


_PACKED = pa.schema([("part", pa.int64()), ("shingles", pa.binary()), ("owners", pa.binary()), ("ids", pa.binary()), ("left", pa.binary()), ("right", pa.binary())])
_PACKED_SQL = "part long, shingles binary, owners binary, ids binary, left binary, right binary"
SHARED = np.uint64(1)  # low bit of a shingle that is already known to be shared


def _runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values, and the run of each value."""
    new = np.concatenate(([True], s[1:] != s[:-1]))
    return np.flatnonzero(new), np.cumsum(new) - 1


def _prefixes(sets: Iterator[tuple[int, np.ndarray]], order, which: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of prefix shingles: (shingles in sorted order, index of the owner, ids of owners)."""
    frequent, magnitude = order
    shingles: list[np.ndarray] = []
    owners: dict[int, None] = {}
    size = 0

    def slice_() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.array(list(owners), np.int64)
        s = np.concatenate(shingles) & ~SHARED
        who = np.repeat(np.arange(len(ids)), [len(x) for x in shingles])
        by = np.lexsort((ids[who], s))
        return s[by], who[by], ids

    for me, s in sets:
        if me in owners:
            continue
        long = prefix_lengths(len(s))[which]
        at, known = K.find(frequent, s)
        s = s[np.lexsort((s, np.where(known, magnitude[at], 0)))[:long]] if known.any() else s[:long]
        shingles.append(s)
        owners[me] = None
        size += long
        if size > most or len(owners) > 30_000:
            yield slice_()
            shingles, owners, size = [], {}, 0
    if owners:
        yield slice_()


def _packed(parts: int, turn: int, s: np.ndarray, who: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Shingles travel as six bytes beside their part: equal ones stay equal, and a chance
    collision only lets a class stay or meet that need not."""

    def row(part: int, *blobs_: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part]), *[pa.array([b], pa.binary()) for b in blobs_]], schema=_PACKED)

    yield row(turn % parts, b"", b"", b"", _binary(left), _binary(right))
    flag = (s & SHARED).astype(np.int64)
    for k, (v, w, f) in split_by(((s >> np.uint64(1)) % np.uint64(parts)).astype(np.int64), parts, s >> np.uint64(16), who, flag):
        here, index = np.unique(w, return_inverse=True)
        six = v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        yield row(k, six.tobytes(), _binary((2 * index + f).astype(np.uint16)), _binary(ids[here]), b"", b"")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Shingles, their owners, whether they are known to be shared; left and right."""
    owners = blobs(table["owners"], np.uint16)
    who = [np.frombuffer(i.as_buffer(), np.int64)[np.frombuffer(o.as_buffer(), np.uint16) >> 1] for i, o in zip(table["ids"], table["owners"], strict=True)]
    wide = np.zeros((len(owners), 8), np.uint8)
    wide[:, :6] = blobs(table["shingles"], np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel().astype(np.uint64), np.concatenate(who), (owners & 1) == 1, blobs(table["left"], np.int64), blobs(table["right"], np.int64)


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in pieces(batches, 0):
        for s in K.shingle_sets(batch.column(0), WIDTH):
            if len(s):
                yield set_id(s), s


def _long_prefixes(parts: int, shared):
    """Documents -> packed shingles of their long prefixes, each once a slice; left and right
    have classes with the number of their shingles that met another class in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (s, who, ids) in enumerate(_prefixes(_sets_of(batches), shared.value, 1, SLICE)):
            starts, run_of = _runs(s)
            met = (np.diff(np.append(starts, len(s))) > 1)[run_of]
            count = np.bincount(who[met], minlength=len(ids))
            yield from _packed(parts, turn, s[starts] | (met[starts] * SHARED), who[starts], ids, ids[count > 0], count[count > 0])

    return run


def _count_shared(buckets: int):
    """One part -> packed (id, count): how many shingles of a class other classes have too."""

    def run(table: pa.Table) -> pa.Table:
        s, who, known, members, counts = _unpacked(table)
        if len(s):
            by = np.argsort(s, kind="stable")
            s, who, known = s[by], who[by], known[by]
            starts, run_of = _runs(s)
            new = (np.diff(np.append(starts, len(s))) > 1)[run_of] & ~known
            members, counts = np.concatenate([members, who[new]]), np.concatenate([counts, np.ones(int(new.sum()), np.int64)])
        members, counts = K.tally(members, counts)
        rows = list(split_by(members % buckets, buckets, members, counts))
        return pa.table({"bucket": pa.array([k for k, _ in rows], pa.int64()), "ids": pa.array([_binary(r[0]) for _, r in rows], pa.binary()), "counts": pa.array([_binary(r[1]) for _, r in rows], pa.binary())})

    return run


def _sum_shared(table: pa.Table) -> pa.Table:
    members, counts = K.tally(blobs(table["ids"], np.int64), blobs(table["counts"], np.int64))
    return pa.table({"id": members, "shared": counts})


def _first_prefixes(parts: int, shared):
    """(id, shingles) -> packed shingles of their first prefixes with all classes that have them; of one that
    more than LIGHT classes of the slice have the least class only (marked), and in left and right the others with that one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ((i, np.frombuffer(s.as_buffer(), np.uint64)) for b in batches for i, s in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for turn, (s, who, ids) in enumerate(_prefixes(sets, shared.value, 0, PAIR_SLICE)):
            starts, run_of = _runs(s)
            heavy = (np.diff(np.append(starts, len(s))) > LIGHT)[run_of]
            pairs = _distinct_pairs(ids[who[heavy]], ids[who[starts]][run_of[heavy]])
            sent = ~heavy
            sent[starts] = True
            yield from _packed(parts, turn, (s | (heavy * SHARED))[sent], who[sent], ids, pairs[:, 0], pairs[:, 1])

    return run


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0)


LOCAL, LED, DIRECT = 0, 1, 2


def _meet(table: pa.Table) -> pa.Table:
    """One part -> (member, region, kind): LOCAL, a class and the least one of its slice that shares a heavy shingle;
    LED, such a least one and the least of all slices for that shingle, perhaps itself; DIRECT, any other class and that."""
    s, who, heavy, left, right = _unpacked(table)
    led = direct = np.zeros((0, 2), np.int64)
    if len(s):
        by = np.lexsort((who, s))
        s, who, heavy = s[by], who[by], heavy[by]
        starts, run_of = _runs(s)
        pairs = np.stack([who, who[starts][run_of]], 1)
        led = np.unique(pairs[heavy], axis=0)
        direct = _distinct_pairs(*pairs[~heavy].T)
    member, region = (np.concatenate(x) for x in ((left, led[:, 0], direct[:, 0]), (right, led[:, 1], direct[:, 1])))
    return pa.table({"member": member, "region": region, "kind": pa.array(np.repeat([LOCAL, LED, DIRECT], [len(left), len(led), len(direct)]).astype(np.int32))})


def _member_sets(shared):
    """Documents -> (id, shingles), for those whose key may be among the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in pieces(batches, 1):
            keep = passes(wanted, int64(batch.column(0)).view(np.uint64))
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            rows = [(s, set_id(s)) if len(s) else (s, None) for s in K.shingle_sets(batch.column(1), WIDTH)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([_binary(r[0]) for r in rows], pa.binary())], ["key", "id", "shingles"])

    return run


def _overlaps(ids: np.ndarray, starts: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Size of the intersection of ``of`` with each set; sets are runs of ids from starts on."""
    flag = np.zeros(n, np.int32)
    flag[of] = 1
    return np.add.reduceat(flag[ids], starts)


def _to_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, chunk, member, shingles) -> (pivot, member, near, distance)."""
    for (pivot, _), table in groups(batches, 2):
        members = table["member"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        at = int(np.flatnonzero(members == pivot)[0])
        rest = [k for k in range(len(sets)) if members[k] != pivot]
        if not rest:
            continue
        base = sets[at]
        sizes = np.array([len(sets[k]) for k in rest])
        found = K.find(base, np.concatenate([sets[k] for k in rest]))[1]
        both = np.add.reduceat(found.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
        union = sizes + len(base) - both
        yield pa.RecordBatch.from_pydict({"pivot": np.full(len(rest), pivot), "member": members[rest], "near": 4 * both >= 3 * union, "distance": 1 - both / union})


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, i, j, member, block, near, distance, shingles) -> links (a, b) with an unlinked member."""
    for (_, i, j), table in groups(batches, 3):
        members, block, near, distance = (table[c].to_numpy() for c in ("member", "block", "near", "distance"))
        if near.all() or len(members) < 2:
            continue
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        sizes = np.array([len(s) for s in sets])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        a, b = [], []
        group = np.where(near, -1, np.arange(len(sets)))  # those near the pivot are connected through it
        for k in np.flatnonzero(~near):
            window = (np.abs(distance - distance[k]) <= 0.25 + 1e-9) & (4 * np.minimum(sizes, sizes[k]) >= 3 * np.maximum(sizes, sizes[k]))
            window &= group != group[k]  # and what is connected already needs no link
            if i != j:
                window &= block != block[k]
            if not window.any():
                continue
            both = _overlaps(ids, starts, ids[starts[k] : starts[k] + sizes[k]], len(values))
            linked = np.flatnonzero(window & (4 * both >= 3 * (sizes + sizes[k] - both)))
            for x in linked:
                if group[x] != group[k]:
                    a.append(members[k])
                    b.append(members[x])
                    group[group == max(group[x], group[k])] = min(group[x], group[k])
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links(docs: DataFrame, profile: DataFrame, classes: DataFrame, text: str) -> DataFrame:
    """Links (a, b) between classes that leave the components as all links would."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = profile.agg(F.sum("n")).first()[0] or 0
    parts = max(2 * shuffles, total // (4 * SLICE) + 1)
    order = spark.sparkContext.broadcast(_frequent(profile))
    packed = docs.select(text).mapInArrow(_long_prefixes(parts, order), _PACKED_SQL)
    buckets = max(8, parts // 8)
    shared = packed.groupBy("part").applyInArrow(_count_shared(buckets), "bucket long, ids binary, counts binary")
    shared = shared.groupBy("bucket").applyInArrow(_sum_shared, "id long, shared long")
    able = materialize(shared.join(classes, "id").where(F.col("shared") >= shared_least(F.col("n"))).select("id", F.col("key").alias("its"), "n"))

    sets = docs.select("key", text).mapInArrow(_member_sets(key_filter(spark, able.select(F.col("its").alias("key")))), "key long, id long, shingles binary")
    sets = materialize(sets.join(able.hint("merge"), "id").where("key = its").groupBy("id").agg(F.min("shingles").alias("shingles")))
    few = int((able.agg(F.sum("n")).first()[0] or 0) // (4 * PAIR_SLICE)) + 1  # so many slices that each is full
    met = sets.coalesce(few).mapInArrow(_first_prefixes(6 + 4 * few, order), _PACKED_SQL).groupBy("part").applyInArrow(_meet, "member long, region long, kind int")
    met = materialize(met.distinct())
    of = lambda kind: met.where(F.col("kind") == kind).drop("kind")
    through = of(LOCAL).join(of(LED).select(F.col("member").alias("region"), F.col("region").alias("top")), "region").select("member", F.col("top").alias("region"))
    regions = materialize(of(DIRECT).union(of(LED)).union(through).select("member", F.col("region").alias("pivot")).where("member <> pivot").distinct())

    sizes = materialize(regions.groupBy("pivot").count())
    chunked = regions.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("member"), F.ceil(F.col("count") / CHUNK)).alias("chunk"), "member")
    chunked = materialize(chunked)
    placed = chunked.union(chunked.select("pivot", "chunk", F.col("pivot").alias("member")).distinct())
    # sets are joined by shuffle at every size: both sides grow with the corpus
    with_sets = placed.join(sets.withColumnRenamed("id", "member").hint("merge"), "member").select("pivot", "chunk", "member", "shingles")
    distances = with_sets.repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk")
    distances = materialize(distances.mapInArrow(_to_pivot, "pivot long, member long, near boolean, distance double"))

    nearest = distances.where("not near").groupBy("pivot").agg(F.min("distance").alias("low"))
    left = distances.join(nearest, "pivot").where("not near or distance >= low - 0.25 - 1e-9")
    left = materialize(left.drop("low"))
    blocks = materialize(left.groupBy("pivot").agg(F.count("*").alias("count")).where("count > 1"))
    blocked = left.join(blocks, "pivot").withColumn("of", F.ceil(F.col("count") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("member", F.lit(1)), "of"))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    blocked = blocked.select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "member", "block", "near", "distance")
    joined = blocked.join(sets.withColumnRenamed("id", "member").hint("merge"), "member").select("pivot", "i", "j", "member", "block", "near", "distance", "shingles")
    again = joined.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").mapInArrow(_within, "a long, b long")
    return materialize(distances.where("near").select(F.col("pivot").alias("a"), F.col("member").alias("b")).union(again))


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; and ``key``, the row's identity, and ``root``, the component's (null for empty texts)."""
    docs = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    profile = materialize(docs.select("key", "doc_id", "text").mapInArrow(_profile(parts), "key long, doc_id long, n long, id long, part int, shingles binary, counts binary"))
    rows = profile.where("part is null").select("key", "doc_id", "n", "id")
    classes = materialize(rows.where("id is not null").groupBy("id").agg(F.min("key").alias("key"), F.min("doc_id").alias("low"), F.min("n").alias("n")))
    found = components(links(docs, profile, classes, "text"))
    rooted = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "low", F.coalesce("component", "id").alias("root"))
    rooted = materialize(rooted)
    lowest = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
    final = materialize(rooted.join(lowest, "root").select("id", "component_id", "root"))
    out = rows.join(final, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", "root")


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document, that of the least doc_id, of each component; empty texts stay."""
    found = materialize(similar_documents(docs, text, doc_id).withColumn("group", F.coalesce("root", "key")))
    least = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.count("*").alias("n"), F.countDistinct("key").alias("keys"))
    kept = materialize(least.select(F.col("first.key").alias("_kept_key"), F.col("first.doc_id").alias("_kept_id"), (F.col("n") > F.col("keys")).alias("repeated")))
    keyed = docs.withColumn("_row_key", row_key(doc_id, text)).withColumn("_row_id", F.col(doc_id).cast("long"))
    same = (F.col("_row_key") == F.col("_kept_key")) & F.col("_row_id").eqNullSafe(F.col("_kept_id"))
    left = keyed.join(kept.select("_kept_key", "_kept_id"), same, "left_semi")
    if not kept.where("repeated").isEmpty():  # rows alike in doc_id and text
        left = left.dropDuplicates(["_row_key", "_row_id"])
    return left.drop("_row_key", "_row_id")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents")).drop("key", "root")


OP3_SQL = """
with recursive d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) as w
  from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as g
  from d
), e as (
  select doc_id, len(g)::bigint as n, unnest(g) as x from s
), p as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id < b.doc_id
  where 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), l as (
  select a, b from p union all select b, a from p
), r as (
  select doc_id as node, doc_id as seen from d union select l.b, r.seen from r join l on l.a = r.node
)
select s.doc_id, len(s.g)::bigint as n_shingles, min(r.seen) as component_id
from s join r on r.node = s.doc_id group by s.doc_id, s.g
"""

"""Operator 8: near-duplicate vectors by cross-polytope hashing.

Each of ``TABLES`` hash tables turns the unit vectors by fast Hadamard rotations
(random signs and a Walsh-Hadamard transform, three times) and takes the nearest
vertex of the cross-polytope, that is the largest coordinate and its sign
(Andoni et al., NIPS 2015); a key is two such vertices and the label.  A vector is
also put into the two buckets where one vertex is replaced by the runner-up
(multiprobe).  Pairs that meet in a bucket, one of them by its own key, are candidates if
their sketches (signs of 32 random projections) differ in at most ``APART`` bits;
candidates are verified by cosine in double precision, and linked from ``THRESHOLD`` on.

Vectors alike in label and components are one class (told by 128 bits), which is hashed once.
A pair that meets in several buckets is counted in the first one only, which both sides'
vertices tell, so nothing has to be collected by pair: a bucket returns a number of
links for each class, and a spanning forest of its links.  Large buckets are split
into pairs of blocks; no bucket is capped.

Plan: narrow rows (bucket, class, sketch, vertices) go to the buckets; vectors only to those
buckets in which their class has a candidate for the first time.

Recall: all tables miss a pair at cosine 0.98 with probability of about 5e-4 in 64 dimensions,
a closer pair more rarely; a sketch with about 1e-6.  Tests and README compare with brute force.

Edge cases: vectors that are null or empty, have null or non-finite components, or
are zero, and rows without a label, link with nothing and are their own component;
vectors of different lengths never link; rows repeated in full count as links of each
other; a null vec_id takes part but names no component; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import groups, int64
from .common import components, key_filter, materialize, passes, read
from .textkernel import mix

TABLES = 4
THRESHOLD = 0.98
APART = 10
BLOCK = 2048
CHUNK = 256
SEED = 20240229
SMALL = 64
SEEN = 1 << 18  # identities that a task remembers, to send a vector once
_PROBES = 3  # the bucket itself, and with either vertex replaced by its runner-up


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (their length a power of two), scaled to keep lengths."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, width) / np.sqrt(width)


def vertices(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The nearest and the second nearest vertex of a randomly turned cross-polytope."""
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    turned = np.zeros((len(x), width))
    turned[:, : x.shape[1]] = x
    for _ in range(3):
        turned = hadamard(turned * rng.choice([-1.0, 1.0], width))
    size = np.abs(turned)
    rows = np.arange(len(x))
    first = size.argmax(axis=1)
    size[rows, first] = -1
    both = np.stack([first, size.argmax(axis=1)], 1)
    return 2 * both + (turned[rows[:, None], both] < 0)


def corners(x: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """(rows, tables, 4): the nearest and the second nearest of two vertices for each table."""
    rng = np.random.default_rng(SEED)
    return np.stack([np.concatenate([vertices(x, rng), vertices(x, rng)], 1) for _ in range(tables)], 1)


def keys(at: np.ndarray) -> np.ndarray:
    """(rows, tables, probes) keys of corners; the first probe is the vector's own bucket."""
    at = at.astype(np.int64)
    return np.stack([at[:, :, i] << 32 | at[:, :, 2 + j] for i, j in ((0, 0), (1, 0), (0, 1))], 2)


def sketch(x: np.ndarray) -> np.ndarray:
    """32 signs of projections, as bits."""
    planes = np.random.default_rng(SEED + 1).normal(size=(x.shape[1], 32))
    return np.packbits(x @ planes > 0, axis=1).view(">u4").ravel().astype(np.int64)


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows at length one, and which of them can link."""
    with np.errstate(all="ignore"):
        most = np.abs(x).max(axis=1, initial=0)
        good = np.isfinite(most) & (most > 0)
        x = x / np.where(good, most, 1)[:, None]
        return x / np.sqrt(np.where(good, np.einsum("ij,ij->i", x, x), 1))[:, None], good


def _packed(vector: np.ndarray) -> bytes:
    """A vector in four bytes a component if that loses nothing, else in eight."""
    with np.errstate(all="ignore"):
        small = vector.astype("<f4")
    return b"f" + small.tobytes() if (small == vector).all() else b"d" + vector.tobytes()


def _unpacked(values: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer()[1:], "<f4" if v.as_buffer()[:1].to_pybytes() == b"f" else "<f8").astype(np.float64) for v in values]


_ROWS = pa.schema([("vec_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])
_ROWS_SQL = "vec_id long, hi long, lo long, label long, vector binary"


def _identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) -> rows with a 128-bit identity, and a vector for the first of each in the task."""
    seen: set[bytes] = set()
    for batch in batches:
        rows = []
        lists = batch.column(2)
        for k, (vec_id, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            item = lists[k]
            x = None
            if label is not None and item.is_valid and len(item.values) and not item.values.null_count:
                x = item.values.to_numpy()
                if not units(x[None])[1][0]:
                    x = None
            if x is None:
                rows.append((vec_id, None, None, None, None))
                continue
            packed = _packed(x)
            digest = xxhash.xxh3_128_digest(packed + str(label).encode())
            hi, lo = np.frombuffer(digest, np.int64).tolist()
            rows.append((vec_id, hi, lo, label, None if digest in seen else packed))
            if len(seen) < SEEN:
                seen.add(digest)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROWS)], schema=_ROWS)


def _by_width(vectors: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
    for width in sorted({len(v) for v in vectors}):
        at = [k for k, v in enumerate(vectors) if len(v) == width]
        yield at, units(np.stack([vectors[k] for k in at]))[0]


def _place(tables: int, own_only: bool):
    """(id, label, vector) -> the buckets of each class: (bucket, id, tab, own, sketch, corners), or its own buckets alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_width(_unpacked(batch.column("vector"))):
                part = batch.take(pa.array(at))
                corner = corners(x, tables)
                salt = mix(int64(part.column("label")).view(np.uint64) * np.uint64(1000003) + np.uint64(x.shape[1]))
                table = np.arange(tables, dtype=np.uint64)[None, :, None]
                bucket = mix(keys(corner).view(np.uint64) + mix(salt)[:, None, None] + mix(table + np.uint64(77))).view(np.int64)
                if own_only:
                    yield pa.RecordBatch.from_pydict({"bucket": bucket[:, :, 0].ravel()})
                    continue
                n, each = len(at), tables * _PROBES
                kind = np.uint8 if corner.max() < 256 else np.uint16 if corner.max() < 65536 else np.uint32
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": bucket.ravel(),
                        "id": np.repeat(int64(part.column("id")), each),
                        "tab": np.tile(np.repeat(np.arange(tables, dtype=np.int32), _PROBES), n),
                        "own": np.tile(np.arange(_PROBES) == 0, n * tables),
                        "sketch": np.repeat(sketch(x), each),
                        "corners": pa.array(np.repeat(np.array([c.astype(kind).tobytes() for c in corner], object), each), pa.binary()),
                    }
                )

    return run


_PLACED = "bucket long, id long, tab int, own boolean, sketch long, corners binary"


def _corners_of(column: pa.ChunkedArray, tables: int) -> np.ndarray:
    """Corners of one bucket's classes (of one width, yet perhaps of different sizes in bytes)."""
    sizes = {1: np.uint8, 2: np.uint16, 4: np.uint32}
    return np.stack([np.frombuffer(v.as_buffer(), sizes[v.as_buffer().size // (4 * tables)]).astype(np.int64) for v in column]).reshape(-1, tables, 4)


def _first_meeting(a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, table: int) -> np.ndarray:
    """For pairs with keys a, b (pairs, tables, probes): whether this bucket, where they are
    in by their own key or not, is the first in which they meet."""
    meets = (a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)
    first = ~meets[:, :table].any(1)
    a, b = a[:, table], b[:, table]
    same = a[:, 0] == b[:, 0]
    in_a = (a[:, :1] == b[:, 1:]).any(1)  # meet in a's own bucket
    in_b = (b[:, :1] == a[:, 1:]).any(1)
    here_a, here_b = own_a & ~own_b, own_b & ~own_a
    chosen = np.where(same, own_a & own_b, np.where(in_a & in_b, np.where(a[:, 0] < b[:, 0], here_a, here_b), here_a | here_b))
    return first & chosen


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a[:, None] ^ b[None]).view(np.uint64))


def _sieve(batches: Iterator[pa.RecordBatch], apart: int) -> Iterator[pa.RecordBatch]:
    """Sorted placed classes without the small buckets in which no two sketches are near (those at the ends of a batch stay)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for name in ("bucket", "i", "j"):
            column = int64(batch.column(name))
            change[1:] |= column[1:] != column[:-1]
        group = np.cumsum(change)
        own, bits, ids = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("own", "sketch", "id"))
        stays = np.zeros(group[-1] + 1, bool)
        stays[[0, -1]] = True
        at, step = np.arange(n - 1), 1
        while len(at := at[at + step < n]) and len(at := at[group[at + step] == group[at]]):
            if step == SMALL:
                stays[group[at]] = True
                break
            near = np.bitwise_count((bits[at] ^ bits[at + step]).view(np.uint64)) <= apart
            stays[group[at[near & (own[at] | own[at + step]) & (ids[at] != ids[at + step])]]] = True
            step += 1
        yield batch.filter(pa.array(stays[group]))


def _candidates(tables: int, apart: int):
    """Placed classes, sorted by (bucket, i, j) -> those that have a candidate which they meet here for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, i, j), table in groups(_sieve(batches, apart), 3, least=2):
            own = table["own"].to_numpy()
            if not own.any():
                continue
            ids, block, bits, tab = table["id"].to_numpy(), table["block"].to_numpy(), table["sketch"].to_numpy(), int(table["tab"][0].as_py())
            k = None
            some = np.zeros(len(ids), bool)
            for lo in range(0, len(ids), CHUNK):
                part = slice(lo, lo + CHUNK)
                near = (_apart(bits[part], bits) <= apart) & (own[part, None] | own[None]) & (ids[part, None] != ids[None])
                if i != j:
                    near &= block[part, None] != block[None]
                a, b = np.nonzero(near)
                if len(a) and k is None:
                    k = keys(_corners_of(table["corners"], tables))
                for at in range(0, len(a), 200_000):
                    p, q = a[at : at + 200_000] + lo, b[at : at + 200_000]
                    good = _first_meeting(k[p], k[q], own[p], own[q], tab)
                    some[p[good]] = True
            if some.any():
                kept = table.filter(pa.array(some)).select(["id", "tab", "own", "block", "corners"])
                n = kept.num_rows
                for name, value in (("j", j), ("i", i), ("bucket", bucket)):
                    kept = kept.add_column(0, name, pa.array(np.full(n, value)))
                yield from kept.combine_chunks().to_batches()

    return run


_MET = "bucket long, i long, j long, id long, tab int, own boolean, block long, corners binary"


def _wanted(shared):
    """Classes (id, n, vector) whose id may be among the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, int64(batch.column(0)).view(np.uint64))))

    return run


def _verify(tables: int, threshold: float):
    """(bucket, i, j, tab, id, own, block, corners, n, vector) -> links: (id, links, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), table in groups(batches, 3, least=2):
            own, block = table["own"].to_numpy(), table["block"].to_numpy()
            if not own.any():
                continue
            ids, n, tab = table["id"].to_numpy(), table["n"].to_numpy(), int(table["tab"][0].as_py())
            x = units(np.stack(_unpacked(table["vector"])))[0]
            k = keys(_corners_of(table["corners"], tables))
            links = np.zeros(len(x), np.int64)
            near = np.zeros((len(x), len(x)), bool)
            for lo in range(0, len(x), CHUNK):
                part = slice(lo, lo + CHUNK)
                near[part] = x[part] @ x.T >= threshold
                near[part] &= own[part, None] | own[None]
                if i != j:
                    near[part] &= block[part, None] != block[None]
                near[part] &= ids[part, None] != ids[None]
                a, b = np.nonzero(near[part])
                for at in range(0, len(a), 200_000):
                    p, q = a[at : at + 200_000] + lo, b[at : at + 200_000]
                    good = _first_meeting(k[p], k[q], own[p], own[q], tab)
                    links += np.bincount(p[good], weights=n[q[good]], minlength=len(x)).astype(np.int64)
            if not near.any():
                continue
            root = np.arange(len(x))
            while True:  # spread the least place along links
                low = root.copy()
                for lo in range(0, len(x), CHUNK):
                    part = slice(lo, lo + CHUNK)
                    low[part] = np.minimum(low[part], np.where(near[part], root[None], len(x)).min(axis=1))
                if (low == root).all():
                    break
                root = low
            some = near.any(axis=1)
            yield pa.RecordBatch.from_pydict({"id": ids[some], "links": links[some], "to": ids[root[some]]})

    return run


def near_vectors(vectors: DataFrame, tables: int = TABLES, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = materialize(rows.mapInArrow(_identify, _ROWS_SQL))
    classes = rows.where("hi is not null").groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.min("label").alias("label"), F.min("vector").alias("vector"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()))

    hashed = classes.select("id", "label", "vector")
    own = hashed.mapInArrow(_place(tables, True), "bucket long")
    large = materialize(own.groupBy("bucket").agg(F.ceil(_PROBES * F.count("*") / BLOCK).alias("of")).where("of > 1"))
    placed = hashed.mapInArrow(_place(tables, False), _PLACED).join(large, "bucket", "left")
    placed = placed.withColumn("of", F.coalesce("of", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), "of"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    placed = placed.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "tab", "own", "sketch", "corners", "block")
    met = materialize(placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_candidates(tables, APART), _MET))

    shared = key_filter(spark, met.select(F.col("id").alias("key")))
    wanted = classes.select("id", "n", "vector").mapInArrow(_wanted(shared), "id long, n long, vector binary")
    live = met.join(wanted, "id").select("bucket", "i", "j", "tab", "id", "own", "block", "corners", "n", "vector")
    found = live.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_verify(tables, threshold), "id long, links long, to long")
    found = materialize(found)

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    linked = classes.select("id", "hi", "lo", "n", "low").join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    linked = materialize(linked.select("hi", "lo", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "low", F.coalesce("component", "id").alias("root")))
    lowest = materialize(linked.groupBy("root").agg(F.min("low").alias("component_id")))
    final = materialize(linked.join(lowest, "root").select("hi", "lo", "n_links", "component_id"))
    out = rows.select("vec_id", "hi", "lo").join(final, ["hi", "lo"], "left")
    component = F.when(F.col("hi").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


#: All pairs of a label, by cosine in double precision.
OP8_SQL = """
with recursive e as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), p as (
  select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.98
), r as (
  select vec_id as node, vec_id as seen from embeddings union select p.b, r.seen from r join p on p.a = r.node
), c as (
  select node, min(seen) as component_id from r group by node
), n as (
  select a, count(*) as n_links from p group by a
)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings left join n on n.a = vec_id join c on c.node = vec_id
"""

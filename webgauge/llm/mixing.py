"""Operator 1: mixing sources to target weights (DataFrame functions only).

Hash-threshold histograms.  Every document has a 60-bit hash of its id and text.
Tokens are summed by source and by the leading ``bits`` of the hash; from these
sums come the targets and, for each source, the one bucket that its threshold
falls into.  Only that bucket is split further, by the next bits, until hashes
are exhausted, so no step sorts documents and none moves their texts.  A source
that owes more than one pass is taken whole that many times, and the threshold
settles the rest, so the selections for growing budgets are nested.

Plan: one scan of the documents writes a narrow table (source, hash, size); all
sums have map-side partials; windows run over histogram rows, at most ``2**bits``
a source; one row a source reaches the window that computes the targets.

Edge cases: null text has size 0; null source is a source of its own and sorts
last; sources of size 0 get the target 0; an empty table gives no row; repeated
rows (same id and same text) share a hash and are taken together; extra columns
stay untouched in ``mix_documents``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, read

HASH_BITS = 60
#: Up to so many sources the per-source decisions are broadcast (about 60 bytes each).
BROADCAST_SOURCES = 50_000


def document_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    joined = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): water filling in closed form.

    With the sources by size / weight, the level is the largest of
    (budget - what the earlier ones may take) / weight of the rest.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("rank")
    level = (share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least(most * F.col("source_size"), F.col("level") * F.col("weight")).alias("target"))
    )


def decisions(narrow: DataFrame, weights: tuple[float, ...], share: float, most: float, bits: int) -> DataFrame:
    """(source, source_size, target, passes, threshold): take each document ``passes``
    times, and once more if its hash is below ``threshold``."""
    histogram = materialize(_histogram(narrow, HASH_BITS - bits))
    targets = source_targets(histogram.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = materialize(
        targets.withColumn("passes", passes)
        .withColumn("owed", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("low", F.lit(0).cast("long"))  # hashes below are in
        .withColumn("filled", F.lit(0).cast("long"))  # and hold so many tokens
    )
    left, level = HASH_BITS - bits, histogram
    while True:
        state, open_buckets = _narrow_down(state, level, left)
        state = materialize(state)
        most_rows = open_buckets.agg(F.max("rows")).first()[0]
        if left == 0 or most_rows is None:
            return state.select("source", "source_size", "target", "passes", F.col("low").alias("threshold"))
        # a bucket that holds no more documents than a histogram has buckets is settled hash by hash
        left = 0 if most_rows <= 1 << bits else max(0, left - bits)
        inside = _join_sources(narrow, open_buckets.withColumnRenamed("source", "its"), "source", "its").where(
            (F.col("hash") >= F.col("from")) & (F.col("hash") < F.col("until"))
        )
        level = _histogram(inside, left)


def _histogram(rows: DataFrame, left: int) -> DataFrame:
    """Tokens and rows by source and hash, without the last ``left`` bits of the hash."""
    return rows.groupBy("source", F.shiftright("hash", left).alias("bucket")).agg(F.sum("size").alias("tokens"), F.count("*").alias("rows"))


def _narrow_down(state: DataFrame, level: DataFrame, left: int) -> tuple[DataFrame, DataFrame]:
    """One refinement: whole buckets below the threshold are settled, and the bucket
    that holds it is returned for the next one.

    At the last bits a bucket is one hash; it is in if the nearer end of its tokens
    to the budget is the upper one.
    """
    step = 1 << left
    ordered = Window.partitionBy("its").orderBy("bucket")
    until = level.withColumnRenamed("source", "its").withColumn("upto", F.sum("tokens").over(ordered))
    joined = _join_sources(until, state, "its", "source")
    total = F.col("filled") + F.col("upto")
    whole = total <= F.col("owed") if left else (2 * total - F.col("tokens")) <= 2 * F.col("owed")
    found = joined.groupBy("source").agg(
        F.max(F.when(whole, (F.col("bucket") + 1) * step)).alias("to"),
        F.max(F.when(whole, total)).alias("have"),
        F.min(F.when(~whole, F.struct("bucket", "rows"))).alias("split"),
    )
    found = materialize(found.withColumnRenamed("source", "its"))
    after = (
        _join_sources(state, found, "source", "its", "left")
        .withColumn("filled", F.coalesce("have", "filled"))
        .withColumn("low", F.coalesce("to", "low"))
        .drop("its", "to", "have", "split")
    )
    open_buckets = found.where("split is not null").select(
        F.col("its").alias("source"),
        (F.col("split.bucket") * step).alias("from"),
        ((F.col("split.bucket") + 1) * step).alias("until"),
        F.col("split.rows").alias("rows"),
    )
    return after, open_buckets


def _join_sources(rows: DataFrame, per_source: DataFrame, left: str, right: str, how: str = "inner") -> DataFrame:
    """Null-safe join to one row a source; broadcast only after counting that side."""
    small = per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(per_source) if small else per_source, F.col(left).eqNullSafe(F.col(right)), how)


def _narrow(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        document_size(F.col(text)).alias("size"),
        document_hash(F.col(doc_id), F.col(text)).alias("hash"),
    )


def _copies(passes: Column, hashed: Column, threshold: Column) -> Column:
    return passes + F.when(hashed < threshold, 1).otherwise(0)


def mix_report(docs: DataFrame, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0, bits=10, text="text", doc_id="doc_id", source="source") -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken."""
    narrow = materialize(_narrow(docs, text, doc_id, source))
    chosen = decisions(narrow, tuple(weights), share, most, bits).withColumnRenamed("source", "its")
    copies = _copies(F.col("passes"), F.col("hash"), F.col("threshold"))
    return _join_sources(narrow, chosen, "source", "its").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mix_documents(docs: DataFrame, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0, bits=10, text="text", doc_id="doc_id", source="source") -> DataFrame:
    """The mix itself: the rows of docs that are taken, with their columns and ``copies``,
    how often each is to be read.  Texts are filtered where they are scanned and never shuffled
    while the sources are few enough to broadcast."""
    narrow = materialize(_narrow(docs, text, doc_id, source))
    chosen = decisions(narrow, tuple(weights), share, most, bits).select(
        F.col("source").alias("_mix_source"), F.col("passes").alias("_mix_passes"), F.col("threshold").alias("_mix_threshold")
    )
    hashed = docs.withColumn("_mix_hash", document_hash(F.col(doc_id), F.col(text)))
    copies = _copies(F.col("_mix_passes"), F.col("_mix_hash"), F.col("_mix_threshold"))
    return (
        _join_sources(hashed, chosen, source, "_mix_source")
        .withColumn("copies", copies)
        .where("copies > 0")
        .drop("_mix_hash", "_mix_source", "_mix_passes", "_mix_threshold")
    )


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || coalesce(text, '')), 1, 15))::bigint as hash
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), r as (
  select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
         row_number() over (order by source nulls last) as rank from s
), l as (
  select *, (1.5::double * sum(source_size) over ()
             - 2.0::double * coalesce(sum(source_size) over (order by source_size / weight, rank rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by source_size / weight, rank rows between current row and unbounded following) as lev
  from r
), t as (
  select source, source_size, least(2.0::double * source_size, max(lev) over () * weight) as target from l
), p as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as passes from t
), g as (
  select source, hash, sum(size) as tokens from d group by source, hash
), c as (
  select source, hash, tokens, sum(tokens) over (partition by source order by hash) as upto from g
)
select d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.passes + case when 2 * c.upto - c.tokens <= 2 * (p.target - p.passes * p.source_size) then 1 else 0 end))::bigint as taken
from d join p on d.source is not distinct from p.source
       join c on d.source is not distinct from c.source and d.hash = c.hash
"""

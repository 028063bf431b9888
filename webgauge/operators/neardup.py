"""Near-duplicate fingerprints: an exact Hamming join and its clusters."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import distance
from ..plans.scratch import table
from .components import components

NEAR = 4  # distances below are near
BLOCKS = 6
ROWS = 1_000_000  # keyed rows that one task deals out, and about as many of each side that it joins


def _keys(simhash: Column, within: int, blocks: int) -> Column:
    """Keys of which two words at distance <= within share one: blocks - within equal blocks of bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = lambda lo, hi: F.call_function("shiftrightunsigned", simhash, F.lit(lo)).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    parts = [part(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(n), *[parts[k] for k in chosen]) for n, chosen in enumerate(combinations(range(blocks), blocks - within))])


def near_pairs(fingerprints: DataFrame, near: int = NEAR, blocks: int = BLOCKS, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., a, b, distance) of distinct fingerprints (column simhash) at a distance below near, a < b.

    Words at distance d < near agree in blocks - d of their blocks, so an equi-join on all
    choices of so many blocks finds every pair; a key has 32 bits or so, so buckets stay small.
    """
    return _pairs(_words(fingerprints, by), near, blocks, by)


def _words(fingerprints: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return table(fingerprints.where("simhash is not null").select(*by, "simhash").distinct())


def _pairs(words: DataFrame, near: int, blocks: int, by: tuple[str, ...]) -> DataFrame:
    """near_pairs of a table of distinct fingerprints.

    Its size tells nothing of the rows after the explode, so their partitions are counted here
    (a number that adaptive execution keeps) and the join is told not to broadcast them: a task would
    hold them all.  Where the session's partitions are fewer than the counted ones, so are those of the
    join, and a task sorts about 2 * ROWS keyed rows however many there are.
    """
    slices = 1 + words.count() * comb(blocks, near - 1) // ROWS
    keyed = words.repartition(slices, "simhash").select(*by, "simhash", F.explode(_keys(F.col("simhash"), near - 1, blocks)).alias("key"))
    if slices > int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        keyed = keyed.repartition(slices, *by, "key")
    left, right = keyed.withColumnRenamed("simhash", "a"), keyed.withColumnRenamed("simhash", "b")
    pairs = left.hint("merge").join(right, [*by, "key"]).where("a < b").withColumn("distance", distance(F.col("a"), F.col("b")))
    return pairs.where(F.col("distance") < near).select(*by, "a", "b", "distance").distinct()


def clusters(fingerprints: DataFrame, near: int = NEAR, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., simhash, cluster) for each distinct fingerprint: the least one that a chain of near ones reaches."""
    words = _words(fingerprints, by)
    if not by:
        found = components(_pairs(words, near, BLOCKS, by).select("a", "b"))
        return words.join(found, words.simhash == found.node, "left").select("simhash", F.coalesce("component", "simhash").alias("cluster"))
    node = lambda c: F.xxhash64(*by, c)
    found = components(_pairs(words, near, BLOCKS, by).select(node("a").alias("a"), node("b").alias("b")))
    joined = words.withColumn("node", node("simhash")).join(found, "node", "left")
    return joined.select(*by, "simhash", F.coalesce("component", "node").alias("cluster"))


def count_clusters(fingerprints: DataFrame, near: int = NEAR) -> DataFrame:
    """One row: near_unique, the number of clusters."""
    return clusters(fingerprints, near).agg(F.countDistinct("cluster").alias("near_unique"))

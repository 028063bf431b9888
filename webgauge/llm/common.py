"""Shared helpers: tables, row keys and key filters; scratch tables and connected components are the library's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.operators.components import components
from webgauge.plans.scratch import spread
from webgauge.plans.scratch import table as materialize

__all__ = ["WORD", "components", "key_filter", "materialize", "passes", "read", "remainder", "row_key"]

#: A word, as a Java and as a Python regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"
FILTER_BITS = 1 << 25


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def row_key(*columns: str) -> Column:
    """64-bit identity of a row; rows alike in all the columns share it (and are treated as one)."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in columns])


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a value's text modulo a number; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def key_filter(spark: SparkSession, keys: DataFrame):
    """A broadcast bitmap of FILTER_BITS bits over hashes in the column ``key``: of fixed size; too many keys only let more rows pass."""
    place = F.pmod(F.col("key"), F.lit(FILTER_BITS))  # agrees with unsigned % for a power of two
    rows = keys.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(key, 64) as int))")).alias("b")).collect()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[[r[0] for r in rows]] = np.array([r[1] for r in rows], np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(words)


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a bitmap of ``key_filter`` has each of the (unsigned) keys."""
    place = keys & np.uint64(FILTER_BITS - 1)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

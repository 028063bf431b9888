"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import getpass
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a local one, but on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"file:///tmp/checkpoints/{getpass.getuser()}").rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """df written and read back: its lineage is cut, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/webgauge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files give fewer partitions than there are cores (small tables; a large one stays as it is)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

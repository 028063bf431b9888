"""A corpus pipeline over ``documents``: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet to the shared scratch folder and reads it again for the next one.
All but the last return the columns of documents; the last adds ``copies``, how often a
document is to be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard, linededup, mixing, nbsvm
from .common import materialize, read, remainder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = nbsvm.train(docs, read(spark, sf_dir, "labels"), held_out)
    return nbsvm.score_documents(docs, model).where("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of long line runs go from the texts; a document left without words by that goes too."""
    cut = linededup.dedup_lines(docs)
    gone = (F.col("n_removed_lines") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return cut.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items go."""
    return decontamination.drop_leaks(docs, read(spark, sf_dir, "benchmark"), whole_texts=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
]

#: The first stage is a trained model, which SQL can't express; tests compare the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs

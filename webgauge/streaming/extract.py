"""The measuring phase over a stream of archive files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import extract
from ..sources import warc


def resources_stream(spark: SparkSession, folder: str) -> DataFrame:
    """url_info rows of archive files as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return extract.resources(files.select("path", "content").mapInArrow(warc._parse, warc.SCHEMA))

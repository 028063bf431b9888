"""Web archive files as a DataFrame of records.

``read_warc`` reads through Spark (any file system, one task a file, the file in the
task's memory); the ``warc`` data source streams files that are mounted on every node.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "record_type string, record_id string, warc_date string, content_type string, content_length long, headers map<string,string>, content binary, file string, record_no long"
KNOWN = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type", "Content-Length")


def records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """Records of an archive stream: a version line, header lines to a blank one, and as much content as they say.

    A record without a length, or with a negative one, ends the stream.
    """
    while True:
        line = stream.readline()
        while line and not line.startswith(b"WARC/"):
            line = stream.readline()
        if not line:
            return
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip(b"\r\n"):
            name, found, value = line.decode("utf-8", "replace").partition(":")
            if found:
                headers[name.strip()] = value.strip()
        try:
            length = int(headers["Content-Length"])
        except (KeyError, ValueError):
            return
        if length < 0:
            return
        content = stream.read(length)
        if len(content) < length:
            return
        others = {k: v for k, v in headers.items() if k not in KNOWN}
        yield headers.get("WARC-Type"), headers.get("WARC-Record-ID"), headers.get("WARC-Date"), headers.get("Content-Type"), length, others, content


def opened(raw: io.BufferedIOBase) -> io.BufferedIOBase:
    """The stream, unzipped (all members) if it is gzip."""
    buffered = io.BufferedReader(raw) if not hasattr(raw, "peek") else raw
    return gzip.GzipFile(fileobj=buffered) if buffered.peek(2)[:2] == b"\x1f\x8b" else buffered


class WarcSource(DataSource):
    """spark.read.format("warc").load(path or glob)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options.get("path", ""))


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        paths = [os.path.join(self.path, n) for n in os.listdir(self.path)] if os.path.isdir(self.path) else glob.glob(self.path)
        return [InputPartition(p) for p in sorted(paths)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        with open(partition.value, "rb") as raw:
            for n, record in enumerate(records(opened(raw))):
                yield (*record, partition.value, n)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "warc_date", "content_type")]
    + [("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("content", pa.binary()), ("file", pa.string()), ("record_no", pa.int64())]
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held: list[tuple] = []
            size = 0
            for n, record in enumerate(records(opened(io.BytesIO(content.as_py())))):
                held.append((*record, path, n))
                size += record[4]
                if size > 16 << 20:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    columns[5] = [list(h.items()) for h in columns[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse, SCHEMA)


# ---- accessors ------------------------------------------------------------------------------


def header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


def target_uri() -> Column:
    return header("WARC-Target-URI")


def refers_to() -> Column:
    return header("WARC-Refers-To")


def ip_address() -> Column:
    return header("WARC-IP-Address")


def timestamp() -> Column:
    """The record's date as a timestamp; null if it is malformed."""
    return F.try_to_timestamp("warc_date", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def content_text() -> Column:
    return F.decode("content", "UTF-8")


def header_lines() -> Column:
    """The record's header fields as text lines, the known ones first."""
    known = [F.concat(F.lit(f"{n}: "), F.col(c).cast("string")) for n, c in zip(KNOWN, ("record_type", "record_id", "warc_date", "content_type", "content_length"), strict=True)]
    others = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.concat(F.array_compact(F.array(*known)), others), "\r\n")


def is_resource(kinds: tuple[str, ...] = ("response", "link")) -> Column:
    """Record types that count as fetched resources."""
    return F.col("record_type").isin(*kinds)


def http_parts() -> tuple[Column, Column]:
    """(header text, body) of an HTTP response; null where there is no blank line."""
    text = F.decode("content", "ISO-8859-1")
    at = F.instr(text, "\r\n\r\n")
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)), F.when(at > 0, F.expr("substring(content, instr(decode(content, 'ISO-8859-1'), '\r\n\r\n') + 4)"))

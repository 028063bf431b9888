"""From archive records to resource and link rows (the measuring phase)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import hashing, html, sniff, urls
from ..sources import hashlog, warc

_MEASURES = StructType([StructField("simhash", LongType()), StructField("simhash_main_text", LongType()), StructField("section", StringType())])


@F.pandas_udf(_MEASURES)
def measure(content: pd.Series, url: pd.Series) -> pd.DataFrame:
    """Page and main-text fingerprints and the section head of an HTML payload."""
    memo: dict = {}
    rows = []
    for c, u in zip(content, url, strict=True):
        if c is None:
            rows.append((None, None, None))
            continue
        source = sniff.decode(c)
        title, body = html.extract(source)
        page = hashing.fingerprint(hashing.tokenize(title) + hashing.tokenize(body), memo=memo)
        rows.append((page, hashing.fingerprint(hashing.tokenize(html.main_text_of(source, u)), memo=memo), html.section_head_of(source, u)))
    out = pd.DataFrame(rows, columns=["simhash", "simhash_main_text", "section"])
    return out.astype({"simhash": "Int64", "simhash_main_text": "Int64"})


def resources(records: DataFrame) -> DataFrame:
    """url_info rows of the http(s) responses among archive records; works on streams too."""
    head, body = warc.http_parts()
    rows = records.where(warc.is_resource() & urls.is_http(warc.target_uri()))
    rows = rows.select(warc.target_uri().alias("url"), F.col("warc_date").alias("capture_date"), head.alias("head"), body.alias("body")).where(F.col("head").isNotNull())
    status = urls.status_code(F.substring_index("head", "\r\n", 1))
    location = F.when(status.cast("string").startswith("3"), urls.absolute_url(F.col("url"), urls.location_header(F.col("head"))))
    rows = rows.select("url", "capture_date", status.alias("status"), sniff.mime_type(F.col("body")).alias("mime_type"), hashing.md5_stripped(F.col("body")).alias("md5"), location.alias("redir_location"), "body")
    payload = F.when(sniff.is_html(F.col("mime_type")), F.col("body"))
    measured = rows.withColumn("m", measure(payload, F.col("url")))
    return measured.select("url", "capture_date", "status", "mime_type", "md5", "redir_location", "m.simhash", "m.simhash_main_text", "m.section")


def links(records: DataFrame) -> DataFrame:
    """Links of the metadata records."""
    return hashlog.outlinks(records.where("record_type = 'metadata'").select(warc.target_uri().alias("url"), warc.content_text().alias("text")))


def run_counters(records: DataFrame) -> DataFrame:
    """Records and bytes of all records, and of HTML responses."""
    is_page = warc.is_resource() & sniff.is_html(sniff.mime_type(warc.http_parts()[1]))
    html_bytes = F.when(is_page, F.col("content_length"))
    return records.agg(
        F.count("*").alias("n_records"),
        F.coalesce(F.sum("content_length"), F.lit(0)).alias("n_bytes"),
        F.count(html_bytes).alias("n_html"),
        F.coalesce(F.sum(html_bytes), F.lit(0)).alias("n_html_bytes"),
    )

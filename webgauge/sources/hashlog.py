"""The text form of a measured crawl: one tab-separated line a resource, one space-separated line a link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sniff, urls

KEYS = {"mime_type": "tika_mime_t", "md5": "md5", "status": "status", "redir_location": "location", "simhash": "simhash_v1_3", "simhash_main_text": "simhash_v1_3_snacktory", "section": "section"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in order: (line_no, value); numbers grow with the file's name and the place in it."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def skip_errors(status: Column) -> Column:
    """Keeps rows whose status is below 400 or unknown."""
    return F.coalesce(status < 400, F.lit(True))


def html_only(url: Column, mime: Column) -> Column:
    """HTML by media type, unless the path ends in .js or .css."""
    path = F.lower(urls.path(url))
    return sniff.is_html(mime) & ~path.endswith(".js") & ~path.endswith(".css")


def has_fingerprint(simhash: Column, main_text: Column) -> Column:
    return simhash.isNotNull() | F.coalesce(main_text != 0, F.lit(False))


def last_wins(rows: DataFrame, order: str = "line_no") -> DataFrame:
    """One row for each url: the last one."""
    others = [c for c in rows.columns if c not in ("url", order)]
    last = rows.groupBy("url").agg(F.max_by(F.struct(*others), order).alias("row"))
    return last.select("url", *[F.col(f"row.{c}").alias(c) for c in others])


def parse_resources(lines: DataFrame, skip_error_status: bool = False, only_html: bool = False) -> DataFrame:
    """url_info rows of resource lines; of lines with the same url the last one holds."""
    words = lines.select("line_no", F.split(F.regexp_replace("value", "\t+$", ""), "\t").alias("w"))
    words = words.where((F.size("w") >= 2) & (F.col("w")[1] != "->"))
    pairs = F.transform(F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(0))), lambda c: F.struct(F.substring_index(c, ":", 1), F.substr(c, F.instr(c, ":") + 1)))
    rows = words.select("line_no", F.col("w")[0].alias("url"), F.col("w")[1].alias("capture_date"), F.map_from_entries(pairs).alias("kv"))
    value = lambda name: F.nullif(F.try_element_at("kv", F.lit(KEYS[name])), F.lit("null"))
    typed = {"status": "int", "simhash": "long", "simhash_main_text": "long"}
    rows = rows.select("line_no", "url", "capture_date", *[(value(n).try_cast(typed[n]) if n in typed else value(n)).alias(n) for n in KEYS])
    if skip_error_status:
        rows = rows.where(skip_errors(F.col("status")))
    if only_html:
        rows = rows.where(html_only(F.col("url"), F.col("mime_type")))
    return last_wins(rows).select("url", "capture_date", "status", "mime_type", "md5", "redir_location", "simhash", "simhash_main_text", "section")


def parse_links(lines: DataFrame) -> DataFrame:
    """(src, dst, link_type) of link lines."""
    w = F.split(F.regexp_replace("value", " +$", ""), " ")
    words = lines.select(w.alias("w")).where((F.size("w") > 2) & (F.col("w")[1] == "->"))
    return words.select(F.col("w")[0].alias("src"), F.col("w")[2].alias("dst"), F.coalesce(F.try_element_at("w", F.lit(4)), F.lit("-")).alias("link_type"))


def outlinks(metadata: DataFrame) -> DataFrame:
    """(src, dst, link_type) of metadata records (url, content text): lines ``outlink: dst type ...``."""
    line = metadata.where(urls.is_http(F.col("url"))).select("url", F.explode(F.split("text", "\r?\n")).alias("line"))
    line = line.where(F.trim(F.substring_index("line", ":", 1)) == "outlink").select("url", F.split(F.trim(F.substr("line", F.instr("line", ":") + F.lit(1))), " ").alias("w"))
    return line.select(F.col("url").alias("src"), F.col("w")[0].alias("dst"), F.coalesce(F.try_element_at("w", F.lit(2)), F.lit("-")).alias("link_type"))


def resource_lines(url_info: DataFrame) -> DataFrame:
    """Text lines (value) of url_info rows; the last three keys for rows with a fingerprint only."""
    text = lambda n: F.concat(F.lit(f"{KEYS[n]}:"), F.coalesce(F.col(n).cast("string"), F.lit("null")))
    head = [F.col("url"), F.coalesce("capture_date", F.lit("null")), *[text(n) for n in ("mime_type", "md5", "status", "redir_location")]]
    tail = [text(n) for n in ("simhash", "simhash_main_text", "section")]
    return url_info.select(F.when(F.col("simhash").isNull(), F.concat_ws("\t", *head)).otherwise(F.concat_ws("\t", *head, *tail)).alias("value"))


def link_lines(links: DataFrame) -> DataFrame:
    return links.select(F.concat_ws(" ", "src", F.lit("->"), "dst", "link_type").alias("value"))


def write(url_info: DataFrame, links: DataFrame, path: str) -> None:
    resource_lines(url_info).union(link_lines(links)).write.text(path)

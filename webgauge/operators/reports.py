"""Redundancy, diversity and comparison of captures (relations url_info with unique urls)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import distance
from ..functions.sniff import is_html
from ..sources.hashlog import has_fingerprint
from .neardup import clusters

CHANGED = 8  # distances above are changes


def duplicate_histogram(url_info: DataFrame) -> DataFrame:
    """(category, copies, n): how many contents (md5) have so many copies, for all, html, not_html and images."""
    image = F.coalesce(F.col("mime_type").startswith("image/"), F.lit(False))
    kinds = F.array(F.lit("all"), F.when(is_html(F.col("mime_type")), "html").otherwise("not_html"), F.when(image, "images"))
    counts = url_info.select("md5", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("category")).groupBy("category", "md5").agg(F.count("*").alias("copies"))
    return counts.groupBy("category", "copies").agg(F.count("*").alias("n"))


def totals(histogram: DataFrame) -> DataFrame:
    """(category, n_rows, n_unique) of a duplicate histogram."""
    return histogram.groupBy("category").agg(F.sum(F.col("copies") * F.col("n")).alias("n_rows"), F.sum("n").alias("n_unique"))


def ratio(a: Column, b: Column) -> Column:
    """A 32-bit quotient; null for a zero denominator."""
    return F.when(b != 0, (a.cast("double") / b).cast("float"))


def _page(mode: str) -> Column:
    main = F.when(F.col("simhash_main_text") != 0, F.col("simhash_main_text"))
    return {"page": F.col("simhash"), "main_text": main, "prefer_main_text": F.coalesce(main, F.col("simhash"))}[mode]


def diversity(url_info: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, near-unique html pages and distinct other contents, with their shares; one row, or one a group."""
    html = is_html(F.col("mime_type"))
    counts = url_info.groupBy(*by).agg(
        F.count_distinct(F.when(~html, F.col("md5"))).alias("uniq_not_html"),
        F.count_if(html).alias("n_html"),
        F.count_if(~html).alias("n_not_html"),
        F.count("*").alias("n_all"),
    )
    near = clusters(url_info.where("simhash is not null"), by=by).groupBy(*by).agg(F.count_distinct("cluster").alias("uniq_html"))
    joined = counts.join(near, list(by), "left") if by else counts.crossJoin(near)
    uniq = F.coalesce("uniq_html", F.lit(0))
    return joined.select(
        *by,
        uniq.alias("uniq_html"),
        "uniq_not_html",
        "n_html",
        "n_not_html",
        "n_all",
        ratio(uniq + F.col("uniq_not_html"), F.col("n_all")).alias("diversity"),
        ratio(uniq, F.col("n_html")).alias("diversity_html"),
        ratio(F.col("uniq_not_html"), F.col("n_not_html")).alias("diversity_not_html"),
    )


def unique_counts(url_info: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, distinct html contents, distinct other contents and near-unique html pages; one row, or one a group."""
    html = is_html(F.col("mime_type"))
    counts = url_info.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_distinct(F.when(html, F.col("md5"))).alias("uniq_html_md5"), F.count_distinct(F.when(~html, F.col("md5"))).alias("uniq_not_html")
    )
    near = clusters(url_info.where("simhash is not null"), by=by).groupBy(*by).agg(F.count_distinct("cluster").alias("near_uniq_html"))
    joined = counts.join(near, list(by), "left") if by else counts.crossJoin(near)
    return joined.select(*by, "n_rows", "uniq_html_md5", "uniq_not_html", F.coalesce("near_uniq_html", F.lit(0)).alias("near_uniq_html"))


def size(a: DataFrame, b: DataFrame) -> DataFrame:
    """(capture, n_rows, uniq_html_md5, uniq_not_html, near_uniq_html, share) of two captures and of all rows of both."""
    rows = a.withColumn("of", F.lit("A")).unionByName(b.withColumn("of", F.lit("B")))
    rows = rows.select("mime_type", "md5", "simhash", F.explode(F.array("of", F.lit("AB"))).alias("capture"))
    names = a.sparkSession.createDataFrame([("A",), ("B",), ("AB",)], "capture string")
    out = names.join(unique_counts(rows, ("capture",)), "capture", "left").fillna(0)
    found = F.col("near_uniq_html") + F.col("uniq_not_html")
    of_both = F.max(F.when(F.col("capture") == "AB", found)).over(Window.partitionBy())  # three rows
    return out.withColumn("of_both", of_both).select("capture", "n_rows", "uniq_html_md5", "uniq_not_html", "near_uniq_html", ratio(found, F.col("of_both")).alias("share"))


def distances(a: DataFrame, b: DataFrame, mode: str = "page", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., url, distance) of the urls in both captures."""
    pick = lambda rows, name: rows.where(has_fingerprint(F.col("simhash"), F.col("simhash_main_text"))).select(*by, "url", _page(mode).alias(name))
    joined = pick(a, "ours").join(pick(b, "theirs"), [*by, "url"]).select(*by, "url", distance(F.col("ours"), F.col("theirs")).alias("distance"))
    return joined.where("distance is not null")


def changed_share(found: DataFrame, by: tuple[str, ...], above: int = CHANGED) -> DataFrame:
    """(by.., n_urls, changed): the share of distances above the threshold, in each group."""
    counts = found.groupBy(*by).agg(F.count("*").alias("n_urls"), F.count_if(F.col("distance") > above).alias("n_changed"))
    return counts.select(*by, "n_urls", ratio(F.col("n_changed"), F.col("n_urls")).alias("changed"))

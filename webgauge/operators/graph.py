"""The link graph of a capture: (vertices, edges), in-degrees, section heads and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.sniff import is_html
from ..plans.scratch import table

INFERRED = "I"


def web_graph(links: DataFrame, url_info: DataFrame, domain: str | None = None, only_known: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices (url, status, mime_type, redir_location) and edges (src, dst, link_type); parallel edges stay."""
    edges = links.select("src", "dst", "link_type")
    if domain is not None:
        edges = edges.where(urls.in_domain(F.col("src"), domain) & urls.in_domain(F.col("dst"), domain))
    known = url_info.select("url")
    if only_known:
        edges = edges.join(known.withColumnRenamed("url", "src"), "src", "left_semi").join(known.withColumnRenamed("url", "dst"), "dst", "left_semi")
    edges = table(edges.select("src", "dst", "link_type"))
    names = edges.select(F.col("src").alias("url")).union(edges.select("dst")).distinct()
    return table(names.join(url_info.select("url", "status", "mime_type", "redir_location"), "url", "left")), edges


def indegrees(vertices: DataFrame, edges: DataFrame, mime: str | None = None) -> DataFrame:
    """(url, indegree) of vertices with a status below 400: in-edges that are not inferred; zero counts too."""
    kept = vertices.where("status < 400")
    if mime is not None:
        kept = kept.where(F.col("mime_type").startswith(mime))
    counts = edges.where(F.col("link_type") != INFERRED).groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("n"))
    return kept.select("url", "mime_type").join(counts, "url", "left").select("url", "mime_type", F.coalesce("n", F.lit(0)).alias("indegree"))


def indegree_histogram(degrees: DataFrame) -> DataFrame:
    """(category, indegree, n) for all, html and not_html."""
    kinds = F.array(F.lit("all"), F.when(is_html(F.col("mime_type")), "html").otherwise("not_html"))
    return degrees.select(F.explode(kinds).alias("category"), "indegree").groupBy("category", "indegree").agg(F.count("*").alias("n"))


def in_order(histogram: DataFrame) -> DataFrame:
    """A histogram by category and in-degree, smallest first (for output; it has few rows)."""
    return histogram.orderBy("category", "indegree")


def head_threshold(degrees: DataFrame) -> DataFrame:
    """One row: the upper median of the distinct in-degrees of html pages."""
    seen = degrees.where(is_html(F.col("mime_type"))).agg(F.sort_array(F.collect_set("indegree")).alias("d"))  # distinct numbers only
    return seen.where(F.size("d") > 0).select(F.col("d")[F.floor(F.size("d") / 2).cast("int")].alias("threshold"))


def select_root(vertices: DataFrame, domain: str) -> DataFrame:
    """One row: the root page found, http before https and the name as given before the other."""
    other = domain.removeprefix("www.") if domain.startswith("www.") else f"www.{domain}"
    ranked = [(f"{scheme}://{name}/", 2 * s + k) for s, scheme in enumerate(("http", "https")) for k, name in enumerate((domain, other))]
    names = vertices.sparkSession.createDataFrame(ranked, "url string, rank int")
    return vertices.select("url").join(F.broadcast(names), "url").orderBy("rank").limit(1).select("url")


def section_heads(vertices: DataFrame, edges: DataFrame, domain: str) -> DataFrame:
    """(url, indegree): html targets of the root's links whose in-degree reaches the threshold."""
    degrees = indegrees(vertices, edges)
    root = select_root(vertices, domain).withColumnRenamed("url", "src")
    targets = edges.where(F.col("link_type") != INFERRED).join(F.broadcast(root), "src").select(F.col("dst").alias("url")).distinct()
    html = degrees.where(is_html(F.col("mime_type"))).join(targets, "url")
    return html.crossJoin(F.broadcast(head_threshold(degrees))).where("indegree >= threshold").select("url", "indegree")


def top_heads(heads: DataFrame) -> DataFrame:
    """Heads without a head among the proper prefixes of their path."""
    prefixes = heads.select("url", F.explode(urls.proper_prefixes(F.col("url"))).alias("prefix"))
    below = prefixes.join(heads.select(F.col("url").alias("prefix")), "prefix", "left_semi").select("url").distinct()
    return heads.join(below, "url", "left_anti")


def _steps(vertices: DataFrame, edges: DataFrame, heads: DataFrame) -> DataFrame:
    """Edges that a section may follow: to an html page that is no head, and not to itself."""
    html = vertices.where(is_html(F.col("mime_type"))).select(F.col("url").alias("dst"))
    return edges.where("src <> dst").select("src", "dst").distinct().join(html, "dst", "left_semi").join(heads.select(F.col("url").alias("dst")), "dst", "left_anti").select("src", "dst")


def sections_by_links(vertices: DataFrame, edges: DataFrame, heads: DataFrame, keep_url_suffixes: bool = True) -> DataFrame:
    """(section_head, url): what each head reaches; with keep_url_suffixes each step must extend the url before it."""
    steps = _steps(vertices, edges, heads)
    steps = table(steps.where("startswith(dst, src)") if keep_url_suffixes else steps)
    members = frontier = table(heads.select(F.col("url").alias("section_head"), "url"))
    while not frontier.isEmpty():  # a round writes what it adds; members is the union of these tables
        reached = frontier.join(steps, frontier.url == steps.src).select("section_head", F.col("dst").alias("url")).distinct()
        frontier = table(reached.join(members, ["section_head", "url"], "left_anti"))
        members = members.union(frontier)
    return members


def sections_by_distance(vertices: DataFrame, edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(section_head, url): each page belongs to the closest head (ties: the smaller head)."""
    steps = table(_steps(vertices, edges, heads))
    members = frontier = table(heads.select(F.col("url").alias("section_head"), "url"))
    while not frontier.isEmpty():
        reached = frontier.join(steps, frontier.url == steps.src).groupBy(F.col("dst").alias("url")).agg(F.min("section_head").alias("section_head"))
        frontier = table(reached.join(members.select("url"), "url", "left_anti").select("section_head", "url"))
        members = members.union(frontier)
    return members


def sections_by_breadcrumb(url_info: DataFrame) -> DataFrame:
    """(section_head, url) of the rows with a section."""
    return url_info.where("section is not null").select(F.col("section").alias("section_head"), "url")


def section_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("section_head").agg(F.count("*").alias("n_urls"))


def members_info(members: DataFrame, url_info: DataFrame) -> DataFrame:
    """Members with their url_info columns."""
    return members.join(url_info, "url")

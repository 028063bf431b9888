"""The library's queries over the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, html, sniff, text, urls
from ..operators import graph, neardup, reports
from ..sources import hashlog
from . import captures
from .scratch import spread, table

DOMAIN = "example.org"
Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL building blocks ---------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_JAVA = "list_reduce(list_prepend(0::bigint, list_transform(string_split({w}, ''), lambda c: unicode(c)::bigint)), lambda a, b: (a * 31 + b) & 4294967295)"
_HX = "list_transform(w, lambda s: printf('%08x', " + _JAVA.format(w="s") + "))"
_HS = "case when len(hx) > 3 then list_distinct(list_transform(range(1, len(hx) - 2), lambda i: ('0x' || substr(md5(unhex(hx[i] || hx[i + 1] || hx[i + 2])), 1, 16))::ubigint)) else [] end"
_VOTE = "list_sum(list_transform(range(0, 64), lambda b: case when 2 * (len(hs) - coalesce(list_sum(list_transform(hs, lambda h: (h >> b::ubigint) & 1)), 0)) > len(hs) then (1::hugeint << (63 - b)::int) else 0::hugeint end))"


def _simhash_cte(name: str, source: str, keep: str) -> str:
    return (
        f"{name}_w as (select {keep}, {_TOKENS} as w from {source}), {name}_x as (select {keep}, {_HX} as hx from {name}_w), "
        f"{name}_h as (select {keep}, {_HS} as hs from {name}_x), {name}_v as (select {keep}, {_VOTE} as v from {name}_h), "
        f"{name} as (select {keep}, (case when v >= 9223372036854775808::hugeint then v - 18446744073709551616::hugeint else v end)::bigint as simhash from {name}_v)"
    )


def _capture_cte(name: str, statement: str) -> str:
    raw = statement.format(u="u")
    fingerprints = _simhash_cte(f"{name}_s", f"(select url, text from {name}_raw where mime_type like 'text/html%')", "url")
    return f"{name}_raw as ({raw}), {fingerprints}, {name} as (select r.*, s.simhash from {name}_raw r left join {name}_s s on r.url = s.url)"


_U = f"u as ({captures.URLS.format(documents='documents')})"
_A = _capture_cte("a", captures.CAPTURE_A)
_B = _capture_cte("b", captures.CAPTURE_B)
_A_PLAIN = f"a as ({captures.CAPTURE_A.format(u='u')})"
_B_PLAIN = f"b as ({captures.CAPTURE_B.format(u='u')})"
_GRAPH = (
    f"{_A_PLAIN}, k as (select * from a where status < 400 and mime_type like 'text/html%'), l as ({captures.LINKS.format(u='u')}), "
    "e as (select * from l where src in (select url from k) and dst in (select url from k)), "
    "v as (select distinct url from (select src as url from e union all select dst from e) x), "
    "deg as (select v.url, count(e.dst)::bigint as indegree from v left join e on e.dst = v.url and e.link_type <> 'I' group by v.url), "
    "dd as (select list_sort(list(distinct indegree)) as d from deg), thr as (select d[(len(d) // 2 + 1)::int] as threshold from dd), "
    "heads as (select distinct d.url, d.indegree from e join deg d on d.url = e.dst cross join thr where e.src = 'http://example.org/' and e.link_type <> 'I' and d.indegree >= threshold), "
    "tops as (select * from heads h where not exists (select 1 from heads g where g.url <> h.url and rtrim(g.url, '/') = g.url and h.url like g.url || '/%' and g.url <> 'http://example.org')), "
    "steps as (select distinct src, dst from e where src <> dst and dst not in (select url from tops))"
)
_PREFIXED = "m as (select url as section_head, url from tops union select m.section_head, s.dst from m join steps s on s.src = m.url and starts_with(s.dst, s.src))"


def _clusters(source: str, by: str = "") -> str:
    """CTEs n (distinct fingerprints), p (near pairs), c (reach) of a relation with simhash (and a group)."""
    g = f"{by}, " if by else ""
    same = f"x.{by} = y.{by} and " if by else ""
    step = f"c.{by} = p.{by} and " if by else ""
    return (
        f"n as (select distinct {g}simhash from {source} where simhash is not null), "
        f"p as (select {'x.' + by + ', ' if by else ''}x.simhash as s, y.simhash as t from n x join n y on {same}x.simhash <> y.simhash and bit_count(xor(x.simhash, y.simhash)) < 4), "
        f"c as (select {g}simhash, simhash as reach from n union select {'c.' + by + ', ' if by else ''}p.t, c.reach from c join p on {step}p.s = c.simhash)"
    )


def _with(*parts: str) -> str:
    return "with recursive " + ", ".join(parts)


_RATIO = "(case when {b} <> 0 then ({a})::double / {b} end)::float"

# ---- queries ---------------------------------------------------------------------------------

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_KIND = "unnest(['all', case when mime_type like 'text/html%' then 'html' else 'not_html' end] || case when mime_type like 'image/%' then ['images'] else [] end)"


@query(_with(_U, _A_PLAIN, f"k as (select md5, {_KIND} as category from a)", "g as (select category, md5, count(*) as copies from k group by all)") + " select category, copies, count(*) as n from g group by all")
def redundancy(spark, sf_dir):
    return reports.duplicate_histogram(captures.capture_a(spark, sf_dir))


@query(_with(_U, _A_PLAIN, f"k as (select md5, {_KIND} as category from a)") + " select category, count(*) as n_rows, count(distinct md5) as n_unique from k group by category")
def redundancy_totals(spark, sf_dir):
    out = reports.totals(reports.duplicate_histogram(captures.capture_a(spark, sf_dir)))
    return out.select("category", F.col("n_rows").cast("long"), F.col("n_unique").cast("long"))


_UNIQUE = "select count(distinct case when mime_type like 'text/html%' then md5 end) as uniq_html_md5, count(distinct case when mime_type not like 'text/html%' then md5 end) as uniq_not_html"


@query(_with(_U, _A, _clusters("a")) + f" {_UNIQUE}, (select count(distinct r) from (select min(reach) as r from c group by simhash) z) as near_uniq_html from a")
def unique_counts(spark, sf_dir):
    return reports.unique_counts(table(captures.capture_a(spark, sf_dir))).drop("n_rows")


@query("select doc_id, md5(text) as digest from documents")
def md5_hex(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))


@query("select doc_id, ltrim(md5(text), '0') as digest from documents")
def md5_no_zeros(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", hashing.md5_stripped(F.col("text")).alias("digest"))


@query(f"with t as (select distinct unnest({_TOKENS}) as token from documents) select token, {_JAVA.format(w='token')} as hash from t")
def java_hash(spark, sf_dir):
    words = _read(spark, sf_dir, "documents").select(F.explode(hashing.tokens(F.col("text"))).alias("token")).distinct()
    return words.select("token", hashing.java_hash(F.col("token")).alias("hash"))


@query(f"with t as (select doc_id, {_TOKENS} as w from documents) select doc_id, (case when len(w) > 3 then len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i+2]))) else 0 end)::int as n_shingles from t")
def shingles(spark, sf_dir):
    docs = spread(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", hashing.tokens(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size(hashing.shingle_keys(F.col("w"))).alias("n_shingles"))


_DOCS = _simhash_cte("d", "documents", "doc_id")


@query(f"with {_DOCS} select doc_id, simhash from d")
def simhash_text(spark, sf_dir):
    return spread(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", hashing.simhash("text").alias("simhash"))


@query(f"with {_DOCS} select x.doc_id, bit_count(xor(x.simhash, y.simhash))::int as distance from d x join d y on y.doc_id = x.doc_id + 1")
def simhash_distance(spark, sf_dir):
    one = table(simhash_text(spark, sf_dir))
    two = one.select((F.col("doc_id") - 1).alias("doc_id"), F.col("simhash").alias("other"))
    return one.join(two, "doc_id").select("doc_id", hashing.distance(F.col("simhash"), F.col("other")).alias("distance"))


@query(f"with {_DOCS}, n as (select distinct simhash from d) select x.simhash as a, y.simhash as b, bit_count(xor(x.simhash, y.simhash))::int as distance from n x join n y on x.simhash < y.simhash and bit_count(xor(x.simhash, y.simhash)) < 4")
def near_dup_pairs(spark, sf_dir):
    return neardup.near_pairs(table(simhash_text(spark, sf_dir)))


@query(_with(_DOCS, _clusters("d")) + " select simhash, min(reach) as cluster from c group by simhash")
def near_dup_components(spark, sf_dir):
    return neardup.clusters(table(simhash_text(spark, sf_dir)))


_DIVERSITY = (
    "select {g}uniq_html, uniq_not_html, n_html, n_not_html, n_all, " + _RATIO.format(a="uniq_html + uniq_not_html", b="n_all") + " as diversity, "
    + _RATIO.format(a="uniq_html", b="n_html") + " as diversity_html, " + _RATIO.format(a="uniq_not_html", b="n_not_html") + " as diversity_not_html from q"
)
_COUNTS = "count(distinct case when mime_type not like 'text/html%' then md5 end) as uniq_not_html, count(*) filter (mime_type like 'text/html%') as n_html, count(*) filter (mime_type not like 'text/html%') as n_not_html, count(*) as n_all"


@query(_with(_U, _A, _clusters("a"), f"q as (select (select count(distinct r) from (select min(reach) as r from c group by simhash) z) as uniq_html, {_COUNTS} from a)") + " " + _DIVERSITY.format(g=""))
def diversity(spark, sf_dir):
    return reports.diversity(table(captures.capture_a(spark, sf_dir)))


def _size_sql() -> str:
    parts = []
    for name, rows in (("A", "select * from a"), ("B", "select * from b"), ("AB", "select * from a union all select * from b")):
        near = f"(with recursive {_clusters(f'({rows}) r')} select count(distinct r) from (select min(reach) as r from c group by simhash) z)"
        parts.append(f"select '{name}' as capture, count(*) as n_rows, {_UNIQUE.removeprefix('select ')}, {near} as near_uniq_html from ({rows}) y")
    union = " union all ".join(parts)
    return _with(_U, _A, _B, f"q as ({union})") + " select q.*, ((near_uniq_html + uniq_not_html)::double / (select near_uniq_html + uniq_not_html from q where capture = 'AB'))::float as share from q"


@query(_size_sql())
def capture_size(spark, sf_dir):
    return reports.size(table(captures.capture_a(spark, sf_dir)), table(captures.capture_b(spark, sf_dir)))


_DISTANCES = "select a.url, bit_count(xor(a.simhash, b.simhash))::int as distance from a join b on a.url = b.url where a.simhash is not null and b.simhash is not null"


@query(_with(_U, _A, _B) + " " + _DISTANCES)
def capture_distances(spark, sf_dir):
    return reports.distances(captures.capture_a(spark, sf_dir), captures.capture_b(spark, sf_dir))


@query(
    _with(_U, _A, _B, "d as (select a.section as section_head, bit_count(xor(a.simhash, b.simhash)) as distance from a join b on a.url = b.url and a.section = b.section where a.simhash is not null and b.simhash is not null)")
    + " select section_head, count(*) as n_urls, (count(*) filter (distance > 8)::double / count(*))::float as changed from d group by section_head"
)
def changed_proportion(spark, sf_dir):
    both = [rows.where("section is not null").withColumnRenamed("section", "section_head") for rows in (captures.capture_a(spark, sf_dir), captures.capture_b(spark, sf_dir))]
    return reports.changed_share(reports.distances(*both, by=("section_head",)), ("section_head",))


@query(_with(_U, _A_PLAIN, _B_PLAIN, "r as (select line_no, url, status, md5 from a union all select line_no + 1000000, url, status, md5 from b)") + " select url, arg_max(status, line_no) as status, arg_max(md5, line_no) as md5 from r group by url")
def last_wins(spark, sf_dir):
    a, b = captures.capture_a(spark, sf_dir), captures.capture_b(spark, sf_dir)
    rows = a.select("line_no", "url", "status", "md5").union(b.select(F.col("line_no") + 1_000_000, "url", "status", "md5"))
    return hashlog.last_wins(rows)


@query(_with(_U, _A_PLAIN) + " select url, mime_type from a where mime_type like 'text/html%' and not regexp_matches(lower(url), '[.](js|css)$')")
def html_filter(spark, sf_dir):
    return captures.capture_a(spark, sf_dir).where(hashlog.html_only(F.col("url"), F.col("mime_type"))).select("url", "mime_type")


@query(_with(_U, _A_PLAIN) + " select url, status from a where status < 400")
def status_filter(spark, sf_dir):
    return captures.capture_a(spark, sf_dir).where(hashlog.skip_errors(F.col("status"))).select("url", "status")


@query(_with(_U, _A) + " select url, simhash from a where simhash is not null")
def simhash_filter(spark, sf_dir):
    return captures.capture_a(spark, sf_dir).where(hashlog.has_fingerprint(F.col("simhash"), F.col("simhash_main_text"))).select("url", "simhash")


_HOST = "regexp_extract(url, '^https?://([^/?#:]*)', 1)"


@query(f"select page_id, ({_HOST} = 'example.org' or {_HOST} like '%.example.org') as inside from pages")
def in_domain(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", urls.in_domain(F.col("url"), DOMAIN).alias("inside"))


@query(f"select page_id, case when starts_with({_HOST}, 'www') then regexp_replace({_HOST}, '^[^.]*[.]', '') else {_HOST} end as domain from pages")
def strip_www(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", urls.strip_www(urls.part(F.col("url"), "HOST")).alias("domain"))


def _graph(spark, sf_dir):
    rows = captures.capture_a(spark, sf_dir)
    info = rows.where(hashlog.skip_errors(F.col("status")) & hashlog.html_only(F.col("url"), F.col("mime_type")))
    return graph.web_graph(captures.links(spark, sf_dir), info)


@query(_with(_U, _GRAPH) + " select url, indegree from deg")
def indegree(spark, sf_dir):
    return graph.indegrees(*_graph(spark, sf_dir)).select("url", "indegree")


@query(_with(_U, _GRAPH, "q as (select unnest(['all', 'html']) as category, indegree from deg)") + " select category, indegree, count(*) as n from q group by all")
def indegree_distribution(spark, sf_dir):
    return graph.indegree_histogram(graph.indegrees(*_graph(spark, sf_dir)))


@query(_with(_U, _GRAPH) + " select threshold from thr")
def head_threshold(spark, sf_dir):
    return graph.head_threshold(graph.indegrees(*_graph(spark, sf_dir)))


@query(_with(_U, _GRAPH) + " select url from v where url = 'http://example.org/'")
def select_root(spark, sf_dir):
    return graph.select_root(_graph(spark, sf_dir)[0], DOMAIN)


@query(_with(_U, _GRAPH) + " select url, indegree from heads")
def section_heads(spark, sf_dir):
    return graph.section_heads(*_graph(spark, sf_dir), DOMAIN)


@query(_with(_U, _GRAPH) + " select url, indegree from tops")
def top_heads(spark, sf_dir):
    return graph.top_heads(graph.section_heads(*_graph(spark, sf_dir), DOMAIN))


def _tops(spark, sf_dir):
    vertices, edges = _graph(spark, sf_dir)
    return vertices, edges, table(graph.top_heads(graph.section_heads(vertices, edges, DOMAIN)))


@query(_with(_U, _GRAPH, _PREFIXED) + " select section_head, url from m")
def sections_prefix(spark, sf_dir):
    return graph.sections_by_links(*_tops(spark, sf_dir))


@query(
    _with(_U, _GRAPH, "m as (select url as section_head, url, 0 as hops from tops union select m.section_head, s.dst, hops + 1 from m join steps s on s.src = m.url where hops < 12)", "f as (select url, min(hops) as hops from m group by url)")
    + " select min(m.section_head) as section_head, m.url from m join f on m.url = f.url and m.hops = f.hops group by m.url"
)
def sections_closest(spark, sf_dir):
    return graph.sections_by_distance(*_tops(spark, sf_dir))


@query(_with(_U, _A_PLAIN) + " select section as section_head, url from a where section is not null")
def sections_breadcrumb(spark, sf_dir):
    return graph.sections_by_breadcrumb(captures.capture_a(spark, sf_dir))


@query(_with(_U, _GRAPH, _PREFIXED) + " select section_head, count(*) as n_urls from m group by section_head")
def section_sizes(spark, sf_dir):
    return graph.section_sizes(graph.sections_by_links(*_tops(spark, sf_dir)))


@query(
    _with(_U, _A, _clusters("(select section as head, simhash from a where section is not null)", "head"), "r as (select head, simhash, min(reach) as root from c group by head, simhash)", "h as (select head, count(distinct root) as uniq_html from r group by head)",
          f"q0 as (select section as section_head, {_COUNTS} from a where section is not null group by section)", "q as (select q0.*, coalesce(uniq_html, 0) as uniq_html from q0 left join h on h.head = q0.section_head)")
    + " " + _DIVERSITY.format(g="section_head, ")
)
def section_diversity(spark, sf_dir):
    rows = table(captures.capture_a(spark, sf_dir).where("section is not null").withColumnRenamed("section", "section_head"))
    return reports.diversity(rows, by=("section_head",))


@query(
    _with(_U, _A, _B, "d as (select a.section as section_head, a.url, bit_count(xor(a.simhash, b.simhash))::int as distance from a join b on a.url = b.url and a.section = b.section where a.simhash is not null and b.simhash is not null)")
    + " select section_head, url, distance from d"
)
def section_distances(spark, sf_dir):
    both = [rows.where("section is not null").withColumnRenamed("section", "section_head") for rows in (captures.capture_a(spark, sf_dir), captures.capture_b(spark, sf_dir))]
    return reports.distances(*both, by=("section_head",))


@query("select doc_id, trim(regexp_replace(text, '[\\s\\x{A0}]+', ' ', 'g')) as text from documents")
def whitespace(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.normalize_whitespace(F.col("text")).alias("text"))


@query("select conv_id, turn, not regexp_matches(text, '[^ \\t\\n\\f\\r]') as blank, regexp_full_match(text, '[\\p{Nd}]+') as numeric from conversations")
def blank_numeric(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_blank(F.col("text")).alias("blank"), text.is_numeric(F.col("text")).alias("numeric"))


@query(_with(_U, _A_PLAIN) + " select url, regexp_matches(lower(mime_type), 'pdf|word|powerpoint|office|excel|html|sgml|xml|text|rtf') as mime_qualifies, (status between 200 and 299) as status_qualifies from a")
def mime_qualifying(spark, sf_dir):
    a = captures.capture_a(spark, sf_dir)
    return a.select("url", sniff.mime_qualifies(F.col("mime_type")).alias("mime_qualifies"), sniff.status_qualifies(F.col("status").cast("string")).alias("status_qualifies"))


@query("with l as (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href from pages) select page_id, count(*) as n_links from l group by page_id")
def link_extract(spark, sf_dir):
    found = _read(spark, sf_dir, "pages").select("page_id", F.explode(html.page_links("html", "url")).alias("x")).where("x.kind = 'a/@href'")
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"))


_ABSOLUTE = (
    "r as (select *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') as site, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) as path from l), "
    "s as (select *, list_filter(string_split(rtrim(path, '/'), '/')[2:], lambda x: true) as folder, case when regexp_matches(href, '^/+$') then [] when starts_with(href, '/') "
    "then string_split(rtrim(href, '/'), '/')[2:] when href = '' then [''] else string_split(rtrim(href, '/'), '/') end as names from r), "
    "t as (select *, case when starts_with(href, '/') then []::varchar[] when ends_with(url, '/') then folder else folder[:len(folder) - 1] end as here from s), "
    "f as (select *, list_reduce(list_prepend(here, list_transform(names, lambda n: [n])), lambda a, n: case when n[1] = '..' then a[:len(a) - 1] when n[1] = '.' then a else a || n end) as steps from t)"
)


@query(
    "with l as (select page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href from pages), " + _ABSOLUTE
    + " select page_id, href, case when regexp_matches(href, '^https?://') then href when not starts_with(href, '/') and not ends_with(url, '/') and len(folder) = 0 and path = '/' then null else site || '/' || array_to_string(steps, '/') end as target from f"
)
def absolute_url(spark, sf_dir):
    links = html.page_links("html", F.lit(None).cast("string"))
    rows = _read(spark, sf_dir, "pages").select("page_id", "url", F.explode(links).alias("x")).where("x.kind = 'a/@href'")
    return rows.select("page_id", F.col("x.value").alias("href"), urls.absolute_url(F.col("url"), F.col("x.value")).alias("target"))


# the text of a page, for pages whose text stands inside block elements: a new line wherever one begins or ends
_ENTITIES = [("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("eacute", "é"), ("copy", "©"), ("middot", "·"), ("mdash", "—"), ("hellip", "…"), ("amp", "&")]


def _unescaped(x: str) -> str:
    for name, sign in _ENTITIES:
        x = f"replace({x}, '&{name};', '{sign}')"
    return x


_PAGE_TEXT = (
    "x as (select page_id, url, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'gs') as h from pages), "
    "y as (select page_id, regexp_extract(h, '<title>([^<]*)</title>', 1) as title, regexp_extract(h, '<body[^>]*>(.*)', 1, 's') as h from x), "
    f"z as (select page_id, title, regexp_replace(regexp_replace(regexp_replace(h, '[\\s\\x{{A0}}]+', ' ', 'g'), '</?({'|'.join(sorted(html.BLOCKS))})( [^>]*)?>', '\n', 'g'), '<[^>]*>', '', 'g') as h from y), "
    "p as (select page_id, trim(regexp_replace(" + _unescaped("title") + ", '[\\s\\x{A0}]+', ' ', 'g')) as title, "
    "trim(regexp_replace(regexp_replace(" + _unescaped("h") + ", '[ \\x{A0}]+', ' ', 'g'), ' ?\\n[ \\n]*', '\n', 'g'), E' \\n') as body from z)"
)


@query(f"with {_PAGE_TEXT} select page_id, title, body from p")
def extract_text(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", html.extract_text("html").alias("t")).select("page_id", "t.title", "t.body")


@query(f"with {_PAGE_TEXT}, {_simhash_cte('f', "(select page_id, title || ' ' || body as text from p)", 'page_id')} select page_id, simhash from f")
def page_simhash(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", html.page_simhash("html").alias("simhash"))


@query()
def main_text(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", html.main_text("html", "url").alias("text"))


@query()
def readable_page(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", html.readable_page("html", "url").alias("r")).select("page_id", "r.*")


@query("select page_id, regexp_extract(url, '^https?://[^/?#]+') || '/' || (page_id % 7) || '/x' as section from pages")
def section_head(spark, sf_dir):
    crumbs = F.concat(F.lit('<div class="breadcrumb"><a href="/">Home</a><a href="/'), F.col("page_id") % 7, F.lit('/x">S</a></div>'), F.col("html"))
    return _read(spark, sf_dir, "pages").select("page_id", html.section_head(crumbs, "url").alias("section"))


@query()
def clean_html(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", html.clean_html("html", "url").alias("html"))


# what DuckDB holds as text is valid UTF-8
@query("select page_id, case when regexp_matches(lower(substr(html, 1, 1024)), '^\\s*<(!doctype\\s+html|html|head|body|title|h1|p|div|script|table|a )') then 'text/html' else 'text/plain' end as mime_type, 'UTF-8' as charset from pages")
def sniff_content(spark, sf_dir):
    content = F.col("html").cast("binary")
    return _read(spark, sf_dir, "pages").select("page_id", sniff.mime_type(content).alias("mime_type"), sniff.detect_charset(content).alias("charset"))


@query(_with(_U, _A) + " select url, status, md5, simhash, case when simhash is not null then section end as section from a")
def hash_log(spark, sf_dir):
    """The text form written and parsed again; it has a section for rows with a fingerprint only."""
    rows = captures.capture_a(spark, sf_dir)
    lines = hashlog.resource_lines(rows).select(F.monotonically_increasing_id().alias("line_no"), "value")
    return hashlog.parse_resources(lines).select("url", "status", "md5", "simhash", "section")


@query(f"with {_U}, l as ({captures.LINKS.format(u='u')}) select src, dst, link_type from l")
def link_log(spark, sf_dir):
    return hashlog.parse_links(hashlog.link_lines(captures.links(spark, sf_dir)))

import random

import pytest
from pyspark.sql import functions as F

from webgauge.functions import hashing, html, sniff, text, urls


@pytest.mark.parametrize(
    "base,link,want",
    [
        ("http://h.org/a/b.html", "c.html", "http://h.org/a/c.html"),
        ("http://h.org/a/b/", "c", "http://h.org/a/b/c"),
        ("http://h.org", "c", "http://h.org/c"),
        ("http://h.org/", "c", "http://h.org/c"),
        ("http://h.org/?q=1", "c", None),
        ("http://h.org/a?q=/", "c", "http://h.org/a/c"),
        ("http://h.org/a/b", "/news/", "http://h.org/news"),
        ("http://h.org/a/b", "/", "http://h.org/"),
        ("http://h.org/a/b", "", "http://h.org/a/"),
        ("http://h.org/a/b", "../../x", "http://h.org/x"),
        ("http://h.org/a/b", "../../../x", "http://h.org/x"),
        ("http://h.org/a/b", "./x", "http://h.org/a/x"),
        ("http://h.org/a/b", "//cdn.org/x", "http://h.org//cdn.org/x"),
        ("http://h.org/a/b", "?p=2", "http://h.org/a/?p=2"),
        ("http://h.org/a/b", "#top", "http://h.org/a/#top"),
        ("http://h.org/a/b", "mailto:x@y", "http://h.org/a/mailto:x@y"),
        ("http://h.org/a/b", "https://o.org/z", "https://o.org/z"),
        ("http://h.org:8080/a/b", "c", "http://h.org:8080/a/c"),
    ],
)
def test_absolute_url(base, link, want):
    assert urls.resolve(base, link) == want


def test_absolute_url_as_column(spark):
    rng = random.Random(2)
    bases = ["http://h.org", "http://h.org/", "http://h.org/?q=1", "http://h.org/a?q=/", "http://h.org/a/b", "HTTP://h.org:80/a//b//", "http://u@h.org/a/b#x/", "h.org/a", "", "mailto:x", "//h.org/x", None]
    links = ["".join(rng.choice(["/", "..", ".", "a", "?q", "#", "//", "b c", "http://"]) for _ in range(rng.randint(0, 6))) for _ in range(400)] + [None, "https://o.org/z"]
    rows = [(b, x) for b in bases for x in links]
    got = spark.createDataFrame(rows, "b string, x string").select("b", "x", urls.absolute_url("b", F.col("x")).alias("u")).collect()
    for r in got:
        assert r.u == urls.resolve(r.b, r.x), r


def test_hashes(spark):
    words = "the quick brown fox jumps over the lazy dog é".split()
    assert hashing.fingerprint(words) == -1294381012302175810
    assert hashing.fingerprint("a b c".split()) == 0
    df = spark.createDataFrame([(" ".join(words), words), ("a b c", ["a", "b", "c"]), ("", []), (None, None)], "t string, w array<string>")
    got = df.select(hashing.simhash("t"), hashing.simhash_sql(F.col("w")), hashing.java_hash(F.lit("hello")), hashing.java_hash(F.lit("é")), F.size(hashing.shingles(F.col("w")))).collect()
    assert [tuple(r) for r in got][:3] == [(-1294381012302175810, -1294381012302175810, 99162322, 233, 7), (0, 0, 99162322, 233, 0), (0, 0, 99162322, 233, 0)]
    assert got[3][0] is None
    assert spark.range(1).select(hashing.distance(F.lit(0), F.lit(7)), hashing.md5_stripped(F.lit("a"))).first()[0] == 3


def test_url_functions(spark):
    rows = [("http://notexample.org/",), ("http://a.example.org/x",), ("http://example.org",), ("ftp://example.org/",), ("http://a b/",), (None,)]
    df = spark.createDataFrame(rows, "u string")
    assert [r[0] for r in df.select(urls.in_domain(F.col("u"), "example.org")).collect()] == [False, True, True, False, False, False]
    one = spark.range(1)
    assert tuple(one.select(*[urls.strip_www(F.lit(x)) for x in ("www2.x.com", "wwwfoo.com", "x.com")]).first()) == ("x.com", "com", "x.com")
    assert one.select(urls.proper_prefixes(F.lit("http://h.org/news/a"))).first()[0] == ["http://h.org/news"]
    assert one.select(urls.proper_prefixes(F.lit("http://h.org/sport/"))).first()[0] == ["http://h.org/sport"]
    assert one.select(urls.status_code(F.lit("HTTP/1.1 200 OK")), urls.status_code(F.lit("x"))).first()[0] == 200
    assert one.select(urls.location_header(F.lit("HTTP/1.1 301\r\nLocation: /x \r\nA: b"))).first()[0] == "/x"


def test_text_and_sniffing(spark):
    one = spark.range(1)
    row = one.select(
        text.normalize_whitespace(F.lit(" a\u00a0\t b ")), text.is_blank(F.lit(" \t")), text.is_numeric(F.lit("1٣")), text.padding(F.lit(2)), sniff.status_qualifies(F.lit("abc")),
        sniff.mime_qualifies(F.lit("application/PDF")), sniff.mime_type(F.lit("<html>").cast("binary")), sniff.mime_type(F.unhex(F.lit("89504E470D0A"))), sniff.mime_type(F.lit("plain").cast("binary")),
    ).first()
    assert tuple(row) == ("a b", True, True, "  ", True, True, "text/html", "image/png", "text/plain")
    assert sniff.charset("é".encode()) == "UTF-8"
    assert sniff.charset(b'<meta charset="iso-8859-1">\xe9') == "iso8859-1"
    assert sniff.charset(b"\xe9") == "windows-1252"


def test_string_helpers(spark):
    one = spark.range(1)
    row = one.select(
        text.collapse_whitespace(F.lit(" a \t\nb\u00a0")), text.collapse_whitespace(F.lit(" a"), True), text.is_whitespace(F.lit("\f")), text.is_whitespace(F.lit("x")),
        text.join(F.array(F.lit("a"), F.lit("b")), "-"), text.is_in(F.lit("b"), F.array(F.lit("a"), F.lit("b"))), text.padding(F.lit(0)),
    ).first()
    assert tuple(row) == (" a b\u00a0", "a", True, False, "a-b", True, "")
    with pytest.raises(Exception, match="negative"):
        one.select(text.padding(F.lit(-1))).collect()


def test_unicode_words():
    """Examples of the word boundary rules of Unicode's annex 29."""
    assert hashing.tokenize("The quick (\u201cbrown\u201d) fox can\u2019t jump 32.3 feet, right?", "uax29") == ["the", "quick", "brown", "fox", "can\u2019t", "jump", "32.3", "feet", "right"]
    assert hashing.tokenize("a_b 3,456.789 e.g. x", "uax29") == ["a_b", "3,456.789", "e.g", "x"]


def test_html():
    assert html.extract("<body>a<br>b")[1] == "ab"
    assert html.extract("<body><p>a</p>b")[1] == "a\nb"
    assert html.extract("<body>a<p>b</p>")[1] == "ab"
    assert html.extract("<title>T &amp; U</title><body><script>x</script>c")[0] == "T & U"
    page = "<html><title>U</title><body><div class=menu>m m m</div><div id=content><p>" + "word " * 60 + "</p><p>" + "more " * 60 + "</p></div></body>"
    assert html.main_text_of(page, "http://h.org/").endswith("moreU")
    assert "m m m" not in html.main_text_of(page, "http://h.org/")
    crumbs = '<ul class="breadcrumb"><li><a href="/">Home</a><li><a href="/news">News</a></ul>'
    assert html.section_head_of(crumbs, "http://h.org/news/a") == "http://h.org/news"
    assert html.section_head_of("<p>", "http://h.org/") is None
    cleaned = html.clean('<p onclick="x()"><a href="b?x">l</a><script>s</script><iframe src="q"></iframe><br>', "http://h.org/a/c")
    assert cleaned == '<p><a href="http://h.org/a/b?x">l</a><iframe></iframe><br /></p>'


PAGE = (
    '<html><head><title>T</title></head><body><div class="header"><a href="/">Home</a> <a href="/a">About us and many others</a></div>'
    '<div class="wrap with-sidebar"><div id="x"><h2>Heading</h2><p>{0}</p><p>Short.</p><div class="share">tell your friends now</div><ul><li><a href="/l">{1}</a></li></ul>'
    '<img src="big.jpg" width=300 height=200 alt="b"><img src="s.png" width="60" height="60"><img src="g.gif"><img src="odd.png" width="50%"><p>{0}</p></div>'
    '<div class="sidebar"><p>latest</p><p>news</p></div></div><div>imprint and contact</div></body></html>'
).format("Some words of the story. " * 8, "see also this other long page about it")


def test_main_text_is_the_part_of_most_worth():
    title, shown, found, image, images = html.readable_content(PAGE, "http://h.org/d/e")
    story = ("Some words of the story. " * 8).strip()
    assert title == "T" and found == f"Heading\n{story}\nShort.\n{story}"
    assert image == "http://h.org/d/big.jpg" and images == [image, "http://h.org/d/odd.png"]
    assert "s.png" not in shown and "g.gif" not in shown and "friends" not in shown
    assert html.readable_content("", None) == ("", "", "", None, []) and html.main_text_of("<p>hi", None) == "hi"
    root = html.parse(PAGE)
    best = html.main_node(root)
    assert best.attributes.get("id") == "x"
    assert best.worth >= html.KEEP * max(n.worth for n in root.elements() if n.tag in html.HOLDERS)
    nothing_named = PAGE.replace(' class="header"', "").replace(' id="x"', "").replace(' class="wrap with-sidebar"', "")
    assert html.main_text_of(nothing_named, "http://h.org/d/e") == found + "T"


def test_deep_and_broken_pages():
    for tag in ("div", "b", "p", "span", "ul"):
        deep = f"<{tag}>" * 5000 + "the text" + f"</{tag}>" * 5000
        assert html.main_text_of(deep, None) == "the text" and "the text" in html.extract(deep)[1]
        assert "the text" in html.clean(deep, "http://h.org/")
    for odd in ("</i>" * 200_000, "<b>" * 20_000 + "</i>" * 20_000, "<b>" * 20_000 + "<p>" * 20_000, "<a 'x" * 5_000, "<!--", "<", "&#x110000;"):
        html.readable_content(odd, "http://h.org/")
        html.clean(odd, "http://h.org/")


def test_cleaning_links():
    source = '<base href="http://h.org/b/"><table background="i.png"><td><a href=" c " cite="d">x</a><q cite="d">y</q><img src="e" longdesc="f"></table><style>@import "p.css"; @import url(q.css);a > b{}</style>'
    cleaned = html.clean_until_stable(source, "http://h.org/a")
    for want in ('background="http://h.org/b/i.png"', 'href="http://h.org/b/c"', '<a href="http://h.org/b/c" cite="d">', '<q cite="http://h.org/b/d">', 'longdesc="http://h.org/b/f"'):
        assert want in cleaned, (want, cleaned)
    assert '@import url("http://h.org/b/p.css"); @import url("http://h.org/b/q.css");a > b{}' in cleaned
    assert html.clean(cleaned, "http://h.org/a") == cleaned


def test_second_charset_opinion():
    assert sniff.charset_alt(b"plain") == "UTF-8" and sniff.charset_alt("é à".encode()) == "UTF-8"
    assert sniff.charset_alt(b"x" * 200 + "日本語の文章です".encode("euc_jp")) == "euc_jp"
    assert sniff.charset_alt("где мой дом".encode("cp1251") + b"\xff") in ("windows-1252", "euc_jp", "shift_jis", "euc_kr", "gb18030", "big5")
    assert sniff.charset_alt("caf\u00e9 est ouvert".encode("latin-1")) == "windows-1252"


def test_document():
    from xml.dom.minidom import parseString

    source = '<html lang=en><p 1x="a" b="c\x01">t &amp; u<my:tag>gone</my:tag><br></p><x<y>z</x></html>tail'
    document = html.to_dom(source)
    again = parseString(html.to_bytes(document))
    assert again.documentElement.getAttribute("lang") == "en" and again.getElementsByTagName("p")[0].getAttribute("b") == "c"
    assert "gone" not in again.toxml() and "t &amp; u" in again.toxml() and "tail" in again.toxml()
    assert again.documentElement.tagName == html.to_dom("").documentElement.tagName == "html"


def test_queries_of_pages_read_references_with_a_semicolon_only(spark):
    cut = "<title>a &amp; b&amp</title><body><p>c&copy d&notit; &#39;e&#39 \ue000&lt;f&amp;amp;</p>"
    assert html.extract(cut) == ("a & b&", "c\u00a9 d\u00acit; 'e' \ue000<f&amp;")
    assert html.extract(cut, ended=True) == ("a & b&amp", "c&copy d&notit; 'e&#39 \ue000<f&amp;")
    df = spark.createDataFrame([("<title>one two three b&amp</title><body><p>four five</p>",)], "h string")
    row = df.select(html.extract_text("h").alias("t"), html.page_simhash("h").alias("s")).first()
    assert row.t.title == "one two three b&amp"
    assert row.s == hashing.fingerprint("one two three b amp four five".split())


def test_shingles_are_told_apart_as_strings(spark):
    odd = ["a", "\0", "\1", "\0a", None, "", "\1c", "\0", "\1b", "a", "\0", "\1", "\0a", "x"]
    df = spark.createDataFrame([(odd,), (["a", "b", "c"],), ([],), (None,)], "w array<string>")
    rows = df.select(hashing.shingle_keys(F.col("w")).alias("k"), hashing.shingles(F.col("w")).alias("s"), hashing.shingles(F.col("w"), include_last=True).alias("all")).collect()
    want = list(dict.fromkeys(tuple(odd[k : k + 3]) for k in range(len(odd) - 3)))
    assert [tuple(run) for run in rows[0].s] == want and len(set(rows[0].k)) == len(rows[0].k) == len(want) < len(odd) - 3
    assert [r.s for r in rows[1:]] == [[], [], []] and rows[1]["all"] == [["a", "b", "c"]]


def test_batches_are_turned_into_python_objects_in_pieces(monkeypatch):
    import pyarrow as pa

    held, most = [0], [0]

    class Seen(str):
        def __new__(cls, value):
            held[0] += 1
            most[0] = max(most[0], held[0])
            return super().__new__(cls, value)

        def __del__(self):
            held[0] -= 1

    real = html.readable_content
    monkeypatch.setattr(html, "readable_content", lambda s, u: tuple(Seen(x) if isinstance(x, str) else x for x in real(s, u)))
    pages = pa.array([f"<title>t{k}</title><p>text {k}</p>" for k in range(1000)] + [None])
    out = html.readable_page.func(pages, pa.nulls(1001, pa.string())).to_pylist()
    assert [r["title"] for r in out] == [f"t{k}" for k in range(1000)] + [""] and most[0] <= 4 * html.PIECE
    assert hashing.simhash.func(pa.array(["a b c d", None])).to_pylist() == [hashing.fingerprint("a b c d".split()), None]
    assert html.readable_page.func(pages[:0], pages[:0]).to_pylist() == []

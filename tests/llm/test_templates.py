import html
import random
import re
import time

from webgauge.llm import templates as T

PAGE = (
    '<html><head><title>x</title><style>p{}</style><script>var a="</p>";</script></head><body><header><a href=/>Site</a></header>'
    '<div class="menu"><a href=/a>A</a></div><div id="content"><h1>Title {n} &amp; more</h1><p>First <b>bold{n}</b>\n text.<p>Second &lt;{n}&gt;<br>line</p>'
    '<div class="ad">Buy</div><div class="comments"><p>Nice {n}</p></div></div><div class="x">Same words on every page</div><form>q</form></body></html>'
)


def test_page_text():
    p = T.Page("<p>a<b>b</b> c</p><ul><li>x<li>y</ul>&nbsp;t&eacute;<!-- no --><p>z")
    assert p.text(p.kept(None)) == "ab c\nx\ny\nté\nz"
    p = T.Page('<nav>n</nav><article><h1>H</h1><p>a<br>b<aside>s</aside><p title="x>y">c</article><footer>f')
    assert p.text(p.kept(p.own_roots())) == "H\na b\nc"
    for broken in ("<", "<p", "<!-- x", "<script>x", "a < b", "<a b='", "</", "&#x110000; &bogus;", "<a b='c>d", "<script></script x"):
        T.Page(broken)
    assert T.main_text("a < b <3 <p title='>x") == "a < b <3\nx"


def test_odd_pages_take_linear_time():
    n = 150_000
    odd = ["<div>" * n, "</i>" * n, "<b>" * n + "</i>" * n, "<b>" * n + "<p>" * n, '<a "x"' * n, "<a 'x\">" * n, "<a <" * n, "<!x" * n, "<script>" + "</script " * n, "<p class='ad'>" * n, "<article>" * n + "x", "<td><p>" * n, "&amp" * n]
    for source in odd:
        began = time.time()
        T.main_text(source)
        T.page_tokens(source)
        assert time.time() - began < 30, source[:20]


def test_wrappers_named_after_their_sidebar():
    text = T.main_text
    side = '<div class="sidebar">s</div>'
    for name in ("content-sidebar-wrap", "with-sidebar"):
        for tag in ("main", "article", "div"):
            assert text(f'<p>x<div class="{name}"><div class="outer with-menu"><{tag}><p>the text of the page</{tag}>{side}</div></div>') in ("the text of the page", "x\nthe text of the page")
    assert text(f'<main class="with-sidebar"><p>the text{side}</main>') == "the text"
    assert text('<div id="c"><p>short</div><div class="comments"><p>a much longer comment</div>') == "short"
    assert text('<article><p>short</article><div class="related-posts"><article><p>a much longer text</article></div>') == "short"
    assert text('<div class="content-sidebar-wrap"><main><p>text</main></div><div class="nav-menu"><p>menu</div>') == "text"


def test_templates_of_a_host(spark):
    rows = [(k, "http://h.org/%d" % k, PAGE.replace("{n}", f"n{k}")) for k in range(6)]
    rows += [(10, "http://o.org/", "<body><p>only</p><footer>f</footer>"), (11, None, None), (12, "http://h.org/9", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as slot")
    got = sorted((r.page_id, r.text, r.n_chars) for r in T.main_texts(df).collect())
    body = "Title n{0} & more\nFirst boldn{0} text.\nSecond <n{0}> line"
    want = [(k, body.format(k), len(body.format(k))) for k in [0, *range(6)]] + [(10, "only", 4), (11, "", 0), (12, "", 0)]
    assert got == want
    assert T.main_texts(df.limit(0)).count() == 0


def test_given_pages(spark, tiny):
    for r in T.main_texts(spark.read.parquet(f"{tiny}/pages.parquet")).join(spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b)


def plain_template(sources):
    """The classes of a host and their slots as the docstring of the module has them, with whole vectors and lists."""
    pages = [T.Page(x) for x in sources if x]
    if len(pages) < T.PAGES:
        return None
    vectors, places, labels = {}, {}, {}
    texts = {}
    for n, p in enumerate(pages):
        for k in range(1, len(p.tags)):
            if p.tags[k] not in T.INLINE and not p.dropped[k]:
                chain, j = [], k
                while j > 0:
                    chain.append(p.labels[j])
                    j = p.parents[j]
                vectors.setdefault(tuple(chain), [0] * len(pages))[n] += 1
                places.setdefault((tuple(chain), n), k)
                labels[tuple(chain)] = p.tags[k]
        for t, block in p.texts():
            if not p.dropped[block[0][0]]:
                texts.setdefault(t, [0] * len(pages))[n] += 1
    fixed_texts = {t for t, v in texts.items() if v == [1] * len(pages)}
    classes = {}
    for token, v in vectors.items():
        if max(v) == 1 and 2 * sum(v) > len(pages):
            classes.setdefault(tuple(v), []).append(token)
    classes = {v: sorted(x, key=lambda c: (sum(places[c, n] for n in range(len(pages)) if v[n]) / sum(v), T.text_token(str(c)))) for v, x in classes.items() if len(x) >= T.LARGE}
    data, fixed, wrong = {}, {}, {}
    whole = [0, 0]
    for n, p in enumerate(pages):
        for t, block in p.texts():
            for e, piece in block:
                size = len("".join(piece.split()))
                if p.dropped[e] or p.linked[e]:
                    continue
                whole[t in fixed_texts] += size
                chain, j = [], e
                while j > 0:
                    chain.append(p.labels[j])
                    j = p.parents[j]
                for k in range(len(chain)):
                    of = fixed if t in fixed_texts else data
                    of[tuple(chain[k:])] = of.get(tuple(chain[k:]), 0) + size
        for v, members in classes.items():
            here = [c for c in members if v[n]]
            for a, b in zip(here, here[1:], strict=False):
                if places[a, n] > places[b, n]:
                    wrong.setdefault(a, set()).add(n)
                    wrong.setdefault(b, set()).add(n)
    copies = whole[1] >= T.COPIES * sum(whole)
    held = lambda c: data.get(c, 0) + (fixed.get(c, 0) if copies else 0)
    of = whole[0] + (whole[1] if copies else 0)
    good = [c for v, x in classes.items() for c in x if 10 * len(wrong.get(c, ())) <= sum(v) and labels[c] in T.HOLDERS and of and held(c) >= T.KEEP * of]
    named = sorted((c for c in good if labels[c] in T.SLOTS), key=len)
    chain = named + sorted((c for c in good if labels[c] not in T.SLOTS), key=len, reverse=True)
    return chain, fixed_texts if chain and data.get(chain[0], 0) >= fixed.get(chain[0], 0) else set()


def layouts():
    """Hosts without article elements, with misleading names, a constant sidebar in the wrapper, and lists of comments."""
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("aeioubcdlmnst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    hosts = {}
    for name, page in {
        "plain.org": '<body><div class="top"><a href="/">home</a> {brand}</div><div id="c{k}">{main}</div><div class="z"><p>{side}</p></div></body>',
        "wrong-names.org": '<body><div class="main content">{brand} {side}</div><div class="sidebar ad">{main}</div><div class="article">{short}</div></body>',
        "wrapper.org": '<body><div class="wrap"><div class="a"><p>{side}</p><p>{side2}</p></div><div class="b">{main}<div class="comments"><div class="comment"><p>{short}</p></div></div></div></div></body>',
        "tables.org": "<body><table><tr><td>{side}</td><td class=m>{main}<p>{notice}</p></td></tr></table></body>",
    }.items():
        brand, side, side2, notice = say(3), say(60), say(50), say(12)
        rows = []
        for k in range(6):
            blocks = [say(rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
            fill = {"k": k, "brand": brand, "side": side, "side2": side2, "notice": notice, "short": say(6), "main": f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])}
            rows.append((f"http://{name}/{k}", page.format(**fill), "\n".join(blocks)))
        hosts[name] = rows
    return hosts


def test_hosts_without_articles_or_with_wrong_names(spark):
    rows = [(n, *row) for n, row in enumerate(r for rows in layouts().values() for r in rows)]
    got = {r.page_id: r.text for r in T.main_texts(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    changed = 0
    for n, url, source, want in rows:
        assert got[n] == want, url
        changed += T.main_text(source) != want
    assert changed == 24  # without a template every one of these pages comes out wrong


def test_templates_equal_the_plain_deduction(spark):
    rng = random.Random(8)
    rows = [r for rows in layouts().values() for r in rows]
    for k in range(12):  # random hosts: elements that come and go, swap places and repeat
        parts = [f"<div class=x{j}>{{t}}</div>" for j in range(5)] + ["<section>{t}<p>{t}</p></section>", "<main>{t}</main>"]
        parts = rng.sample(parts, rng.randint(2, 6))
        for j in range(rng.randint(1, 7)):
            mine = [p for p in parts if rng.random() < 0.9]
            if rng.random() < 0.3:
                rng.shuffle(mine)
            body = "".join(p.replace("{t}", " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(1, 12)))) for p in mine)
            rows.append((f"http://r{k}.org/{j}", f"<html><body><div>{body}</div><p>same on all</p></body></html>", None))
    df = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in T.main_texts(df).collect()}
    hosts = {}
    for k, (u, h, _) in enumerate(rows):
        hosts.setdefault(T.host(u), []).append((k, h))
    for of in hosts.values():
        found = plain_template([h for _, h in of])
        for k, h in of:
            page = T.Page(h)
            want = T.main_text(h)
            if found and found[0]:
                paths = [".".join(c) for c in found[0]]
                once = {}
                for e in range(1, len(page.tags)):
                    chain, j = [], e
                    while j > 0:
                        chain.append(page.labels[j])
                        j = page.parents[j]
                    once.setdefault(".".join(chain), []).append(e)
                slot = next((once[x][0] for x in paths if len(once.get(x, ())) == 1), None)
                without = frozenset(T.text_token(t) for t in found[1])
                if slot is not None:
                    want = page.text(page.kept([slot], page.tags[slot] != "body"), without)
                else:
                    page.clear_wrappers()
                    want = page.text(page.kept(page.own_roots()), without)
            assert got[k] == want, (k, h)

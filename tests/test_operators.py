import random

from pyspark.sql import functions as F

from webgauge.operators import graph, neardup, reports
from webgauge.operators.components import components

INFO = "url string, status int, mime_type string, redir_location string, md5 string, simhash long, simhash_main_text long, section string"


def info(spark, urls, **more):
    return spark.createDataFrame([(u, more.get("status", 200), more.get("mime", "text/html"), None, u, None, None, None) for u in urls], INFO)


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    for n, m in ((30, 25), (60, 80), (50, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        parent = list(range(n))

        def top(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for a, b in edges:
            parent[max(top(a), top(b))] = min(top(a), top(b))
        got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
        assert got == {k: top(k) for k in range(n) if any(k in e and e[0] != e[1] for e in edges)}
    chain = [(k, k + 1) for k in range(70)]
    assert {r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    words = [rng.getrandbits(64) for _ in range(40)]
    for w in list(words):
        x = w
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        words.append(x)
    signed = [w - (1 << 64) if w >> 63 else w for w in words] + [0, 7, 63]
    df = spark.createDataFrame([(w,) for w in signed], "simhash long")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") < 4}
    assert {(r.a, r.b) for r in neardup.near_pairs(df).collect()} == want
    assert neardup.count_clusters(df.where("simhash in (0, 7, 63)")).first()[0] == 1
    assert neardup.count_clusters(df.limit(0)).first()[0] == 0


def test_threshold_and_degrees(spark):
    rows = [("text/html", d) for d in (1, 1, 1, 5, 9, 12)]
    assert graph.head_threshold(spark.createDataFrame(rows, "mime_type string, indegree long")).first()[0] == 9
    pages = info(spark, ["http://e.org/", "http://e.org/a"]).union(info(spark, ["http://e.org/gone"], status=404))
    links = spark.createDataFrame([("http://e.org/", "http://e.org/a", "L")] * 2 + [("http://e.org/a", "http://e.org/a", "L"), ("http://e.org/", "http://e.org/a", "I"), ("http://e.org/a", "http://e.org/gone", "L"), ("http://x/", "http://e.org/a", "L")], "src string, dst string, link_type string")
    v, e = graph.web_graph(links, pages)
    assert {(r.url, r.indegree) for r in graph.indegrees(v, e).collect()} == {("http://e.org/", 0), ("http://e.org/a", 3)}
    assert graph.select_root(v, "e.org").first()[0] == "http://e.org/"
    assert graph.web_graph(links, pages, "other.org")[1].count() == 0


def test_heads_and_sections(spark):
    base = "http://h.org"
    heads = spark.createDataFrame([(base + p, 1) for p in ("/news", "/news/a", "/sport/", "/sport/x")], "url string, indegree long")
    assert sorted(r.url for r in graph.top_heads(heads).collect()) == [base + p for p in ("/news", "/sport/", "/sport/x")]
    v = info(spark, [base + p for p in ("/s", "/s/a/b", "/s/a", "/t", "/u")])
    edges = spark.createDataFrame([(base + a, base + b, "I") for a, b in (("/s", "/s/a/b"), ("/s/a/b", "/s/a"), ("/s", "/u"), ("/t", "/u"), ("/s/a", "/s/a"))], "src string, dst string, link_type string")
    one = heads.limit(0).union(spark.createDataFrame([(base + "/s", 1), (base + "/t", 1)], "url string, indegree long"))
    got = {(r.section_head, r.url) for r in graph.sections_by_links(v, edges, one).collect()}
    assert got == {(base + "/s", base + "/s"), (base + "/s", base + "/s/a/b"), (base + "/t", base + "/t")}
    got = {(r.section_head, r.url) for r in graph.sections_by_links(v, edges, one, keep_url_suffixes=False).collect()}
    assert (base + "/t", base + "/u") in got and (base + "/s", base + "/u") in got and (base + "/s", base + "/s/a") in got
    got = {(r.section_head, r.url) for r in graph.sections_by_distance(v, edges, one).collect()}
    assert (base + "/s", base + "/u") in got and (base + "/t", base + "/u") not in got and len(got) == 5


def test_reports(spark):
    a = spark.createDataFrame([("u1", 200, "text/html", None, "m", 0, None, "s"), ("u2", 200, "text/html", None, "m", 7, None, "s"), ("u3", 200, "image/png", None, "k", None, None, None)], INFO)
    b = spark.createDataFrame([("u1", 200, "text/html", None, "m", 255, None, "s"), ("u2", 200, "text/html", None, "n", 7 | 511 << 20, None, "s")], INFO)
    assert {tuple(r) for r in reports.duplicate_histogram(a).collect()} == {("all", 2, 1), ("all", 1, 1), ("html", 2, 1), ("not_html", 1, 1), ("images", 1, 1)}
    found = reports.distances(a, b)
    assert [tuple(r) for r in found.collect()] == [("u1", 8), ("u2", 9)]
    assert reports.changed_share(found.withColumn("g", F.lit(1)), ("g",)).first().changed == 0.5
    row = reports.diversity(a).first()
    assert (row.uniq_html, row.uniq_not_html, row.n_html, row.n_not_html, row.n_all) == (1, 1, 2, 1, 3) and abs(row.diversity - 2 / 3) < 1e-6
    sizes = {r.capture: r for r in reports.size(a, b).collect()}
    assert sizes["AB"].n_rows == 5 and sizes["AB"].share == 1.0
    assert reports.diversity(a.limit(0)).first().diversity is None


def test_near_pairs_are_joined_without_a_broadcast(spark):
    words = spark.range(50).withColumnRenamed("id", "simhash")
    plan = neardup.near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_keyed_words_are_dealt_out_in_counted_slices(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ROWS", 100)
    plan = neardup.near_pairs(spark.range(50).withColumnRenamed("id", "simhash"))._jdf.queryExecution().executedPlan().toString()
    assert "11), REPARTITION_BY_NUM" in plan


def test_counted_slices_are_those_of_the_join_too(spark, monkeypatch):
    rng = random.Random(3)
    words = [rng.getrandbits(63) for _ in range(20)]
    rows = [(g, w ^ d) for g in ("s", "t") for w in words for d in (0, 1 << rng.randrange(63), 7)]
    df = spark.createDataFrame(rows, "section_head string, simhash long").coalesce(1)
    few = {tuple(r) for r in neardup.near_pairs(df, by=("section_head",)).collect()}
    monkeypatch.setattr(neardup, "ROWS", 300)
    pairs = neardup.near_pairs(df, by=("section_head",))
    slices = 1 + 20 * len(set(rows)) // 300
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(section_head" in line and f", {slices}), REPARTITION_BY_NUM" in line]
    assert len(dealt) == 2 and "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {tuple(r) for r in pairs.collect()} == few
    assert few == {(g, a, b, bin(a ^ b).count("1")) for g, a in rows for h, b in rows if g == h and a < b and bin(a ^ b).count("1") < 4}

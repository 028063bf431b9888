import gzip

from pyspark.sql import functions as F

from webgauge import cli
from webgauge.plans import extract
from webgauge.sources import hashlog, warc
from webgauge.streaming.extract import resources_stream


def record(kind, uri, content, date="2024-01-01T00:00:00Z"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{uri}#{kind}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\nContent-Type: application/http\r\nContent-Length: {len(content)}\r\n\r\n"
    return head.encode() + content + b"\r\n\r\n"


def page(status, body, extra=""):
    return f"HTTP/1.1 {status}\r\nContent-Type: text/html\r\n{extra}\r\n".encode() + body.encode()


WORDS = " ".join(f"word{k}" for k in range(40))
ARCHIVE = [
    record("warcinfo", "x", b"software: s"),
    record("response", "http://example.org/", page("200 OK", f"<html><title>t</title><body><p>{WORDS}</p></body></html>")),
    record("response", "http://example.org/a", page("301 Moved", "<html>moved</html>", "Location: /b/\r\n")),
    record("response", "http://example.org/broken", b"no blank line"),
    record("response", "http://example.org/i", b"HTTP/1.1 200 OK\r\n\r\n\x89PNG\r\n\x1a\n"),
    record("metadata", "http://example.org/", b"outlink: http://example.org/a L a/@href\r\noutlink: http://example.org/i E img/@src\r\nvia: x"),
]


def test_archive_to_log_and_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in ARCHIVE))
    records = warc.read_warc(spark, str(tmp_path / "in")).cache()
    assert records.count() == 6
    warc.register(spark)
    streamed = spark.read.format("warc").load(str(tmp_path / "in"))
    assert sorted(r.record_id for r in streamed.collect()) == sorted(r.record_id for r in records.collect())
    rows = {r.url: r for r in extract.resources(records).collect()}
    assert set(rows) == {"http://example.org/", "http://example.org/a", "http://example.org/i"}
    assert rows["http://example.org/a"].redir_location == "http://example.org/b" and rows["http://example.org/a"].status == 301
    assert rows["http://example.org/i"].mime_type == "image/png" and rows["http://example.org/i"].simhash is None
    assert rows["http://example.org/"].simhash not in (None, 0)
    counters = extract.run_counters(records).first()
    assert counters.n_records == 6 and counters.n_html == 2
    assert records.select(warc.timestamp().alias("t")).where("t is null").count() == 0
    assert cli.report(spark, "-hash", [str(tmp_path / "in"), str(tmp_path / "log")]) is None
    again = {r.url: r for r in cli.load(spark, str(tmp_path / "log")).collect()}
    assert again["http://example.org/"].simhash == rows["http://example.org/"].simhash
    links = sorted(tuple(r) for r in hashlog.parse_links(hashlog.read_lines(spark, str(tmp_path / "log"))).collect())
    assert links == [("http://example.org/", "http://example.org/a", "L"), ("http://example.org/", "http://example.org/i", "E")]
    assert cli.report(spark, "-redun", [str(tmp_path / "log")]).count() == 4
    stream = resources_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").outputMode("append").start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.table("seen").count() == 3


def test_bad_archives(spark, tmp_path):
    (tmp_path / "b.warc").write_bytes(b"junk\n" + ARCHIVE[1] + b"WARC/1.0\r\nContent-Length: -1\r\n\r\n" + ARCHIVE[2])
    (tmp_path / "c.warc").write_bytes(ARCHIVE[1][:-40])
    (tmp_path / "d.warc").write_bytes(b"")
    assert warc.read_warc(spark, str(tmp_path)).count() == 1


def test_log_rules(spark):
    tab = "\t"
    lines = [
        "http://e.org/x" + tab + "d1" + tab + "tika_mime_t:text/html" + tab + "md5:a" + tab + "status:200" + tab + "location:null" + tab + "simhash_v1_3:5" + tab + "simhash_v1_3_snacktory:null" + tab + "section:null",
        "http://e.org/x" + tab + "d2" + tab + "tika_mime_t:text/html" + tab + "md5:b" + tab + "status:404" + tab + "location:null",
        "http://e.org/y.JS" + tab + "d" + tab + "tika_mime_t:text/html" + tab + "md5:c" + tab + "status:null" + tab + "location:null",
        "http://e.org/z" + tab + "->" + tab + "x",
        "shutdownNow: x",
        "a -> b",
        "a -> b T more",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    rows = {r.url: r for r in hashlog.parse_resources(df).collect()}
    assert rows["http://e.org/x"].md5 == "b" and rows["http://e.org/x"].simhash is None and rows["http://e.org/y.JS"].status is None and len(rows) == 2
    rows = {r.url: r for r in hashlog.parse_resources(df, True, True).collect()}
    assert set(rows) == {"http://e.org/x"} and rows["http://e.org/x"].simhash == 5
    assert sorted(tuple(r) for r in hashlog.parse_links(df).collect()) == [("a", "b", "-"), ("a", "b", "T")]
    assert hashlog.parse_resources(df.where(F.lit(False))).count() == 0


def test_arguments():
    assert cli.main([]) == 2 and cli.main(["-dists", "a"]) == 2 and cli.main(["-nothing", "a"]) == 2


def test_all_commands(spark, tmp_path, capsys, monkeypatch):
    site = "http://example.org"
    words = [f"{WORDS} {k}" for k in range(6)]
    for name, n in (("a", 6), ("b", 5)):
        pages = [("/", words[0], "200 OK")] + [(f"/s{k}", words[k], "200 OK") for k in (1, 2)] + [(f"/s{k % 2 + 1}/p{k}", words[k], "200 OK") for k in range(3, n)] + [("/gone", "x", "404 Not Found")]
        crumbs = lambda p: f'<div class="breadcrumb"><a href="/">h</a><a href="/{p.split("/")[1]}">s</a></div>' if p.count("/") > 1 else ""
        records = [record("response", site + p, page(status, f"<html><body>{crumbs(p)}<p>{text}{' changed words here' * (name == 'b')}</p></body></html>")) for p, text, status in pages]
        out = {"/": ["/s1", "/s2"], "/s1": ["/s1/p4", "/"], "/s2": ["/s2/p3", "/s2/p5", "/s1"], "/s2/p3": ["/s1", "/s2"]}
        records += [record("metadata", site + p, "".join(f"outlink: {site}{d} L a/@href\r\n" for d in to).encode()) for p, to in out.items()]
        (tmp_path / f"{name}.warc").write_bytes(b"".join(records))
        assert cli.report(spark, "-hash", [str(tmp_path / f"{name}.warc"), str(tmp_path / name)]) is None
        assert f"n_html={len(pages)}" in capsys.readouterr().err
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    rows = lambda command, *args: [tuple(r) for r in cli.report(spark, command, list(args)).collect()]
    assert [r[0] for r in rows("-dists", a, b)] == [r[0] for r in rows("-distances", a, b)] and len(rows("-dists", a, b)) == 6
    assert rows("-redun", a) == rows("-redundancy", a) and ("all", 1, 7) in rows("-redun", a)
    assert rows("-diver", a) == rows("-diversity", a) and rows("-diver", a)[0][4] == 7
    assert {r[0]: r[1] for r in rows("-size", a, b)} == {"A": 7, "B": 6, "AB": 13}
    assert rows("-indegree", a)[0] == (f"{site}/s1", 3) and rows("-indegree", a) == rows("-indegree", a, "example.org")
    heads = {f"{site}/s1", f"{site}/s2"}
    assert {r[0] for r in rows("-graphSections", a, "example.org")} == heads
    assert set(rows("-graphSectionsUrl", a, "example.org")) == {(f"{site}/s1", f"{site}/s1"), (f"{site}/s2", f"{site}/s2"), (f"{site}/s1", f"{site}/s1/p4"), (f"{site}/s2", f"{site}/s2/p3"), (f"{site}/s2", f"{site}/s2/p5")}
    assert set(rows("-graphSectionsPart", a, "example.org")) >= {(f"{site}/s1", f"{site}/s1/p4"), (f"{site}/s2", f"{site}/s2/p3")}
    assert {r[1] for r in rows("-sectionsBc", a, "example.org")} == {f"{site}/s1/p4", f"{site}/s2/p3", f"{site}/s2/p5"}
    assert {r[0]: r[5] for r in rows("-secDiver", a, "example.org")} == {r[0]: r[5] for r in rows("-sectionDiversity", a, "example.org")} == {f"{site}/s1": 2, f"{site}/s2": 3}
    assert {r[0] for r in rows("-secDiverBc", a, "example.org")} == {r[0] for r in rows("-sectionDiversityBreadcrumb", a, "example.org")} == heads
    assert {r[0]: r[1] for r in rows("-secDists", a, b, "example.org")} == {r[0]: r[1] for r in rows("-sectionsDistances", a, b, "example.org")} == {f"{site}/s1": 2, f"{site}/s2": 2}
    assert {r[0]: r[1] for r in rows("-secDistsBc", a, b, "example.org")} == {r[0]: r[1] for r in rows("-sectionsDistancesBc", a, b, "example.org")} == {f"{site}/s1": 1, f"{site}/s2": 1}
    assert cli.main(["-redun", a]) == 0 and "all\t1\t7" in capsys.readouterr().out
    assert cli.main(["-redun", str(tmp_path / "none")]) == 1

    def full(*_):
        raise MemoryError

    monkeypatch.setattr(cli, "report", full)
    assert cli.main(["-redun", a]) == 3


def test_header_lines(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(ARCHIVE[1])
    found = warc.read_warc(spark, str(tmp_path)).select(warc.header_lines().alias("h"), warc.refers_to().alias("r"), warc.ip_address().alias("i"), warc.target_uri().alias("u")).first()
    lines = found.h.split("\r\n")
    assert lines[0] == "WARC-Type: response" and lines[2] == "WARC-Date: 2024-01-01T00:00:00Z" and lines[-1] == "WARC-Target-URI: http://example.org/" and len(lines) == 6
    assert (found.r, found.i, found.u) == (None, None, "http://example.org/")

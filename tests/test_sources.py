import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import url as u
from corpusloom.operators import rules
from corpusloom.sources import files, html

PAGE = """<html><head><title>A &amp; B</title><meta name="Keywords" content="x, y"><base href="http://h.test/d/"><link rel=canonical href="/c"></head>
<body><p>One<!--noindex--> hidden <!--/noindex--> two</p><script>no()</script><a href="e.html#f">Go <b>on</b></a><img src="/i.gif" alt="Pic"></body></html>"""


def test_html(spark):
    p = html.parse_page(PAGE)
    assert p["title"] == "A & B" and p["meta"]["keywords"] == "x, y" and p["canonical"] == "/c" and "hidden" not in p["body"] and "no()" not in p["body"]
    assert html.parse_page(None) is None and html.parse_page("")["body"] == "" and html.parse_page("<a <b")["title"] == ""
    robots = html.parse_page('<meta name="robots" content="NOINDEX, nofollow">')
    assert not robots["index"] and not robots["follow"] and robots["archive"]
    pages = spark.createDataFrame([(1, "http://h.test/x", PAGE), (2, "http://h.test/y", None)], "doc_id int, url string, html string")
    items, links = html.items_and_links(pages)
    assert {r.name for r in items.collect()} == {"title", "body", "meta.keywords"}
    assert {r.url for r in links.collect()} >= {"http://h.test/d/e.html", "http://h.test/i.gif"}


def test_content():
    data = b"some text " * 20
    assert files.decode_content(gzip.compress(data), "gzip") == data
    assert files.decode_content(zlib.compress(data), "deflate") == data and files.decode_content(zlib.compress(data)[2:-4], "deflate") == data
    assert files.decode_content(b"4\r\nsome\r\n3\r\n te\r\n0\r\n\r\n", "chunked") == b"some te"
    assert files.decode_content(b"broken", "gzip") is None and files.decode_content(None, None) is None
    assert files.parse_feed('<urlset xmlns="s"><url><loc>http://a/</loc><priority>0.5</priority></url></urlset>')[0]["loc"] == "http://a/"
    assert files.parse_feed("<rss><channel><item><title>T</title><link>http://b/</link></item></channel></rss>")[0]["title"] == "T"
    assert files.parse_feed("<broken") == [] and files.parse_feed(None) is None
    assert files.parse_xml_sections('<a x="1"><b>t</b><b>u</b></a>') == {"a.x": "1", "a.b": "t u"}
    v1 = b"\0" * 10 + b"TAG" + b"Song".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + b"\0" * 30 + b"1999" + b"\0" * 31
    assert files.media_tags(v1) == {"title": "Song", "artist": "Who", "year": "1999"}
    v2 = b"ID3\x03\0\0\0\0\0\x13TIT2\0\0\0\x05\0\0\0Tune"
    assert files.media_tags(v2)["title"] == "Tune"
    gif = b"GIF89a\1\0\1\0\0\0\0" + b"\x21\xfe\x05hello\0" + b"\x3b"
    assert files.media_tags(gif) == {"comment": "hello"} and files.media_tags(b"") == {} and files.media_tags(None) is None


def test_urls(spark):
    rows = spark.createDataFrame([(1, "http://WWW.Ab.co.uk:81/a/b/../c/./x.html?q=1#f"), (2, "https://h.test")], "i int, url string")
    r = rows.select("i", *[u.part(F.col("url"), p).alias(p) for p in ("host", "port", "path", "file")], u.site_key(F.col("url")).alias("site"), u.normal_path(u.part(F.col("url"), "path")).alias("n")).orderBy("i").collect()
    assert (r[0].host, r[0].port, r[0].file, r[0].site, r[0].n) == ("www.ab.co.uk", "81", "x.html", "ab.co.uk", "/a/c/x.html") and r[1].n == "/"
    from urllib.parse import urljoin

    base = "http://h.test/a/b/page.html"
    for link in ("x.html", "../y", "/z/", "//o.test/p", "http://q.test/r", "?k=v", "./", "../../../w", "mailto:a@b"):
        got = spark.range(1).select(u.resolve(F.lit(base), F.lit(link)).alias("x")).first().x
        assert got == urljoin(base, link), link


def test_rules(spark):
    df = spark.createDataFrame([("http://a.test/x.html",), ("10.1.2.3",), (None,)], "t string")
    hit = lambda kind, p: [r[0] for r in df.select(rules.match(F.col("t"), kind, p)).collect()]
    assert hit("wild", "http://*/?.html") == [True, False, None] and hit("subnet", "10.1.0.0/16")[1] is True and hit("subnet", "10.2.0.0/16")[1] is False
    assert hit("full", "10.1.2.3") == [False, True, None] and hit("regex", r"^\d") == [False, True, None]
    r = rules.parse_robots("User-agent: a\nUser-agent: *\nDisallow: /x/*.gif$\nAllow: /\nCrawl-delay: 5\nSitemap: http://s/\n# c\nbad")
    assert r["agents"]["*"] == [(False, "/x/*.gif$"), (True, "/")] and r["delay"]["a"] == 5 and r["sitemaps"] == ["http://s/"]
    pages = spark.createDataFrame([(1, "h", "/x/y.gif"), (2, "h", "/x/y.gif?z"), (3, "other", "/")], "id int, host string, path string")
    table = spark.createDataFrame([("h", i, a, rules.robots_regex(p)) for i, (a, p) in enumerate(r["agents"]["*"])], "host string, ordre int, allow boolean, pattern string")
    assert {x.id: x.allowed for x in rules.robots_allows(pages, table).collect()} == {1: False, 2: True, 3: True}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("http://x/\n# no\n\nhttp://y/\nhttp://x/\n")
    assert files.read_files(spark, str(tmp_path)).count() == 1
    assert {r.url for r in files.read_url_list(spark, str(tmp_path / "a.txt")).collect()} == {"http://x/", "http://y/"}
    with pytest.raises(ValueError):
        files.reader_of("gopher://x")

"""Reading of pages: markup, feeds, headers, codings, robots rules, segmentation; requests as a whole."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import url as u
from corpusloom.functions.segment import segmented
from corpusloom.operators import rules
from corpusloom.plans import request
from corpusloom.queries.common import POST, Registry, index
from corpusloom.sources import files, html, mail
from corpusloom.sources.tables import table

R = Registry()


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _plain(c):
    """Without control signs, white space as one blank: what markup can carry unchanged."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{Cc}\p{Zs}\p{Zl}\p{Zp}]+", " "), r" +", " "))


_P = r"trim(regexp_replace(coalesce({}, ''), '[\p{{Cc}}\p{{Zs}}\p{{Zl}}\p{{Zp}}]+', ' ', 'g'))"


def _pages(s, d):
    """A page in markup for each record, with its title, text, a hidden part, a link and a robots value."""
    r = table(s, d, "records").select("url_id", "url", "title", "excerpt").distinct().withColumn("k", F.xxhash64("title", "excerpt"))
    head = F.concat(F.lit("<html><head><title>"), _escaped(_plain(F.col("title"))), F.lit('</title><meta name="Robots" content="'), F.when(F.col("url_id") % 5 == 0, "noindex,nofollow").otherwise("all"), F.lit('"></head><body><p>'))
    body = F.concat(_escaped(_plain(F.col("excerpt"))), F.lit("<!--noindex-->hidden<!--/noindex--><script>var x=1</script></p><a href=\"../up/./x.html?q=1#top\">next</a></body></html>"))
    return r.select(F.col("url_id").alias("doc_id"), "url", F.concat(head, body).alias("html"))


R.add("p01_pages", lambda s, d: _pages(s, d).select("doc_id", html.parsed(F.col("html")).alias("p")).select("doc_id", "p.title", F.regexp_replace("p.body", "\n?next$", "").alias("body"), "p.index", "p.follow"),
      f"SELECT url_id AS doc_id, {_P.format('title')} AS title, {_P.format('excerpt')} AS body, url_id % 5 <> 0 AS index, url_id % 5 <> 0 AS follow FROM (SELECT DISTINCT url_id, url, title, excerpt FROM records)")
R.add("p02_links", lambda s, d: html.items_and_links(_pages(s, d))[1].select("doc_id", "text", "tag").distinct(), "SELECT DISTINCT url_id AS doc_id, 'next' AS text, 'a' AS tag FROM records WHERE url_id % 5 <> 0")
R.add("p03_items", lambda s, d: html.items_and_links(_pages(s, d))[0].filter("name = 'title'").select("doc_id", "text"), f"SELECT url_id AS doc_id, {_P.format('title')} AS text FROM (SELECT DISTINCT url_id, url, title, excerpt FROM records) WHERE url_id % 5 <> 0 AND {_P.format('title')} <> ''")


def _feed(s, d):
    x = table(s, d, "records").filter("title is not null").select("url_id", "url", "title").distinct()
    return x.select("url_id", F.concat(F.lit("<rss><channel><item><title>"), _escaped(_plain(F.col("title"))), F.lit("</title><link>"), _escaped(F.col("url")), F.lit("</link></item></channel></rss>")).alias("xml"))


R.add("p07_feeds", lambda s, d: _feed(s, d).select("url_id", F.explode(files.feed_entries("xml")).alias("e")).select("url_id", F.col("e.loc").alias("loc"), F.coalesce("e.title", F.lit("")).alias("title")),
      f"SELECT url_id, url AS loc, {_P.format('title')} AS title FROM (SELECT DISTINCT url_id, url, title FROM records WHERE title IS NOT NULL)")
R.add("src14_sitemap", lambda s, d: table(s, d, "url").select("rec_id", F.concat(F.lit('<urlset xmlns="http://s.test/0.9"><url><loc>'), _escaped(F.col("url")), F.lit("</loc><priority>"), F.round("pop_rank", 3).cast("string"), F.lit("</priority></url></urlset>")).alias("xml")).select("rec_id", F.explode(files.feed_entries("xml")).alias("e")).select("rec_id", F.col("e.loc").alias("loc")),
      "SELECT rec_id, url AS loc FROM url")
R.add("p06_headers", lambda s, d: table(s, d, "url").select("rec_id", mail.header_sections(F.concat(F.lit("HTTP/1.1 200 OK\r\nServer: s1\r\nX-Size: "), F.col("docsize").cast("string"), F.lit("\r\nX-Long: a\r\n b\r\n\r\nBody: no"))).alias("h")).select("rec_id", F.col("h")["header.x-size"].alias("size"), F.col("h")["header.x-long"].alias("long"), F.size("h").alias("n")),
      "SELECT rec_id, CAST(docsize AS VARCHAR) AS size, 'a b' AS long, 3 AS n FROM url")


def _zipped(texts):
    return texts.map(lambda t: None if t is None else gzip.compress(t.encode()))


def _coded(s, d):
    from pyspark.sql.types import BinaryType

    squeeze = F.pandas_udf(_zipped, BinaryType())
    rows = table(s, d, "documents").select("doc_id", "text")
    return rows.select("doc_id", files.decoded_content(squeeze("text"), F.lit("gzip")).cast("string").alias("t")).select("doc_id", F.md5(F.col("t").cast("binary")).alias("hash"))


R.add("p11_decoded", _coded, "SELECT doc_id, md5(text) AS hash FROM documents")
R.add("p14_body_brackets", lambda s, d: table(s, d, "documents").filter("text is not null").select("doc_id", F.md5(tx.between(F.concat(F.lit("head<!--b-->"), F.col("text"), F.lit("<!--/b-->foot")), "<!--b-->", "<!--/b-->").cast("binary")).alias("hash")), "SELECT doc_id, md5(text) AS hash FROM documents WHERE text IS NOT NULL AND text NOT LIKE '%<!--%b-->%'")
R.add("p13_query_sections", lambda s, d: html.query_section(table(s, d, "url").select(F.col("rec_id").alias("doc_id")), table(s, d, "records").groupBy("url_id").agg(F.max("rating").cast("string").alias("value")), "url_id", "rating"),
      "SELECT rec_id AS doc_id, 'rating' AS name, r.value AS text FROM url JOIN (SELECT url_id, CAST(max(rating) AS VARCHAR) AS value FROM records GROUP BY 1) r ON url_id = rec_id WHERE r.value IS NOT NULL")


def _robots(s, d):
    hosts = table(s, d, "url").select(u.part(F.col("url"), "host").alias("host")).distinct()
    texts = hosts.withColumn("text", F.lit("User-agent: *\nAllow: /*bridge\nDisallow: /20*/\nDisallow: /*.html$\n\nUser-agent: other\nDisallow: /\n"))
    pages = table(s, d, "url").select(F.col("rec_id").alias("id"), u.part(F.col("url"), "host").alias("host"), u.part(F.col("url"), "path").alias("path"))
    return rules.robots_allows(pages, rules.robots_table(texts, "loom")).select(F.col("id").alias("rec_id"), "allowed")


R.add("l26_robots", _robots,
      r"WITH p AS (SELECT rec_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM url) SELECT rec_id, regexp_matches(path, '^/.*bridge') OR NOT (regexp_matches(path, '^/20.*/') OR regexp_matches(path, '^/.*\.html$')) AS allowed FROM p")
WORDS = {"東京": 50, "京都": 40, "東": 5, "都": 9, "大学": 30}
R.add("t10_segments", lambda s, d: table(s, d, "servers").select("rec_id", F.when(F.col("rec_id") % 2 == 0, "東京都大学").otherwise("大学東京 news").alias("t")).select("rec_id", segmented(F.col("t"), WORDS).alias("words")),
      "SELECT rec_id, CASE WHEN rec_id % 2 = 0 THEN '東京 都 大学' ELSE '大学 東京 news' END AS words FROM servers")
R.add("t11_joined_again", lambda s, d: table(s, d, "servers").select("rec_id", tx.desegmented(F.lit("東京 都 大学 and news")).alias("t")), "SELECT rec_id, '東京都大学 and news' AS t FROM servers")
R.add("f05_escapes", lambda s, d: table(s, d, "records").select("url_id", "title").distinct().select("url_id", F.url_decode(F.url_encode("title")).alias("title"), F.get_json_object(F.to_json(F.struct("title")), "$.title").alias("json")),
      "SELECT DISTINCT url_id, title, title AS json FROM records")
R.add("f06_maps", lambda s, d: table(s, d, "servers").select("rec_id", F.map_concat(F.create_map(F.lit("tag"), F.col("tag")), F.create_map(F.lit("ordre"), F.col("ordre").cast("string"))).alias("m")).select("rec_id", F.col("m")["tag"].alias("tag"), F.col("m")["ordre"].alias("ordre"), F.size("m").alias("n")),
      "SELECT rec_id, tag, CAST(ordre AS VARCHAR) AS ordre, 2 AS n FROM servers")
R.add("q01_request", lambda s, d: request.search(request.parse_request("q=bridge&m=all&ps=20&np=1&s=up&ul=http%3A%2F%2F&status=200&status=304&wf=F1"), index(s, d), table(s, d, "url"), table(s, d, "urlinfo")).select("doc_id", "place"),
      f"WITH {POST}, h AS (SELECT DISTINCT doc_id FROM post WHERE word = 'bridge' AND doc_id IN (SELECT rec_id FROM url WHERE starts_with(url, 'http://') AND status IN (200, 304))), n AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS place, count(*) OVER () AS n FROM h) SELECT doc_id, place FROM n WHERE place > least(20, n - 1) AND place <= 40")

QUERIES, SQL = R.queries, R.sql

"""HTML pages to sections and links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("body", T.StringType()), T.StructField("base", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("refresh", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType()), T.StructField("tag", T.StringType())]))),
    T.StructField("index", T.BooleanType()), T.StructField("follow", T.BooleanType()), T.StructField("archive", T.BooleanType()),
])
_LINKS = {"a": "href", "area": "href", "frame": "src", "iframe": "src", "img": "src", "link": "href", "script": "src"}
_BLOCKS = {"p", "br", "div", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "pre", "hr"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.body, self.links, self.meta = [], [], [], {}
        self.base = self.canonical = self.refresh = None
        self.index = self.follow = self.archive = True
        self.hidden, self.in_title, self.off, self.anchor = 0, False, False, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style", "noindex"):
            self.hidden += 1
        if tag == "title":
            self.in_title = True
        if tag in _BLOCKS:
            self.body.append("\n")
        if tag == "base":
            self.base = a.get("href") or None
        if tag == "link" and a.get("rel", "").lower() == "canonical":
            self.canonical = a.get("href")
        if tag == "meta":
            self._meta(a)
        where = _LINKS.get(tag)
        if where and a.get(where):
            self.links.append([a[where], a.get("alt") or a.get("title") or "", tag])
            if tag == "a":
                self.anchor = self.links[-1]

    def _meta(self, a):
        name, value = (a.get("name") or a.get("http-equiv") or a.get("property") or "").lower(), a.get("content", "")
        if not name:
            return
        self.meta[name] = value
        if name == "robots":
            words = {w.strip() for w in value.lower().split(",")}
            none = "none" in words
            self.index = not (none or "noindex" in words)
            self.follow = not (none or "nofollow" in words)
            self.archive = not (none or "noarchive" in words)
        if name == "refresh" and "url=" in value.lower():
            self.refresh = value[value.lower().index("url=") + 4 :].strip("'\" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noindex"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "title":
            self.in_title = False
        if tag == "a":
            self.anchor = None
        if tag in _BLOCKS:
            self.body.append("\n")

    def handle_comment(self, data):
        word = data.strip()
        if word in ("noindex", "/noindex"):
            self.off = word == "noindex"

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden and not self.off:
            self.body.append(data)
            if self.anchor is not None:
                self.anchor[1] = (self.anchor[1] + data)[:4096]


def parse_page(html: str | None) -> dict | None:
    """Title, text, base, canonical address, refresh, meta values, links, and what robots may do. Null for null; broken markup gives what can be read."""
    if html is None:
        return None
    r = _Reader()
    try:
        r.feed(html)
        r.close()
    except Exception:  # noqa: BLE001 - malformed input ends the page, not the job
        pass
    clean = lambda parts: "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)
    return {
        "title": clean(r.title), "body": clean(r.body), "base": r.base, "canonical": r.canonical, "refresh": r.refresh, "meta": r.meta,
        "links": [{"href": h, "text": " ".join(t.split()), "tag": g} for h, t, g in r.links], "index": r.index, "follow": r.follow, "archive": r.archive,
    }


def parsed(html: Column) -> Column:
    """parse_page as a column of PAGE."""

    @F.pandas_udf(PAGE)
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in pages:
            rows = [parse_page(x) or {f.name: None for f in PAGE} for x in s]
            yield pd.DataFrame(rows, columns=[f.name for f in PAGE])

    return run(html)


def items_and_links(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pages (doc_id, url, html): items (doc_id, name, text) of indexable pages, and links (doc_id, url) of pages that may be followed, resolved."""
    from corpusloom.functions.url import resolve

    p = pages.select("doc_id", "url", parsed(F.col("html")).alias("p"))
    named = F.concat(F.array(F.struct(F.lit("title").alias("name"), F.col("p.title").alias("text")), F.struct(F.lit("body").alias("name"), F.col("p.body").alias("text"))), F.transform(F.map_entries("p.meta"), lambda e: F.struct(F.concat(F.lit("meta."), e["key"]).alias("name"), e["value"].alias("text"))))
    items = p.filter("p.index").select("doc_id", F.explode(named).alias("i")).select("doc_id", "i.name", "i.text").filter("text <> ''")
    links = p.filter("p.follow").select("doc_id", F.coalesce("p.base", "url").alias("base"), F.explode("p.links").alias("l")).filter(~F.lower("l.href").rlike("^(mailto|javascript|data):"))
    return items, links.select("doc_id", resolve(F.col("base"), F.col("l.href")).alias("url"), F.col("l.text").alias("text"), F.col("l.tag").alias("tag"))


def query_section(pages: DataFrame, rows: DataFrame, key: str, name: str, value: str = "value") -> DataFrame:
    """Items (doc_id, name, text) whose text comes from the rows of a query, looked up by page."""
    own = rows.select(F.col(key).alias("doc_id"), F.col(value).cast("string").alias("text")).filter("text is not null")
    return pages.select("doc_id").join(own, "doc_id").select("doc_id", F.lit(name).alias("name"), "text")

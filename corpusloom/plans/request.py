"""Search requests as query strings, and the whole search: words, limits, scores, order, page."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import PAGE_SIZE
from corpusloom.operators import limits, results, scoring
from corpusloom.plans import query as ql

_MATCH = {"wrd": "full", "full": "full", "beg": "beg", "end": "end", "sub": "sub"}


@dataclass
class SearchRequest:
    """words q; mode m; match wm; page and size; sort pattern s; weights wf; group by site; limits by name (values are alternatives)."""

    words: str = ""
    mode: str = "all"
    match: str = "full"
    page: int = 1
    size: int = PAGE_SIZE
    sort: str = "RP"
    weights: str = ""
    by_site: bool = False
    empty: bool = False
    limits: dict[str, list[str]] = field(default_factory=dict)


def parse_request(text: str) -> SearchRequest:
    """The request of a query string: p counts pages from 1, np from 0; unknown modes and matches are the default ones; empty values do not count."""
    r = SearchRequest()
    for key, value in parse_qsl(text, keep_blank_values=True):
        whole = int(value) if value.strip().isdigit() else None
        if key == "q":
            r.words = value
        elif key == "m":
            r.mode = value if value in ql.MODES else "all"
        elif key == "wm":
            r.match = _MATCH.get(value, "full")
        elif key == "s" and value:
            r.sort = value
        elif key == "wf":
            r.weights = value
        elif key == "p" and whole:
            r.page = whole
        elif key == "np" and whole is not None:
            r.page = whole + 1
        elif key == "ps" and whole:
            r.size = whole
        elif key == "GroupBySite":
            r.by_site = value == "yes"
        elif key == "empty":
            r.empty = value == "yes"
        elif key in ("site", "status", "ul", "u", "ue", "lang", "g", "t", "tag", "type", "maxhop") and value:
            r.limits.setdefault({"g": "lang", "t": "tag"}.get(key, key), []).append(value)
    return r


def limited(url: DataFrame, urlinfo: DataFrame, given: dict[str, list[str]]) -> DataFrame:
    """(doc_id) of the pages that all limits let in."""
    tests = {
        "site": lambda v: F.col("site_id").isin([int(x) for x in v if x.isdigit()]), "status": lambda v: F.col("status").isin([int(x) for x in v if x.isdigit()]), "ul": lambda v: limits.url_limit(F.col("url"), v),
        "u": lambda v: F.col("url").like(v[0]), "ue": lambda v: F.col("url").isin(v), "maxhop": lambda v: F.col("hops") <= int(v[0]),
    }
    pages = url
    for name, values in given.items():
        if name in tests:
            pages = pages.filter(tests[name](values))
    sections = {"lang": "content-language", "tag": "tag", "type": "content-type"}
    return limits.restrict(pages.select(F.col("rec_id").alias("doc_id")), *[limits.by_section(urlinfo, sections[n], v) for n, v in given.items() if n in sections])


def search(request: SearchRequest, post: DataFrame, url: DataFrame, urlinfo: DataFrame, sections: dict[str, int] | None = None) -> DataFrame:
    """The rows of the page asked for (doc_id, score, place, url, ...). Without words the limits alone are the result if `empty` asks for it."""
    tree = ql.Parser(request.mode, request.match, sections).parse(request.words)
    post = limits.weighted(post, request.weights) if request.weights else post
    if tree is None:
        scored = limited(url, urlinfo, request.limits).withColumn("score", F.lit(0).cast("bigint"))
        scored = scored if request.empty else scored.limit(0)
    else:
        words = list(dict.fromkeys(w.text for w in ql.leaves(tree)))
        found = ql.evaluate(tree, post, url.select(F.col("rec_id").alias("doc_id")))
        if request.limits:
            found = limits.restrict(found, limited(url, urlinfo, request.limits))
        scores = scoring.full(scoring.hits(post, [(w, i, "query") for i, w in enumerate(words)]), len(words))
        scored = found.join(scores.select("doc_id", "score"), "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("bigint")))
    rows = scored.join(url.select(F.col("rec_id").alias("doc_id"), "site_id", "pop_rank", "last_mod_time", "url"), "doc_id")
    if request.by_site:
        rows = results.group_by_site(rows, request.sort)
    return results.page(rows, request.page, request.size, request.sort)

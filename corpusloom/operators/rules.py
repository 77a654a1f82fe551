"""Rules over URLs: matching, filters in order, servers, robots."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.names import plain_name
from corpusloom.functions.url import part
from corpusloom.session import broadcast_if_small

#: Rules that a session may hold as expressions.
MAX_RULES = 10_000


def wildcard_regex(pattern: str) -> str:
    """A pattern with * (any run), ? (one sign), backslash as escape and $ at the end, as an anchored regular expression."""
    out, i = [], 0
    end = pattern.endswith("$") and not pattern.endswith("\\$")
    body = pattern[:-1] if end else pattern
    while i < len(body):
        ch = body[i]
        if ch == "\\" and i + 1 < len(body):
            i += 1
            out.append(re.escape(body[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(ch) or re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def ipv4(text: Column) -> Column:
    """The number of an IPv4 address; null for other texts."""
    p = F.split(text, r"\.")
    n = [F.try_element_at(p, F.lit(i + 1)).try_cast("bigint") for i in range(4)]
    return F.when((F.size(p) == 4) & reduce(lambda a, b: a & b, [x.between(0, 255) for x in n]), n[0] * 16777216 + n[1] * 65536 + n[2] * 256 + n[3])


def match(col: Column, kind: str, pattern: str, nocase: bool = False) -> Column:
    """Whether a text matches: full, begin, substr, end, regex, wild or subnet (a.b.c.d/bits)."""
    if kind == "subnet":
        net, _, bits = pattern.partition("/")
        a = net.split(".")
        number = sum(int(x) << (24 - 8 * i) for i, x in enumerate(a))
        size = 1 << (32 - int(bits or 32))
        return F.floor(ipv4(col) / size) == number // size
    text, p = (F.lower(col), pattern.lower()) if nocase and kind not in ("regex", "wild") else (col, pattern)
    flag = "(?i)" if nocase else ""
    return {
        "full": lambda: text == p, "begin": lambda: text.startswith(p), "substr": lambda: text.contains(p), "end": lambda: text.endswith(p),
        "regex": lambda: text.rlike(flag + p), "wild": lambda: text.rlike(flag + wildcard_regex(p)),
    }[kind]()


def first_method(col: Column, rules: list[tuple[str, str, str]], default: str = "allow") -> Column:
    """The method of the first rule (method, kind, pattern) that matches, in their order."""
    if len(rules) > MAX_RULES:
        raise ValueError("too many rules")
    out = F.lit(default)
    for method, kind, pattern in reversed(rules):
        out = F.when(match(col, kind, pattern), method).otherwise(out)
    return out


def filtered_method(col: Column, given: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The method of a URL that comes with a method of its server: disallow stays; checkonly and hrefonly are not raised to allow; skip yields to disallow only."""
    found = first_method(col, rules, "")
    kept = (given == "disallow") | (found == "") | given.isin("checkonly", "hrefonly") & (found == "allow") | (given == "skip") & (found != "disallow")
    return F.when(kept, given).otherwise(found)


def first_section_rule(urlinfo: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(doc_id, method, rule): of rules (method, section, kind, pattern) the first that a section value of the page matches. One pass, one row a page."""
    if len(rules) > MAX_RULES:
        raise ValueError("too many rules")
    name, at = plain_name(F.col("sname")), F.lit(None).cast("int")
    for i, (_, section, kind, pattern) in reversed(list(enumerate(rules))):
        at = F.when((name == section) & match(F.col("sval"), kind, pattern), i).otherwise(at)
    methods = F.array(*[F.lit(m) for m, *_ in rules])
    hit = urlinfo.select(F.col("url_id").alias("doc_id"), at.alias("rule")).filter("rule is not null").groupBy("doc_id").agg(F.min("rule").alias("rule"))
    return hit.select("doc_id", F.element_at(methods, F.col("rule") + 1).alias("method"), "rule")


def indexed_pages(pages: DataFrame, urlinfo: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """pages (doc_id, ...) with indexed: whether the first of the rules indexif and noindexif that holds lets them in; without one they are."""
    hit = first_section_rule(urlinfo, rules).select("doc_id", "method")
    return pages.join(hit, "doc_id", "left").withColumn("indexed", F.coalesce(F.col("method") != "noindexif", F.lit(True))).drop("method")


def sub_section(urlinfo: DataFrame, section: str, rules: list[tuple[str, str, str, str]], loose: bool = False) -> DataFrame:
    """(doc_id, value): the tag or category that rules (value, section, kind, pattern) give a page; loose: only where it has none of its own."""
    hit = first_section_rule(urlinfo, rules).select("doc_id", F.col("method").alias("value"))
    if not loose:
        return hit
    own = urlinfo.filter((plain_name(F.col("sname")) == section) & (F.col("sval") != "")).select(F.col("url_id").alias("doc_id")).distinct()
    return hit.join(own, "doc_id", "left_anti")


def server_by_rules(col: Column, rules: list[tuple[int, int, str, str]]) -> Column:
    """The id of the first server (order, id, kind, pattern) in order that matches, whatever its kind: begin, wild, regex or subnet."""
    out = F.lit(None).cast("int")
    for _, number, kind, pattern in sorted(rules, reverse=True):
        out = F.when(match(col, kind, pattern), number).otherwise(out)
    return out


def alias(col: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The address a page is read from: of rules (kind, pattern, to) the first that matches; begin puts `to` for the prefix, regex a template with $1..$9. Null without one."""
    out = F.lit(None).cast("string")
    for kind, pattern, to in reversed(rules):
        new = F.concat(F.lit(to), F.substring(col, F.lit(len(pattern) + 1), F.length(col))) if kind == "begin" else captures(col, pattern, to)
        out = F.when(match(col, kind, pattern), new).otherwise(out)
    return out


def reverse_alias(col: Column, rules: list[tuple[str, str]]) -> Column:
    """The address shown for one that was read: the first prefix (to) of rules (pattern, to) put back; others stay."""
    out = col
    for pattern, to in reversed(rules):
        out = F.when(col.startswith(to), F.concat(F.lit(pattern), F.substring(col, F.lit(len(to) + 1), F.length(col)))).otherwise(out)
    return out


def captures(col: Column, pattern: str, template: str) -> Column:
    """The template with $0..$9 as groups of the pattern; null where it does not match."""
    parts = re.split(r"(\$\d)", template)
    cols = [F.regexp_extract(col, pattern, int(x[1])) if re.fullmatch(r"\$\d", x) else F.lit(x) for x in parts if x]
    return F.when(col.rlike(pattern), F.concat(*cols))


def server_of(urls: DataFrame, servers: DataFrame, url: str = "url") -> DataFrame:
    """urls with server_id: the enabled server whose URL begins the page's URL, with the lowest order (then id).

    A server's URL has scheme and host, so the join is on these, not over all pairs.
    """
    key = lambda c: F.concat(part(c, "scheme"), F.lit("://"), part(c, "host"))
    rules = broadcast_if_small(servers.filter("enabled = 1").select(F.col("rec_id").alias("server_rec"), F.col("url").alias("prefix"), F.col("ordre"), key(F.col("url")).alias("site")))
    pages = urls.withColumn("site", key(F.col(url)))
    found = pages.join(rules, "site").filter(F.col(url).startswith(F.col("prefix")))
    first = found.groupBy(F.col(url).alias("u")).agg(F.min(F.struct("ordre", "server_rec")).alias("s")).select("u", F.col("s.server_rec").alias("found_server"))
    return urls.join(first, urls[url] == first["u"], "left").drop("u")


def parse_robots(text: str) -> dict:
    """{agents: {agent: [(allow, pattern)]}, delay: {agent: seconds}, sitemaps: [...]} of a robots.txt."""
    out: dict = {"agents": {}, "delay": {}, "sitemaps": []}
    current: list[str] = []
    naming = False
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        key, sep, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            current = [*current, value.lower()] if naming else [value.lower()]
            naming = True
            for a in current:
                out["agents"].setdefault(a, [])
            continue
        naming = False
        if key in ("allow", "disallow"):
            for a in current:
                if value:
                    out["agents"][a].append((key == "allow", value))
        elif key == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
            for a in current:
                out["delay"][a] = float(value)
        elif key == "sitemap":
            out["sitemaps"].append(value)
    return out


def robots_regex(pattern: str) -> str:
    """A robots pattern (prefix, with * and $) as a regular expression."""
    end = pattern.endswith("$")
    return "^" + ".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*"))) + ("$" if end else "")


def robots_allows(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (id, host, path) with allowed: the first rule (host, ordre, allow, pattern as regex) of the host that matches decides."""
    hit = pages.join(rules, "host").filter(F.expr("path rlike pattern"))
    first = hit.groupBy("id").agg(F.min(F.struct("ordre", "allow")).alias("r")).select("id", F.col("r.allow").alias("a"))
    return pages.join(first, "id", "left").withColumn("allowed", F.coalesce("a", F.lit(True))).drop("a")


def robots_table(pages: DataFrame, agent: str = "*") -> DataFrame:
    """(host, ordre, allow, pattern as regex) of robots.txt texts (host, text): the rules for the agent, else those for all."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for host, text in zip(b["host"], b["text"]):
                by = parse_robots(text or "")["agents"]
                own = next((by[a] for a in by if a != "*" and a in agent.lower()), by.get("*", []))
                rows += [(host, i, allow, robots_regex(p)) for i, (allow, p) in enumerate(own)]
            yield pd.DataFrame(rows, columns=["host", "ordre", "allow", "pattern"])

    return pages.select("host", "text").mapInPandas(run, "host string, ordre int, allow boolean, pattern string")


def newest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest row of each key (ties by all other columns)."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max(F.struct(F.col(version), *[F.col(c) for c in others if c != version])).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}").alias(c) for c in others]).select(*rows.columns)


def prefix_paths(path: Column, step: int = 2) -> Column:
    """All prefixes of a category path in steps, the path itself last."""
    n = F.floor(F.length(path) / step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(path, F.lit(1), k * step))).otherwise(F.array().cast("array<string>"))


def window_first(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")

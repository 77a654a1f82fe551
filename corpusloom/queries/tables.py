"""Limits, results, popularity, upkeep and URL functions over the crawl tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import url as u
from corpusloom.functions.names import plain_name
from corpusloom.operators import limits, maintenance, popularity, postings, results, rules
from corpusloom.queries.common import PLAIN, POST, Registry, index, items
from corpusloom.session import stored
from corpusloom.sources import files
from corpusloom.sources.tables import table

R = Registry()
NOW = 1_400_000_000


def _url(s, d):
    return table(s, d, "url")


def _limit(name: str, condition, where: str) -> None:
    R.add(name, lambda s, d: _url(s, d).filter(condition()).select("rec_id"), f"SELECT rec_id FROM url WHERE {where}")


# --- limits ---------------------------------------------------------------------------------------

_limit("l03_status", lambda: F.col("status").isin(200, 304), "status IN (200, 304)")
_limit("l04_site", lambda: F.col("site_id").isin(1, 2, 5), "site_id IN (1, 2, 5)")
_limit("l07_url_prefix", lambda: limits.url_limit(F.col("url"), ["http://jorhellosil.test/", "harbour"]), "starts_with(url, 'http://jorhellosil.test/') OR contains(url, 'harbour')")
_limit("l08_url_like", lambda: limits.like_or_equal(F.col("url"), ["%/2016/%", "http://jorhellosil.test/"]), "url LIKE '%/2016/%' OR url = 'http://jorhellosil.test/'")
_limit("l09_hops", lambda: F.col("hops") <= 2, "hops <= 2")
_limit("l10_back", lambda: limits.changed_since(F.col("last_mod_time"), NOW, 86400 * 365), f"last_mod_time >= {NOW} - 86400 * 365")
_limit("l11_before", lambda: (F.col("last_mod_time") <= NOW) & (F.col("last_mod_time") > 0), f"last_mod_time <= {NOW} AND last_mod_time > 0")
_limit("l12_days", lambda: limits.changed_between(F.col("last_mod_time"), "2008-01-01", "2010-12-31"), "last_mod_time >= epoch(TIMESTAMP '2008-01-01') AND last_mod_time < epoch(TIMESTAMP '2011-01-01')")
_limit("l16_hour", lambda: limits.time_bucket(F.col("last_mod_time"), 3600).between(1200000000 // 3600 * 3600, 1300000000), "last_mod_time // 3600 * 3600 BETWEEN 1200000000 // 3600 * 3600 AND 1300000000")
_limit("l24_match_kinds", lambda: rules.match(F.col("url"), "begin", "https://") & rules.match(F.col("url"), "end", ".html") | rules.match(F.col("url"), "substr", "museum") | rules.match(F.col("url"), "regex", r"/20\d\d/.*-small/?$"),
       r"(starts_with(url, 'https://') AND ends_with(url, '.html')) OR contains(url, 'museum') OR regexp_matches(url, '/20\d\d/.*-small/?$')")
_limit("l25_wildcards", lambda: rules.match(F.col("url"), "wild", "http://*/20??/*bridge*"), "regexp_full_match(url, 'http://.*/20../.*bridge.*')")


def _section(name: str, section: str, values: list[str], where: str) -> None:
    R.add(name, lambda s, d: limits.by_section(table(s, d, "urlinfo"), section, values), f"SELECT DISTINCT url_id AS doc_id FROM urlinfo u WHERE {PLAIN} = '{section}' AND ({where})")


_section("l02_language", "content-language", ["de", "fr%"], "sval = 'de' OR sval LIKE 'fr%'")
_section("l05_tag", "tag", ["wes", "b%"], "sval = 'wes' OR sval LIKE 'b%'")
_section("l06_type", "content-type", ["text/html%"], "sval LIKE 'text/html%'")
_section("l01_category", "category", ["1%"], "sval LIKE '1%'")


def _restricted(s, d):
    hits = index(s, d).filter("word = 'bridge'").select("doc_id").distinct()
    ok = _url(s, d).filter("status = 200 and hops <= 4").select(F.col("rec_id").alias("doc_id"))
    return limits.restrict(hits, ok, limits.by_section(table(s, d, "urlinfo"), "content-type", ["text/html%"]))


R.add("l17_limited_search", _restricted,
      f"WITH {POST} SELECT DISTINCT doc_id FROM post WHERE word = 'bridge' AND doc_id IN (SELECT rec_id FROM url WHERE status = 200 AND hops <= 4) AND doc_id IN (SELECT url_id FROM urlinfo u WHERE {PLAIN} = 'content-type' AND sval LIKE 'text/html%')")
R.add("l13_section_weights", lambda s, d: limits.weighted(index(s, d), "F0F1").groupBy("doc_id").agg(F.count("*").alias("hits")),
      f"WITH {POST} SELECT doc_id, count(*) AS hits FROM post WHERE section <> 3 GROUP BY 1")
R.add("l18_limits_only", lambda s, d: limits.restrict(_url(s, d).filter("status = 200").select(F.col("rec_id").alias("doc_id")), limits.by_section(table(s, d, "urlinfo"), "tag", ["wes"])),
      f"SELECT rec_id AS doc_id FROM url WHERE status = 200 AND rec_id IN (SELECT url_id FROM urlinfo u WHERE {PLAIN} = 'tag' AND sval = 'wes')")
R.add("l19_by_host", lambda s, d: _url(s, d).groupBy(u.site_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages")),
      "SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host, count(*) AS pages FROM url GROUP BY 1")
_FILTER = [("disallow", "regex", r"\?"), ("hrefonly", "wild", "*/2010/*"), ("checkonly", "end", "/"), ("disallow", "substr", "harbour")]
R.add("l20_filters", lambda s, d: _url(s, d).select("rec_id", rules.first_method(F.col("url"), _FILTER).alias("method")),
      "SELECT rec_id, CASE WHEN contains(url, '?') THEN 'disallow' WHEN contains(url, '/2010/') THEN 'hrefonly' WHEN ends_with(url, '/') THEN 'checkonly' WHEN contains(url, 'harbour') THEN 'disallow' ELSE 'allow' END AS method FROM url")
R.add("l27_server", lambda s, d: rules.server_of(_url(s, d).select("rec_id", "url"), table(s, d, "servers")).select("rec_id", "found_server"),
      "SELECT rec_id, (SELECT s.rec_id FROM servers s WHERE s.enabled = 1 AND starts_with(u.url, s.url) ORDER BY ordre, s.rec_id LIMIT 1) AS found_server FROM (SELECT DISTINCT rec_id, url FROM url) u")
_METHOD = "CASE WHEN contains(url, '?') THEN 'disallow' WHEN contains(url, '/2010/') THEN 'hrefonly' WHEN ends_with(url, '/') THEN 'checkonly' WHEN starts_with(url, 'http:') THEN 'allow' ELSE '' END"
_GIVEN = "CASE hops % 5 WHEN 0 THEN 'allow' WHEN 1 THEN 'disallow' WHEN 2 THEN 'checkonly' WHEN 3 THEN 'hrefonly' ELSE 'skip' END"
R.add("l20_precedence", lambda s, d: _url(s, d).select("rec_id", rules.filtered_method(F.col("url"), F.expr("element_at(array('allow', 'disallow', 'checkonly', 'hrefonly', 'skip'), cast(hops % 5 as int) + 1)"), [*_FILTER[:3], ("allow", "begin", "http:")]).alias("method")),
      f"WITH m AS (SELECT rec_id, {_GIVEN} AS g, {_METHOD} AS m FROM url) SELECT rec_id, CASE WHEN g = 'disallow' OR m = '' OR (g IN ('checkonly', 'hrefonly') AND m = 'allow') OR (g = 'skip' AND m <> 'disallow') THEN g ELSE m END AS method FROM m")
_INDEX_IF = [("indexif", "tag", "full", "wes"), ("noindexif", "content-type", "begin", "application/"), ("noindexif", "title", "regex", "(?i)archive"), ("noindexif", "content-language", "begin", "ru")]
_FIRST = f"""WITH h AS (SELECT url_id, CASE WHEN {PLAIN} = 'tag' AND sval = 'wes' THEN 0 WHEN {PLAIN} = 'content-type' AND starts_with(sval, 'application/') THEN 1
  WHEN {PLAIN} = 'title' AND regexp_matches(sval, '(?i)archive') THEN 2 WHEN {PLAIN} = 'content-language' AND starts_with(sval, 'ru') THEN 3 END AS r FROM urlinfo u), f AS (SELECT url_id, min(r) AS r FROM h WHERE r IS NOT NULL GROUP BY 1)"""
R.add("l21_index_if", lambda s, d: rules.indexed_pages(_url(s, d).select(F.col("rec_id").alias("doc_id")), table(s, d, "urlinfo"), _INDEX_IF), f"{_FIRST} SELECT rec_id AS doc_id, coalesce(r = 0, true) AS indexed FROM url LEFT JOIN f ON url_id = rec_id")
R.add("l22_store_filters", lambda s, d: rules.first_section_rule(table(s, d, "urlinfo"), [("store" if m == "indexif" else "nostore", *x) for m, *x in _INDEX_IF]).select("doc_id", "method"), f"{_FIRST} SELECT url_id AS doc_id, CASE WHEN r = 0 THEN 'store' ELSE 'nostore' END AS method FROM f")
R.add("l23_tag_if", lambda s, d: rules.sub_section(table(s, d, "urlinfo"), "tag", [("W", "tag", "full", "wes"), ("app", "content-type", "begin", "application/"), ("arch", "title", "regex", "(?i)archive"), ("rus", "content-language", "begin", "ru")], loose=True),
      f"{_FIRST} SELECT url_id AS doc_id, CASE r WHEN 0 THEN 'W' WHEN 1 THEN 'app' WHEN 2 THEN 'arch' ELSE 'rus' END AS value FROM f WHERE url_id NOT IN (SELECT url_id FROM urlinfo u WHERE {PLAIN} = 'tag' AND sval <> '')")
R.add("l27_server_kinds", lambda s, d: _url(s, d).select("rec_id", rules.server_by_rules(F.col("url"), [(3, 7, "begin", "http://"), (1, 5, "regex", r"/20\d\d/"), (2, 6, "wild", "https://*harbour*"), (4, 8, "subnet", "10.0.0.0/8")]).alias("server")),
      r"SELECT rec_id, CAST(CASE WHEN regexp_matches(url, '/20\d\d/') THEN 5 WHEN regexp_matches(url, '^https://.*harbour') THEN 6 WHEN starts_with(url, 'http://') THEN 7 END AS INT) AS server FROM url")


def _labelled(s, d):
    parts = [(name, _scored(s, d).filter(c).select("doc_id", "score")) for name, c in (("news", "doc_id <= 300"), ("old", "doc_id > 300 and doc_id <= 600"), ("news", "doc_id > 600"))]
    return results.merge_shards(*results.of_label(parts, "news"))




def _tree(s, d):
    return table(s, d, "nation").select((F.col("n_nationkey") * 20).alias("rec_id"), F.upper(F.concat(F.lpad(F.hex(F.col("n_regionkey").cast("bigint")), 2, "0"), F.lpad(F.hex(F.col("n_nationkey").cast("bigint")), 2, "0"))).alias("path"))


R.add("l14_category_tree", lambda s, d: limits.by_category(table(s, d, "urlinfo"), _tree(s, d), "02"),
      f"SELECT DISTINCT url_id AS doc_id FROM urlinfo u WHERE {PLAIN} = 'category' AND try_cast(sval AS BIGINT) IN (SELECT n_nationkey * 20 FROM nation WHERE n_regionkey = 2)")
_KEYS = {"hex8str": "lower(rpad(tag_, 16, '0'))", "int": "CAST(rec_id AS BIGINT)", "hour": "last_mod_time // 3600", "minute": "last_mod_time // 60"}
R.add("l19_limit_keys", lambda s, d: _url(s, d).select("rec_id", limits.limit_key(F.hex(F.col("hops").cast("bigint")), "hex8str").alias("hex8str"), *[limits.limit_key(F.col(c), k).alias(k) for k, c in (("int", "rec_id"), ("hour", "last_mod_time"), ("minute", "last_mod_time"))]),
      "SELECT rec_id, rpad(lower(hex(hops)), 16, '0') AS hex8str, CAST(rec_id AS BIGINT) AS int, last_mod_time // 3600 AS hour, last_mod_time // 60 AS minute FROM url")

# --- results --------------------------------------------------------------------------------------

_RANKED = f"""WITH {POST}, r AS (SELECT p.doc_id, count(*) AS score, any_value(u.site_id) AS site_id, any_value(u.pop_rank) AS pop_rank, any_value(u.last_mod_time) AS last_mod_time, any_value(u.url) AS url FROM post p JOIN url u ON u.rec_id = p.doc_id WHERE word = 'bridge' GROUP BY 1)"""


_SITE = r"""CASE WHEN site_id IS NOT NULL THEN CAST(site_id AS VARCHAR) ELSE '~' || (CASE WHEN len(p) > 2 AND length(p[-2]) <= 3 THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END) END"""
_SITED = rf"""{_RANKED}, t AS (SELECT *, {_SITE} AS site FROM (SELECT *, string_split(regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', ''), '.') AS p FROM r))"""


def _scored(s, d):
    pages = _url(s, d).select(F.col("rec_id").alias("doc_id"), "site_id", "pop_rank", "last_mod_time", "url")
    return index(s, d).filter("word = 'bridge'").groupBy("doc_id").agg(F.count("*").alias("score")).join(pages, "doc_id")


R.add("l28_label", _labelled, f"{_RANKED} SELECT doc_id, score FROM r WHERE doc_id <= 300 OR doc_id > 600")
R.add("j01_live_hits", lambda s, d: _scored(s, d).select("doc_id", "score", "site_id"), f"{_RANKED} SELECT doc_id, score, site_id FROM r")
R.add("o05_page", lambda s, d: results.page(_scored(s, d), 3, 10).select("doc_id", "score", "place"),
      f"{_RANKED} SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, pop_rank DESC, doc_id) AS INT) AS place FROM r QUALIFY place BETWEEN 21 AND 30")
for _p, _o in {"DRP": "last_mod_time DESC, score DESC, pop_rank DESC", "PRD": "pop_rank DESC, score DESC, last_mod_time DESC", "IRPD": "pop_rank * score DESC, score DESC, pop_rank DESC, last_mod_time DESC", "rp": "score, pop_rank", "A": "pop_rank * 1000 + score DESC", "u": "doc_id"}.items():
    R.add(f"o01_sort_{_p.lower() if _p.isupper() else 'up_' + _p}", lambda s, d, p=_p: results.page(_scored(s, d), 1, 50, p).select("doc_id", "place"),
          f"{_RANKED} SELECT doc_id, CAST(row_number() OVER (ORDER BY {_o}, doc_id) AS INT) AS place FROM r QUALIFY place <= 50")
R.add("o06_top", lambda s, d: _scored(s, d).orderBy(F.col("score").desc(), "doc_id").limit(20).select("doc_id", "score"), f"{_RANKED} SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 20")
R.add("a02_by_site", lambda s, d: results.group_by_site(_scored(s, d)).select("doc_id", "site_id", "per_site"),
      f"{_SITED} SELECT doc_id, site_id, count(*) OVER (PARTITION BY site) AS per_site FROM t QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, pop_rank DESC, doc_id) = 1")
R.add("a02_site_runs", lambda s, d: results.group_runs(_scored(s, d)).select("doc_id", "site_id", "per_site"),
      f"""{_SITED}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, pop_rank DESC, doc_id) AS place FROM t),
      n AS (SELECT *, CASE WHEN lag(site) OVER (ORDER BY place) = site THEN 0 ELSE 1 END AS new FROM k),
      g AS (SELECT *, sum(new) OVER (ORDER BY place) AS run FROM n) SELECT doc_id, site_id, per_site FROM (SELECT *, count(*) OVER (PARTITION BY run) AS per_site FROM g) WHERE new = 1""")  # fmt: skip
R.add("w02_rank_in_site", lambda s, d: results.in_site(_scored(s, d)).select("doc_id", "site_rank"),
      f"{_SITED} SELECT doc_id, CAST(row_number() OVER (PARTITION BY site ORDER BY score DESC, pop_rank DESC, doc_id) AS INT) AS site_rank FROM t")
R.add("w03_order_numbers", lambda s, d: results.with_rank(_scored(s, d)).select("doc_id", "place"), f"{_RANKED} SELECT doc_id, row_number() OVER (ORDER BY score DESC, pop_rank DESC, doc_id) AS place FROM r")
R.add("o05_past_the_end", lambda s, d: results.page(_scored(s, d), 1_000_000, 10).select("doc_id", "place"),
      f"{_RANKED} SELECT doc_id, CAST(place AS INT) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, pop_rank DESC, doc_id) AS place, count(*) OVER () AS n FROM r) WHERE place = n")
R.add("j12_merged_shards", lambda s, d: results.merge_shards(*[_scored(s, d).filter(c).select("doc_id", "score") for c in ("doc_id % 2 = 0", "doc_id % 3 = 0", "doc_id % 6 in (1, 5)")]),
      f"{_RANKED} SELECT doc_id, score FROM r")
R.add("j11_details", lambda s, d: results.details(results.page(_scored(s, d)).select("doc_id", "place", "score"), _url(s, d)).select("doc_id", "place", "url", "docsize"),
      f"{_RANKED}, p AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, pop_rank DESC, doc_id) AS INT) AS place FROM r QUALIFY place <= 10) SELECT doc_id, place, url, docsize FROM p JOIN url ON rec_id = doc_id")


def _excerpts(s, d):
    bodies = table(s, d, "urlinfo").filter((plain_name(F.col("sname")) == "body") & (F.col("sval") != "")).groupBy(F.col("url_id").alias("doc_id")).agg(F.min("sval").alias("sval"))
    hits = results.page(_scored(s, d)).select("doc_id", "place")
    return hits.join(bodies, "doc_id", "left").select("doc_id", "place", results.excerpts(["bridge"])(F.col("sval")).alias("excerpt"))


R.add("r01_excerpts", _excerpts)
R.add("r03_highlight", lambda s, d: table(s, d, "records").select("url_id", tx.highlight(F.col("title"), ["bridge", "river"]).alias("title")).distinct(),
      r"SELECT DISTINCT url_id, regexp_replace(title, '(?i)\b(bridge|river)\b', '<b>\1</b>', 'g') AS title FROM records")
_PATHS = "SELECT upper(printf('%02x', r_regionkey)) AS path, r_name AS name FROM region UNION ALL SELECT upper(printf('%02x', n_regionkey)) || upper(printf('%02x', n_nationkey)), n_name FROM nation"


def _categories(s, d):
    two = lambda c: F.lpad(F.hex(F.col(c).cast("bigint")), 2, "0")
    top = table(s, d, "region").select(two("r_regionkey").alias("path"), F.col("r_name").alias("name"))
    return top.unionByName(table(s, d, "nation").select(F.concat(two("n_regionkey"), two("n_nationkey")).alias("path"), F.col("n_name").alias("name")))


R.add("r06_children", lambda s, d: _categories(s, d).filter((F.length("path") == 4) & F.col("path").startswith("02")), f"SELECT * FROM ({_PATHS}) WHERE length(path) = 4 AND starts_with(path, '02')")
R.add("j14_ancestors", lambda s, d: _categories(s, d).select("path", F.explode(rules.prefix_paths(F.col("path"))).alias("up")).join(_categories(s, d).withColumnRenamed("path", "up"), "up").select("path", "up", "name"),
      f"WITH c AS ({_PATHS}) SELECT a.path, b.path AS up, b.name FROM c a JOIN c b ON starts_with(a.path, b.path) AND length(b.path) % 2 = 0")

# --- popularity -----------------------------------------------------------------------------------

_EDGES = "e AS (SELECT ot AS src, k AS dst, max(weight) AS weight FROM links WHERE ot <> k AND k <> 0 AND ot IN (SELECT rec_id FROM url) AND k IN (SELECT rec_id FROM url) GROUP BY 1, 2)"
R.add("j07_link_counts", lambda s, d: popularity.link_counts(popularity.edges(table(s, d, "links"), _url(s, d)), _url(s, d)),
      f"WITH {_EDGES} SELECT rec_id, (SELECT count(*) FROM e WHERE dst = rec_id) AS inlinks, (SELECT count(*) FROM e WHERE src = rec_id) AS outlinks FROM url")
R.add("j07_links_between_sites", lambda s, d: popularity.edges(table(s, d, "links"), _url(s, d), False).groupBy("dst").agg(F.count("*").alias("n")),
      f"WITH {_EDGES} SELECT dst, count(*) AS n FROM e JOIN url a ON a.rec_id = src JOIN url b ON b.rec_id = dst WHERE a.site_id <> b.site_id OR a.site_id IS NULL OR b.site_id IS NULL GROUP BY 1")
R.add("a05_goo", lambda s, d: popularity.goo(_url(s, d), table(s, d, "links"), table(s, d, "servers")).select("rec_id", F.round(F.col("pop_rank") + 1e-9, 6).alias("pop_rank")),
      f"""WITH {_EDGES}, n AS (SELECT site_id, count(*) AS pages FROM url WHERE site_id IS NOT NULL GROUP BY 1), w AS (SELECT n.site_id, s.pop_weight / pages AS pw FROM n JOIN servers s ON s.rec_id = n.site_id),
      o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), sh AS (SELECT u.rec_id AS src, pw / o.n AS share FROM url u JOIN w USING (site_id) JOIN o ON o.src = u.rec_id),
      g AS (SELECT dst, sum(share) AS got FROM e JOIN sh USING (src) GROUP BY 1) SELECT rec_id, round(coalesce(got, 0) + shows * 0.01 + 1e-9, 6) AS pop_rank FROM url LEFT JOIN g ON dst = rec_id""")  # fmt: skip
R.add("a06_site_weights", lambda s, d: _url(s, d).filter("site_id is not null").groupBy("site_id").agg(F.round(F.sum("pop_rank"), 6).alias("rank"), F.count("*").alias("pages")),
      "SELECT site_id, round(sum(pop_rank), 6) AS rank, count(*) AS pages FROM url WHERE site_id IS NOT NULL GROUP BY 1")
R.add("a07_neo", lambda s, d: popularity.neo(_url(s, d), table(s, d, "links")).select("rec_id", F.round("pop_rank", 6).alias("pop_rank")))
R.add("a08_ends", lambda s, d: _url(s, d).agg(F.min("rec_id").alias("first"), F.max("rec_id").alias("last"), F.max("pop_rank").alias("top")), "SELECT min(rec_id) AS first, max(rec_id) AS last, max(pop_rank) AS top FROM url")
R.add("j15_bad_links", lambda s, d: maintenance.bad_links(_url(s, d), table(s, d, "links"), NOW, 86400),
      f"SELECT DISTINCT ot AS src, k AS dst FROM links WHERE ot IN (SELECT rec_id FROM url WHERE status BETWEEN 400 AND 1999 AND bad_since_time < {NOW} - 86400)")
R.add("m04_valid_links", lambda s, d: maintenance.valid_links(table(s, d, "links")), "SELECT ot, k, max(weight) AS weight FROM links WHERE valid IS NULL OR valid = 't' GROUP BY 1, 2")

# --- upkeep ---------------------------------------------------------------------------------------

R.add("src17_targets", lambda s, d: maintenance.targets(_url(s, d), NOW, 50).select("rec_id"), f"SELECT rec_id FROM url WHERE next_index_time <= {NOW} ORDER BY pop_rank DESC, hops, next_index_time, rec_id LIMIT 50")
R.add("src17_targets_by_seed", lambda s, d: maintenance.targets(_url(s, d), NOW, 50, F.col("seed").asc(), where=F.col("status") != 404).select("rec_id"), f"SELECT rec_id FROM url WHERE next_index_time <= {NOW} AND status <> 404 ORDER BY seed, rec_id LIMIT 50")
R.add("a03_statistics", lambda s, d: maintenance.statistics(_url(s, d), NOW),
      f"SELECT status, count(*) AS total, sum(CASE WHEN next_index_time <= {NOW} THEN 1 ELSE 0 END) AS expired, sum(docsize) AS size, sum(CASE WHEN next_index_time <= {NOW} THEN docsize ELSE 0 END) AS expired_size FROM url GROUP BY 1")
R.add("a04_count", lambda s, d: _url(s, d).agg(F.count("*").alias("pages")), "SELECT count(*) AS pages FROM url")
_CLONES = "WITH c AS (SELECT rec_id, crc32 FROM url WHERE crc32 <> 0 AND status IN (200, 206, 304, 2200, 2206, 2304)), g AS (SELECT crc32, min(rec_id) AS origin, count(*) AS clones FROM c GROUP BY 1 HAVING count(*) > 1)"
R.add("u07_clones", lambda s, d: maintenance.clones(_url(s, d)), f"{_CLONES} SELECT rec_id, origin, clones FROM c JOIN g USING (crc32)")
R.add("u06_marked_clones", lambda s, d: maintenance.mark_clones(_url(s, d)).select("rec_id", "status"),
      f"{_CLONES} SELECT u.rec_id, CAST(CASE WHEN u.rec_id <> origin AND status < 2000 THEN status + 2000 ELSE status END AS INT) AS status FROM url u LEFT JOIN (SELECT rec_id, origin FROM c JOIN g USING (crc32)) x USING (rec_id)")
def _revisited(s, d):
    # The pages as a second crawl finds them, under new numbers and a little longer.
    return _url(s, d).withColumn("rec_id", F.col("rec_id") + 10_000_000).withColumn("docsize", (F.col("docsize") * 1.05).cast("int"))


R.add("j13_origins", lambda s, d: maintenance.origin_of(_revisited(s, d), _url(s, d)),
      "SELECT a.rec_id + 10000000 AS rec_id, min(b.rec_id) AS origin FROM url a JOIN url b ON a.crc32 = b.crc32 AND a.crc32 <> 0 AND abs(CAST(trunc(a.docsize * 1.05) AS INT) - b.docsize) <= 0.1 * b.docsize GROUP BY 1")
R.add("a09_clone_ranks", lambda s, d: maintenance.clone_ranks(_url(s, d).unionByName(_revisited(s, d))),
      "SELECT crc32, count(*) AS clones, max(pop_rank) AS top_rank FROM (SELECT * FROM url UNION ALL SELECT * FROM url) WHERE crc32 <> 0 AND status IN (200, 206, 304, 2200, 2206, 2304) GROUP BY 1 HAVING count(*) > 1")
R.add("u06_without_clones", lambda s, d: maintenance.without_clones(index(s, d), _url(s, d)).groupBy("doc_id").agg(F.count("*").alias("hits")),
      f"WITH {POST} SELECT doc_id, count(*) AS hits FROM post WHERE doc_id NOT IN (SELECT rec_id FROM url WHERE status >= 2000) GROUP BY 1")
R.add("snk09_cleared", lambda s, d: maintenance.clear({"links": (table(s, d, "links"), "ot")}, _url(s, d).filter("site_id in (1, 2)").select("rec_id"))["links"].groupBy("ot").agg(F.count("*").alias("n")),
      "SELECT ot, count(*) AS n FROM links WHERE ot NOT IN (SELECT rec_id FROM url WHERE site_id IN (1, 2)) GROUP BY 1")
R.add("u08_changed", lambda s, d: maintenance.changed(_url(s, d).filter("rec_id % 3 <> 0").withColumn("crc32", F.when(F.col("rec_id") % 5 == 0, F.col("crc32") + 1).otherwise(F.col("crc32"))), _url(s, d)),
      "SELECT rec_id, (rec_id % 3 = 0 OR rec_id % 5 = 0) AS changed FROM url")
R.add("snk06_new_targets", lambda s, d: maintenance.add_if_absent(_url(s, d).select("rec_id"), table(s, d, "links").select(F.col("k").alias("rec_id")), ["rec_id"]), "SELECT rec_id FROM url UNION SELECT k FROM links")
R.add("snk07_updated", lambda s, d: maintenance.update(_url(s, d).select("rec_id", "docsize", "status"), rules.newest(table(s, d, "records").select(F.col("url_id").alias("rec_id"), "last_index_time", "docsize"), ["rec_id"], "last_index_time").drop("last_index_time"), ["rec_id"]),
      "SELECT u.rec_id, coalesce(r.docsize, u.docsize) AS docsize, u.status FROM url u LEFT JOIN (SELECT url_id, docsize FROM records QUALIFY row_number() OVER (PARTITION BY url_id ORDER BY last_index_time DESC, docsize DESC) = 1) r ON r.url_id = u.rec_id")
R.add("snk08_deleted", lambda s, d: maintenance.delete(table(s, d, "links"), _url(s, d).filter("status >= 400 and status < 2000").select(F.col("rec_id").alias("ot")), ["ot"]).groupBy("ot").agg(F.count("*").alias("n")),
      "SELECT ot, count(*) AS n FROM links WHERE ot NOT IN (SELECT rec_id FROM url WHERE status >= 400 AND status < 2000) GROUP BY 1")


def _live(s, d):
    # Each record version writes postings of its title; a deletion at 2012 drops older ones of even pages.
    stamped = table(s, d, "records").filter("title is not null").select(F.col("url_id").alias("doc_id"), F.col("last_index_time").alias("stamp"), F.explode(tx.words(F.col("title"))).alias("word"))
    gone = _url(s, d).filter("rec_id % 2 = 0").select(F.col("rec_id").alias("doc_id"), F.lit("2012-01-01 00:00:00").cast("timestamp_ntz").alias("stamp"))
    return maintenance.live_postings(stamped, gone).groupBy("word").agg(F.count("*").alias("hits"))


R.add("j05_live_postings", _live,
      r"SELECT word, count(*) AS hits FROM (SELECT url_id, last_index_time AS t, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS word FROM records WHERE title IS NOT NULL) WHERE NOT (url_id IN (SELECT rec_id FROM url) AND url_id % 2 = 0) OR t > TIMESTAMP '2012-01-01' GROUP BY 1")
R.add("snk11_query_log", lambda s, d: maintenance.tracked([(w, index(s, d).filter(F.col("word") == w).select("doc_id").distinct()) for w in ("bridge", "river", "nowhereword")], NOW),
      f"WITH {POST} SELECT w AS qwords, {NOW} AS qtime, 0 AS wtime, (SELECT count(DISTINCT doc_id) FROM post WHERE word = w) AS found FROM (SELECT unnest(['bridge', 'river', 'nowhereword']) AS w)")
R.add("snk13_sitemap", lambda s, d: maintenance.sitemap(_url(s, d)),
      "WITH o AS (SELECT * FROM url WHERE status = 0 OR status BETWEEN 200 AND 399 OR status BETWEEN 2200 AND 2399) SELECT url AS loc, last_mod_time, round((pop_rank - min(pop_rank) OVER ()) / (max(pop_rank) OVER () - min(pop_rank) OVER () + 1e-5), 6) AS priority FROM o")
R.add("m01_marked", lambda s, d: maintenance.postpone(_url(s, d), F.col("url").contains("harbour"), NOW).select("rec_id", "next_index_time"), f"SELECT rec_id, CASE WHEN contains(url, 'harbour') THEN {NOW} ELSE next_index_time END AS next_index_time FROM url")
R.add("m02_postponed", lambda s, d: maintenance.postpone(_url(s, d), (F.col("site_id") == 3) & (F.col("next_index_time") <= NOW), NOW + 86400).select("rec_id", "next_index_time"), f"SELECT rec_id, CASE WHEN site_id = 3 AND next_index_time <= {NOW} THEN {NOW + 86400} ELSE next_index_time END AS next_index_time FROM url")
R.add("r07_referrers", lambda s, d: maintenance.referrers(_url(s, d)).select("rec_id", "status", "url", "referrer_url"), "SELECT a.rec_id, a.status, a.url, b.url AS referrer_url FROM url a JOIN url b ON a.referrer = b.rec_id WHERE a.referrer <> 0 AND a.referrer <> a.rec_id")
R.add("m03_has_referrer", lambda s, d: _url(s, d).join(table(s, d, "links").filter("ot <> k").select(F.col("k").alias("rec_id")).distinct(), "rec_id", "left_semi").select("rec_id"), "SELECT rec_id FROM url WHERE rec_id IN (SELECT k FROM links WHERE ot <> k)")
R.add("m05_site_keys", lambda s, d: _url(s, d).groupBy(u.site_key(F.col("url")).alias("site")).agg(F.count("*").alias("pages")),
      r"WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') AS host FROM url), l AS (SELECT string_split(host, '.') AS p FROM h) SELECT array_to_string(CASE WHEN len(p) > 2 AND length(p[-2]) <= 3 THEN p[-3:] ELSE p[-2:] END, '.') AS site, count(*) AS pages FROM l GROUP BY 1")
_ALIASES = [("begin", "http://jorhellosil.test/", "file:/mirror/jor/"), ("regex", r"^https://([^/]+)/(\d{4})/(.*)$", "file:/years/$2/$1/$3")]
R.add("m06_alias", lambda s, d: _url(s, d).select("rec_id", rules.alias(F.col("url"), _ALIASES).alias("alias")),
      r"SELECT rec_id, CASE WHEN starts_with(url, 'http://jorhellosil.test/') THEN 'file:/mirror/jor/' || url[25:] WHEN regexp_matches(url, '^https://([^/]+)/(\d{4})/(.*)$') THEN regexp_replace(url, '^https://([^/]+)/(\d{4})/(.*)$', 'file:/years/\2/\1/\3') END AS alias FROM url")
R.add("m06_reverse_alias", lambda s, d: _url(s, d).select("rec_id", rules.reverse_alias(F.coalesce(rules.alias(F.col("url"), _ALIASES[:1]), F.col("url")), [("http://jorhellosil.test/", "file:/mirror/jor/")]).alias("url")), "SELECT rec_id, url FROM url")
R.add("m09_orphans", lambda s, d: maintenance.orphans(_url(s, d), table(s, d, "records"), "rec_id", "url_id").withColumn("lacks", F.lit("records")).unionByName(maintenance.orphans(table(s, d, "links"), _url(s, d), "k", "rec_id").select(F.col("k").alias("rec_id")).withColumn("lacks", F.lit("url"))),
      "SELECT DISTINCT rec_id, 'records' AS lacks FROM url WHERE rec_id NOT IN (SELECT url_id FROM records) UNION ALL SELECT DISTINCT k, 'url' FROM links WHERE k NOT IN (SELECT rec_id FROM url)")
R.add("m07_servers", lambda s, d: maintenance.add_if_absent(table(s, d, "servers").select("url", "tag"), s.createDataFrame([("http://new.test/", "N"), ("http://jorhellosil.test/", "Z")], "url string, tag string"), ["url"]), "SELECT url, tag FROM servers UNION ALL SELECT 'http://new.test/', 'N'")
R.add("m11_found_by_url", lambda s, d: maintenance.find_by_url(_url(s, d), table(s, d, "records")), "SELECT DISTINCT url, rec_id FROM url WHERE url IN (SELECT url FROM records)")


def _rows_as_documents(s, d):
    table(s, d, "orders").createOrReplaceTempView("htdb_orders")
    table(s, d, "customer").createOrReplaceTempView("htdb_customer")
    return files.read_query(s, "SELECT * FROM htdb_orders JOIN htdb_customer ON o_custkey = c_custkey WHERE o_orderstatus = '$1'", "o_orderkey", ["c_name", "o_orderpriority", "o_orderstatus"], "htdb:/orders/", ["F"])


R.add("src07_rows_as_documents", _rows_as_documents,
      "SELECT 'htdb:/orders/' || o_orderkey AS url, c_name || ' ' || o_orderpriority || ' ' || o_orderstatus AS text FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")


def _stored_copies(s, d):
    path = stored(s, "copies", [table(s, d, "documents")], lambda p: files.store_copies(table(s, d, "documents"), p))
    return files.read_copies(s, path).select("doc_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("hash"))


R.add("src09_stored_copies", _stored_copies, "SELECT doc_id, CAST(length(text) AS INT) AS chars, md5(text) AS hash FROM documents WHERE text IS NOT NULL")


def _url_list(s, d):
    path = stored(s, "list", [table(s, d, "records")], lambda p: table(s, d, "records").select(F.concat(F.col("url"), F.lit(" "))).union(s.createDataFrame([("# a list",), ("",)], "url string")).write.text(p))
    return _url(s, d).join(files.read_url_list(s, path), "url", "left_semi").select("rec_id")


R.add("src15_url_list", _url_list, "SELECT rec_id FROM url WHERE url IN (SELECT url FROM records)")

# --- functions ------------------------------------------------------------------------------------

R.add("p05_url_parts", lambda s, d: _url(s, d).select("rec_id", *[u.part(F.col("url"), p).alias(p) for p in ("scheme", "host", "path", "directory", "file", "query")]),
      r"""WITH p AS (SELECT rec_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM url) SELECT rec_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, path, regexp_extract(path, '^(.*/)', 1) AS directory, regexp_extract(path, '([^/]*)$', 1) AS file, regexp_extract(url, '\?([^#]*)', 1) AS query FROM p""")  # fmt: skip
R.add("p12_regex_sections", lambda s, d: _url(s, d).select("rec_id", rules.captures(F.col("url"), r"/((?:19|20)\d\d)/([a-z]+)/", "$2 of $1").alias("value")),
      r"SELECT rec_id, CASE WHEN regexp_matches(url, '/((?:19|20)\d\d)/([a-z]+)/') THEN regexp_extract(url, '/((?:19|20)\d\d)/([a-z]+)/', 2) || ' of ' || regexp_extract(url, '/((?:19|20)\d\d)/([a-z]+)/', 1) END AS value FROM url")
R.add("p16_resolved", lambda s, d: _url(s, d).select("rec_id", u.resolve(F.col("url"), F.lit("../up/./x.html?q=1#top")).alias("url"), u.depth(F.col("url")).alias("depth")))
R.add("p18_running_size", lambda s, d: maintenance.running_sums(table(s, d, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n")), "source", "doc_id", F.col("n")).select("doc_id", "source", "so_far"),
      "SELECT doc_id, source, sum(coalesce(length(text), 0)) OVER (PARTITION BY source ORDER BY doc_id) AS so_far FROM documents")
R.add("p18_size_limits", lambda s, d: postings.within_size(items(s, d), 4000, 100).groupBy("doc_id").agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("chars")),
      f"WITH {POST}, z AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id) AS whole, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY section, text ROWS UNBOUNDED PRECEDING) - length(text) AS before FROM items) SELECT doc_id, count(*) AS items, sum(length(text)) AS chars FROM z WHERE whole >= 100 AND before < 4000 GROUP BY 1")


R.add("f01_packing", lambda s, d: index(s, d).select("doc_id", tx.pack_position(F.col("pos"), F.col("section"), F.length("word")).alias("x")).select("doc_id", *[c.alias(n) for c, n in zip(tx.unpack_position(F.col("x")), ("pos", "section", "length"))]),
      f"WITH {POST} SELECT doc_id, pos, section, CAST(length(word) AS INT) AS length FROM post")
R.add("f02_codes", lambda s, d: table(s, d, "servers").select("rec_id", F.base64(F.col("url").cast("binary")).alias("b"), F.hex(F.col("tag").cast("binary")).alias("h"), F.reverse("tag").alias("r"), F.md5(F.col("url").cast("binary")).alias("m")),
      "SELECT rec_id, base64(encode(url)) AS b, hex(encode(tag)) AS h, reverse(tag) AS r, md5(url) AS m FROM servers")
R.add("f03_periods", lambda s, d: s.createDataFrame([("1d12h",), ("90",), ("2m",), ("1y",), ("5M3s",), ("soon",)], "p string").select("p", tx.period_seconds(F.col("p")).alias("seconds")),
      "SELECT * FROM (VALUES ('1d12h', 129600), ('90', 90), ('2m', 5184000), ('1y', 31536000), ('5M3s', 303), ('soon', NULL)) AS t(p, seconds)")
R.add("f04_sigmoid", lambda s, d: _url(s, d).select("rec_id", F.round(tx.sigmoid(F.col("pop_rank")), 6).alias("y")), "SELECT rec_id, round(1 / (1 + exp(-pop_rank)), 6) AS y FROM url")

QUERIES, SQL = R.queries, R.sql

"""Queries of the operators of this package, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions.names import plain_name
from corpusloom.llm import encoding, language, lines, neardup, packing, quality, tokens
from corpusloom.operators.eav import section_registry
from corpusloom.session import materialize, run_dir
from corpusloom.sources.tables import table


def p6_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"), path=tokens.VOCABULARY)


def p7_packing(spark, d):
    return packing.pack_all(table(spark, d, "documents"), table(spark, d, "containers"), tokens.VOCABULARY)


def p7_fill(spark, d):
    """Containers, room left over and fill of each capacity."""
    used = p7_packing(spark, d).filter("container is not null").groupBy("container_id", "capacity").agg(F.max("container").alias("top"), F.sum("tokens").alias("tokens"))
    n = F.col("top") + 1
    return used.select("container_id", "capacity", n.alias("containers"), "tokens", (n * F.col("capacity") - F.col("tokens")).alias("room_left"), F.round(F.col("tokens") / (n * F.col("capacity")), 6).alias("fill"))


def bodies(spark, d):
    """(page, body) rows of urlinfo."""
    rows = table(spark, d, "urlinfo").filter(plain_name(F.col("sname")) == "body")
    return rows.select(F.col("url_id").alias("page"), F.col("sval").alias("body"))


def sites(spark, d):
    """(page, site) rows of records."""
    return table(spark, d, "records").select(F.col("url_id").alias("page"), lines.site_of(F.col("url")).alias("site"))


def _state(spark):
    return lines.LineCounts(spark, f"{run_dir(spark)}/line-counts-{uuid.uuid4().hex}")


def p2_found(spark, d):
    found = _state(spark).merge(bodies(spark, d), sites(spark, d))
    return found.removed.select(F.col("page").alias("url_id"), "line_no")


def p2_increments(spark, d):
    """The lines of p2_found, by three deltas of pages merged one after another: each replaces the rows of the documents that it affects, and no others."""
    state, rows = _state(spark), None
    part = F.pmod(F.xxhash64("page"), F.lit(3))
    for k in range(3):
        m = lines.LineCounts.open(spark, state.path).merge(bodies(spark, d).filter(part == k), sites(spark, d))
        rows = materialize(m.removed if rows is None else rows.join(m.affected, "page", "left_anti").unionByName(m.removed), "removed")
    return rows.select(F.col("page").alias("url_id"), "line_no")


def p2_cleaned(spark, d):
    """Each body that lost lines, without them."""
    found = _state(spark).merge(bodies(spark, d), sites(spark, d))
    out = lines.rebuild(bodies(spark, d).filter("body is not null").distinct(), found.removed)
    return out.select(F.col("page").alias("url_id"), "body", "removed")


def _near(spark, d):
    texts = bodies(spark, d).select(F.col("page").alias("id"), F.col("body").alias("text"))
    urls = table(spark, d, "records").select(F.col("url_id").alias("id"), F.col("url").alias("text")).distinct()
    return neardup.near_duplicates(texts, neardup.WORDS3), neardup.near_duplicates(urls, neardup.URL5)


def p1_found(spark, d):
    body, url = _near(spark, d)
    both = neardup.all_pairs(body).unionByName(neardup.all_pairs(url)).distinct()
    return both.select(F.col("a").alias("url_id_a"), F.col("b").alias("url_id_b"))


def p1_groups(spark, d):
    """Each page with a body or a record: the group of pages it belongs to, by chains of near-duplicate bodies and URLs.

    rep is the page that stands for equal bodies, links the number of other such pages that a body or URL links it to.
    """
    return neardup.groups(neardup.union(*_near(spark, d))).withColumnRenamed("id", "url_id")


P3_KEYS = ["src", "url_id", "sname"]


def _garbled(spark, d):
    names = [n for n, kind, _ in section_registry(table(spark, d, "sections")) if kind == "string"]
    info = table(spark, d, "urlinfo").select(F.lit("urlinfo").alias("src"), "url_id", plain_name(F.col("sname")).alias("sname"), "sval").filter(F.col("sname").isin(names))
    titles = table(spark, d, "records").select(F.lit("records").alias("src"), "url_id", F.lit("title").alias("sname"), F.col("title").alias("sval"))
    values = info.unionByName(titles).filter("sval is not null and sval <> ''")
    pages = table(spark, d, "url").select(F.col("rec_id").alias("id"), lines.site_of(F.col("url")).alias("source"))
    return encoding.find(values, pages, P3_KEYS)


def p3_found(spark, d):
    return _garbled(spark, d).places.select(*P3_KEYS).distinct()


def p3_restored(spark, d):
    return encoding.restored(_garbled(spark, d), P3_KEYS)


def _stretches(spark, d):
    texts = bodies(spark, d).select(F.col("page").alias("id"), F.col("body").alias("text"))
    return language.stretches(texts, language.train_from(texts, table(spark, d, "stopwords")))


def p4_found(spark, d):
    rows = table(spark, d, "urlinfo").filter(plain_name(F.col("sname")) == "content-language")
    labels = rows.select(F.col("url_id").alias("id"), F.col("sval").alias("label"))
    return language.missing_labels(_stretches(spark, d), labels).select(F.col("id").alias("url_id"), "lang")


def p4_stretches(spark, d):
    """Each body's stretches with language and confidence."""
    return _stretches(spark, d).withColumnRenamed("id", "url_id")


def p4_documents(spark, d):
    """Each body's language with a confidence."""
    return language.documents(_stretches(spark, d)).withColumnRenamed("id", "url_id")


def p8_found(spark, d):
    return quality.kinds(table(spark, d, "documents"), table(spark, d, "stopwords")).filter("kind is not null").select("doc_id", "kind")


def p8_statistics(spark, d):
    return quality.kinds(table(spark, d, "documents"), table(spark, d, "stopwords"))


_LINES = r"""
WITH site AS (SELECT url_id, min(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@\s]+)', 1)) AS s FROM records GROUP BY 1),
body AS (SELECT DISTINCT url_id, sval FROM urlinfo WHERE replace(lower(regexp_replace(sname, '^\s+|\s+$', '', 'g')), '_', '-') = 'body' AND sval IS NOT NULL),
line AS (SELECT url_id, unnest(string_split(sval, chr(10))) AS t, generate_subscripts(string_split(sval, chr(10)), 1) - 1 AS line_no FROM body),
norm AS (SELECT s, url_id, line_no, regexp_replace(lower(trim(regexp_replace(t, '[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS n
         FROM line JOIN site USING (url_id) WHERE s <> ''),
hit AS (SELECT s, n FROM norm WHERE n <> '' GROUP BY 1, 2 HAVING count(DISTINCT url_id) >= 5)
"""

_PAIRS = r"""
WITH body AS (SELECT DISTINCT url_id, regexp_extract_all(lower(sval), '[\p{L}\p{N}]+') AS w FROM urlinfo WHERE replace(lower(regexp_replace(sname, '^\s+|\s+$', '', 'g')), '_', '-') = 'body' AND sval IS NOT NULL),
words AS (SELECT DISTINCT url_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS s FROM body WHERE len(w) >= 3),
u AS (SELECT DISTINCT url_id, regexp_replace(lower(url), '^.*?://', '') AS t FROM records),
signs AS (SELECT DISTINCT url_id, unnest([substr(t, i, 5) FOR i IN range(1, length(t) - 3)]) AS s FROM u WHERE length(t) >= 5),
wn AS (SELECT url_id, count(*) AS n FROM words GROUP BY 1),
sn AS (SELECT url_id, count(*) AS n FROM signs GROUP BY 1),
wc AS (SELECT a.url_id AS a, b.url_id AS b, count(*) AS c FROM words a JOIN words b ON a.s = b.s AND a.url_id < b.url_id GROUP BY 1, 2),
sc AS (SELECT a.url_id AS a, b.url_id AS b, count(*) AS c FROM signs a JOIN signs b ON a.s = b.s AND a.url_id < b.url_id GROUP BY 1, 2)
SELECT a AS url_id_a, b AS url_id_b FROM wc JOIN wn x ON x.url_id = a JOIN wn y ON y.url_id = b WHERE 10 * c >= 6 * (x.n + y.n - c)
UNION SELECT a, b FROM sc JOIN sn x ON x.url_id = a JOIN sn y ON y.url_id = b WHERE 10 * c >= 7 * (x.n + y.n - c)
"""

QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_increments": p2_increments, "p2_cleaned": p2_cleaned, "p3_found": p3_found, "p3_restored": p3_restored, "p4_found": p4_found, "p4_stretches": p4_stretches, "p4_documents": p4_documents, "p6_ids": p6_ids, "p7_packing": p7_packing, "p7_fill": p7_fill, "p8_found": p8_found, "p8_statistics": p8_statistics}
_REPEATED = _LINES + "SELECT DISTINCT url_id, CAST(line_no AS INT) AS line_no FROM norm JOIN hit USING (s, n)"
_CLEANED = _LINES + r"""SELECT b.url_id, array_to_string(list_transform(list_filter(list_zip(string_split(sval, chr(10)), range(0, len(string_split(sval, chr(10))))), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), chr(10)) AS body, CAST(len(gone) AS INT) AS removed
FROM body b JOIN (SELECT url_id, list(DISTINCT line_no) AS gone FROM norm JOIN hit USING (s, n) GROUP BY 1) g USING (url_id)"""
SQL: dict[str, str] = {"p1_found": _PAIRS, "p2_found": _REPEATED, "p2_increments": _REPEATED, "p2_cleaned": _CLEANED}

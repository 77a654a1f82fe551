"""Text processing, the index, the query language and the scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import maintenance, postings, scoring, summary
from corpusloom.plans import forms
from corpusloom.plans import query as ql
from corpusloom.queries.common import INDEXED, ITEMS, PLAIN, POST, Registry, index, items
from corpusloom.session import stored
from corpusloom.sources.tables import table

R = Registry()
#: A small dictionary and its affixes.
WORDS_FILE = "bridge/S\ngarden/SR\nriver/S\n"
AFFIX_FILE = "suffixes\nflag *S:\n  [^Y] > S\nflag *R:\n  [^E] > ER\n"
#: A word without marks, in SQL: strip_accents knows Latin letters only, so the Cyrillic ones with marks are written out.
_PLAIN_WORD = "translate(strip_accents(word), 'ёйѝѐїўѓќѷ', 'еиииіугкѵ')"
SECTIONS = {"body": 1, "title": 2, "meta.keywords": 3, "meta.description": 4}

# --- text -----------------------------------------------------------------------------------------

R.add("t01_words", lambda s, d: index(s, d).groupBy("word").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("documents")),
      f"WITH {POST} SELECT word, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM post GROUP BY 1")
R.add("t01_loose_words", lambda s, d: postings.postings(items(s, d), token=tx.loose_words).groupBy("word").agg(F.count("*").alias("hits")),
      f"WITH {POST.split(',' + chr(10) + 'tok')[0]} SELECT word, count(*) AS hits FROM (SELECT unnest(regexp_extract_all(lower(text), '[^\\s]*[\\p{{L}}\\p{{N}}][^\\s]*')) AS word FROM items) WHERE length(word) BETWEEN 1 AND 32 GROUP BY 1")
R.add("t04_normal_form", lambda s, d: table(s, d, "records").select("url_id", tx.normalize_nfc(F.col("title")).alias("title")).distinct(),
      "SELECT DISTINCT url_id, nfc_normalize(title) AS title FROM records")
R.add("t05_strip_accents", lambda s, d: index(s, d).select(tx.strip_accents(F.col("word")).alias("plain")).groupBy("plain").agg(F.count("*").alias("hits")),
      f"WITH {POST} SELECT {_PLAIN_WORD} AS plain, count(*) AS hits FROM post GROUP BY 1")
R.add("t06_german_spelling", lambda s, d: postings.german_variants(index(s, d)).groupBy("word").agg(F.count("*").alias("hits")),
      f"WITH {POST} SELECT replace(replace(replace(replace(word, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS word, count(*) AS hits FROM post WHERE word SIMILAR TO '.*[äöüß].*' GROUP BY 1")
R.add("t07_length_bounds", lambda s, d: index(s, d).filter(F.length("word").between(4, 12)).groupBy("doc_id").agg(F.count("*").alias("hits")),
      f"WITH {POST} SELECT doc_id, count(*) AS hits FROM post WHERE length(word) BETWEEN 4 AND 12 GROUP BY 1")
R.add("t08_positions", lambda s, d: index(s, d).select("doc_id", "section", "pos", "word"),
      f"WITH {POST} SELECT * FROM post")
R.add("t09_accent_variants", lambda s, d: postings.accent_variants(index(s, d)).select("doc_id", "section", "pos", "word"),
      f"WITH {POST} SELECT doc_id, section, pos, {_PLAIN_WORD} AS word FROM post WHERE {_PLAIN_WORD} <> word AND {_PLAIN_WORD} <> ''")
R.add("t09_prefixes", lambda s, d: postings.affix_variants(index(s, d)).groupBy("word").agg(F.count("*").alias("hits")),
      f"WITH {POST} SELECT w AS word, count(*) AS hits FROM (SELECT unnest([word[1:k] FOR k IN range(3, length(word))]) AS w FROM post WHERE length(word) > 3) GROUP BY 1")
R.add("t09_suffixes", lambda s, d: postings.affix_variants(index(s, d), suffixes=True).groupBy("word").agg(F.count("*").alias("hits")),
      f"WITH {POST} SELECT w AS word, count(*) AS hits FROM (SELECT unnest([right(word, k) FOR k IN range(3, length(word))]) AS w FROM post WHERE length(word) > 3) GROUP BY 1")
R.add("t13_equal_contents", lambda s, d: postings.content_hashes(items(s, d)).groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("documents")).filter("documents > 1").select("first", "documents"),
      f"WITH {POST}, c AS (SELECT doc_id, list((section, text) ORDER BY section, text) AS content FROM items GROUP BY 1) SELECT min(doc_id) AS first, count(*) AS documents FROM c GROUP BY content HAVING count(*) > 1")
R.add("t14_without_stopwords", lambda s, d: postings.without_stopwords(index(s, d), table(s, d, "stopwords")).groupBy("word").agg(F.count("*").alias("hits")),
      f"WITH {POST} SELECT word, count(*) AS hits FROM post WHERE word NOT IN (SELECT lower(word) FROM stopwords) GROUP BY 1")
R.add("t16_entities", lambda s, d: table(s, d, "documents").filter("text is not null").select("doc_id", F.length(tx.unescape_entities(F.col("text"))).alias("chars")))
R.add("t17_profiles", lambda s, d: summary.gram_profiles(table(s, d, "documents").filter("lang is not null"), "lang"),
      r"""WITH t AS (SELECT lang, regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g') AS x FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
      g AS (SELECT lang, unnest([substr(x, i, 3) FOR i IN range(1, length(x) - 1)]) AS gram FROM t),
      n AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY 1, 2),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS INT) AS rank FROM n)
      SELECT lang, gram, n, rank FROM r WHERE rank <= 150""")  # fmt: skip


def _guess(s, d):
    docs = table(s, d, "documents").filter("text is not null")
    return summary.guess(docs, summary.gram_profiles(docs.filter("lang is not null"), "lang"))


R.add("t17_guess", _guess,
      r"""WITH t AS (SELECT doc_id, lang, regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g') AS x FROM documents WHERE text IS NOT NULL),
      g AS (SELECT doc_id, lang, unnest([substr(x, i, 3) FOR i IN range(1, length(x) - 1)]) AS gram FROM t),
      mn AS (SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY 1, 2),
      m AS (SELECT * FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rank FROM mn) WHERE rank <= 150),
      dn AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2),
      o AS (SELECT * FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS r FROM dn) WHERE r <= 150),
      z AS (SELECT doc_id, count(*) AS grams FROM o GROUP BY 1),
      q AS (SELECT doc_id, lang, sum(abs(r - rank)) AS diff, count(*) AS hit FROM o JOIN m USING (gram) GROUP BY 1, 2)
      SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY diff + (grams - hit) * 150, lang) AS k FROM q JOIN z USING (doc_id)) WHERE k = 1""")  # fmt: skip
R.add("t19_sentences", lambda s, d: table(s, d, "documents").filter("text is not null").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("sentences")),
      r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?…][''"”»’)]*)\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x) <> '')) AS INT) AS sentences FROM documents WHERE text IS NOT NULL""")  # fmt: skip
R.add("t20_summaries", lambda s, d: summary.summaries(table(s, d, "documents").filter("text is not null")))


def _anchors(s, d):
    rows = postings.section_items(table(s, d, "urlinfo"), table(s, d, "sections"), ["crosswords"])
    return postings.anchor_postings(rows.select(F.col("doc_id").alias("target_id"), F.lit(0).alias("ref_id"), "section", "text"))


R.add("t21_anchor_words", lambda s, d: _anchors(s, d).groupBy("doc_id", "word").agg(F.count("*").alias("hits")),
      rf"""SELECT doc_id, word, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM (SELECT DISTINCT url_id AS doc_id, sval AS text FROM urlinfo u WHERE {PLAIN} = 'crosswords' AND sval <> '')) GROUP BY 1, 2""")


def _suggest(s, d):
    counts = index(s, d).groupBy("word").agg(F.count("*").alias("n"))
    wrong = s.createDataFrame([("brigde",), ("archve",), ("rivr",), ("musem",)], "word string")
    return summary.suggest(wrong, counts)


R.add("t22_suggestions", _suggest,
      f"""WITH {POST}, v AS (SELECT word, count(*) AS n FROM post GROUP BY 1), q AS (SELECT unnest(['brigde', 'archve', 'rivr', 'musem']) AS word)
      SELECT word, suggestion, CAST(distance AS INT) AS distance FROM (SELECT q.word, v.word AS suggestion, levenshtein(q.word, v.word) AS distance, row_number() OVER (PARTITION BY q.word ORDER BY levenshtein(q.word, v.word), v.n DESC, v.word) AS k
      FROM q JOIN v ON levenshtein(q.word, v.word) BETWEEN 1 AND 2) WHERE k = 1""")  # fmt: skip
R.add("snk01_packed", lambda s, d: postings.packed(index(s, d)),
      f"WITH {POST} SELECT doc_id, word, CAST((pos << 16) + (section << 8) + length(word) AS INT) AS intag FROM post")


def _by_length(s, d):
    """Written into a folder for each length of words, and read again."""
    path = stored(s, "index-by-length", [table(s, d, "urlinfo"), table(s, d, "sections")], lambda p: postings.write_postings(index(s, d), p, by="length"))
    return s.read.parquet(path)


R.add("snk02_read_by_length", lambda s, d: _by_length(s, d).filter(F.col("bucket") == 6).groupBy("word").agg(F.count("*").alias("hits")),
      f"WITH {POST} SELECT word, count(*) AS hits FROM post WHERE length(word) = 6 GROUP BY 1")
R.add("snk05_lookup", lambda s, d: index(s, d).filter(F.col("word").isin("bridge", "river")).groupBy("word").agg(F.count("*").alias("hits"), F.min("doc_id").alias("first"), F.max("pos").alias("last_pos")),
      f"WITH {POST} SELECT word, count(*) AS hits, min(doc_id) AS first, max(pos) AS last_pos FROM post WHERE word IN ('bridge', 'river') GROUP BY 1")
R.add("snk02_length_buckets", lambda s, d: index(s, d).groupBy(postings.length_bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("hits")),
      f"WITH {POST} SELECT CAST(CASE WHEN length(word) <= 2 THEN 2 WHEN length(word) <= 12 THEN length(word) WHEN length(word) <= 16 THEN 16 ELSE 32 END AS INT) AS bucket, count(*) AS hits FROM post GROUP BY 1")
R.add("p17_longest_items", lambda s, d: items(s, d).withColumn("n", F.row_number().over(ql_window())).filter("n <= 2").select("doc_id", "section", F.length("text").alias("chars")),
      f"WITH {POST} SELECT doc_id, section, CAST(length(text) AS INT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, section, text) AS n FROM items) WHERE n <= 2")


def ql_window():
    from pyspark.sql.window import Window

    return Window.partitionBy("doc_id").orderBy(F.length("text").desc(), "section", "text")


def _truncated(s, d):
    sec = table(s, d, "sections").select(F.col("secno").alias("section"), "maxlen", "single")
    joined = postings.joined_items(items(s, d), sec)
    return joined.join(F.broadcast(sec), "section").select("doc_id", "section", F.when(F.col("maxlen") > 0, F.substring(F.col("t"), F.lit(1), F.col("maxlen"))).otherwise(F.col("t")).alias("value"))


R.add("p19_truncated_sections", _truncated,
      f"WITH {POST}, j AS (SELECT doc_id, section, CASE WHEN any_value(single) = 1 THEN min(text) ELSE string_agg(text, ' ' ORDER BY text) END AS t FROM items JOIN sections ON secno = section GROUP BY 1, 2) SELECT doc_id, section, CASE WHEN maxlen > 0 THEN t[1:maxlen] ELSE t END AS value FROM j JOIN sections s ON s.secno = j.section")

# --- query language --------------------------------------------------------------------------------


def _ask(text: str, mode: str = "all", match: str = "full", documents: bool = False, stop: bool = False, loose: bool = False, **dictionaries):
    """A query over the index (loose: of words with their punctuation); dictionaries as forms.expansions takes them."""
    def run(s, d):
        stopwords = postings.stopwords_among(table(s, d, "stopwords"), tx.words_in(text)) if stop else frozenset()
        tree = ql.Parser(mode, match, SECTIONS, stopwords, loose=loose).parse(text)
        if dictionaries:
            tree = ql.expand(tree, forms.expansions([w.text for w in ql.leaves(tree)], **dictionaries))
        post = postings.with_parts(postings.postings(items(s, d), token=tx.loose_words)) if loose else index(s, d)
        return ql.evaluate(tree, post, items(s, d) if documents else None)

    return run


def _has(word: str, test: str = "word = '{}'") -> str:
    return f"SELECT doc_id FROM post WHERE {test.format(word)}"


def _pair(a: str, b: str, how: str) -> str:
    return f"SELECT DISTINCT x.doc_id FROM (SELECT * FROM post WHERE word = '{a}') x JOIN (SELECT * FROM post WHERE word = '{b}') y ON x.doc_id = y.doc_id AND {how}"


IN_TITLE, IN_KEYWORDS = "word = '{}' AND section = 2", "word = '{}' AND section = 3"
NEAR, ANY, NEXT = "abs(x.pos - y.pos) <= 16", "abs(x.pos - y.pos) = 2", "y.pos = x.pos + 1 AND x.section = y.section"
_SQL = {
    "q03_all": (_ask("bridge river"), f"{_has('bridge')} INTERSECT {_has('river')}"),
    "q04_any": (_ask("orchard lantern", "any"), f"{_has('orchard')} UNION {_has('lantern')}"),
    "q05_near": (_ask("bridge railway", "near"), _pair("bridge", "railway", NEAR)),
    "q06_bool": (_ask("bridge and (river or museum) and not archive", "bool"), f"({_has('bridge')} INTERSECT ({_has('river')} UNION {_has('museum')})) EXCEPT {_has('archive')}"),
    "q06_signs": (_ask("bridge & (river | museum) & ~archive"), f"({_has('bridge')} INTERSECT ({_has('river')} UNION {_has('museum')})) EXCEPT {_has('archive')}"),
    "q06_anyword": (_ask("daily any of", "bool"), _pair("daily", "of", ANY)),
    "q06_near_not": (_ask("bridge near not railway", "bool"), f"({_has('bridge')} INTERSECT {_has('railway')}) EXCEPT {_pair('bridge', 'railway', NEAR)}"),
    "q06_not_alone": (_ask("not bridge", "bool", documents=True), f"SELECT doc_id FROM items EXCEPT {_has('bridge')}"),
    "q07_phrase": (_ask('"the bridge"'), _pair("the", "bridge", NEXT)),
    "q07_phrase_or_word": (_ask('"the bridge" or orchard', "bool"), f"{_pair('the', 'bridge', NEXT)} UNION {_has('orchard')}"),
    "q08_joined_words": (_ask("daily-bridge the.river", "any"), f"{_pair('daily', 'bridge', NEXT)} UNION {_pair('the', 'river', NEXT)}"),
    "q09_section_scope": (_ask("allintitle: bridge"), _has("bridge", IN_TITLE)),
    "q09_scoped_group": (_ask("(allinmeta.keywords: river) bridge"), f"{_has('river', IN_KEYWORDS)} INTERSECT {_has('bridge')}"),
    "q10_prefix_form": (_ask("<and>(bridge, <or>(river, museum))"), f"{_has('bridge')} INTERSECT ({_has('river')} UNION {_has('museum')})"),
    "q11_stopwords": (_ask("the bridge of river", stop=True), f"{_has('bridge')} INTERSECT {_has('river')}"),
    "q12_begin": (_ask("brid", match="beg"), f"SELECT DISTINCT doc_id FROM post WHERE word LIKE 'brid%'"),
    "q12_end": (_ask("idge", match="end"), f"SELECT DISTINCT doc_id FROM post WHERE word LIKE '%idge'"),
    "q12_part": (_ask("ridg", match="sub"), f"SELECT DISTINCT doc_id FROM post WHERE word LIKE '%ridg%'"),
    "q13_forms": (_ask("bridges garden", morphology=forms.Morphology(forms.parse_dictionary(WORDS_FILE), forms.parse_affixes(AFFIX_FILE))), f"({_has('bridge')} UNION {_has('bridges')}) INTERSECT ({_has('garden')} UNION {_has('gardens')} UNION {_has('gardener')})"),
    "q14_query_affixes": (_ask("archived", affixes=[("d$", ""), ("d$", "s")]), f"{_has('archived')} UNION {_has('archive')} UNION {_has('archives')}"),
    "q15_synonyms": (_ask("river", synonyms=forms.parse_pairs("Language: en\nriver harbour\nharbour island\n")), f"{_has('river')} UNION {_has('harbour')} UNION {_has('island')}"),
    "q16_acronyms": (_ask("tb", acronyms=forms.parse_pairs("# acronyms\ntb\tthe bridge\n")), f"{_has('tb')} UNION {_pair('the', 'bridge', NEXT)}"),
    "q17_aliases": (_ask("harbor", aliases=[("or$", "our"), ("^harbour$", "island")]), f"{_has('harbor')} UNION {_has('harbour')} UNION {_has('island')}"),
    "q18_accents": (_ask("über", accents=True), f"{_has('über')} UNION {_has('uber')}"),
    "q18_german": (_ask("brücke", german=True), f"{_has('brücke')} UNION {_has('bruecke')}"),
    "q19_all_expansions": (_ask("bridges river tb", "any", morphology=forms.Morphology(forms.parse_dictionary(WORDS_FILE), forms.parse_affixes(AFFIX_FILE)), synonyms=[("river", "harbour")], acronyms=[("tb", "the bridge")], accents=True),
                           f"{_has('bridge')} UNION {_has('bridges')} UNION {_has('river')} UNION {_has('harbour')} UNION {_has('tb')} UNION {_pair('the', 'bridge', NEXT)}"),
}
for _name, (_query, _sql) in _SQL.items():
    R.add(_name, _query, f"WITH {POST} SELECT DISTINCT doc_id FROM ({_sql})")

_LOOSE = rf"""WITH {ITEMS}, tok AS (SELECT *, regexp_extract_all(lower(text), '[^\s]*[\p{{L}}\p{{N}}][^\s]*') AS w FROM items),
based AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY section, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM tok),
loose AS (SELECT doc_id, section, CAST(base + i AS INT) AS pos, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM based) WHERE length(w[i]) BETWEEN 1 AND 32),
post AS (SELECT * FROM loose UNION ALL SELECT doc_id, section, pos, part AS word FROM (SELECT *, unnest(regexp_extract_all(word, '[\p{{L}}\p{{N}}]+')) AS part FROM loose) WHERE part <> word)"""
R.add("t09_word_parts", lambda s, d: postings.with_parts(postings.postings(items(s, d), token=tx.loose_words)).groupBy("word").agg(F.count("*").alias("hits")), f"{_LOOSE} SELECT word, count(*) AS hits FROM post GROUP BY 1")
R.add("q20_word_or_parts", _ask("well-known the.river", "any", loose=True),
      f"{_LOOSE} SELECT DISTINCT doc_id FROM ({_has('well-known')} UNION {_has('the.river')} UNION {_pair('well', 'known', NEXT)} UNION {_pair('the', 'river', NEXT)})")
R.add("a10_term_counts", lambda s, d: maintenance.term_counts(index(s, d), ["bridge", "river", "archive"]),
      f"WITH {POST} SELECT word, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM post WHERE word IN ('bridge', 'river', 'archive') GROUP BY 1")
R.add("j03_with_anchor_hits", lambda s, d: index(s, d).filter("word = 'bridge'").select("doc_id", "word").unionByName(_anchors(s, d).filter("word = 'bridge'").select("doc_id", "word")).groupBy("doc_id").agg(F.count("*").alias("hits")),
      rf"""WITH {POST} SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, word FROM post UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) FROM (SELECT DISTINCT url_id AS doc_id, sval AS text FROM urlinfo u WHERE {PLAIN} = 'crosswords' AND sval <> '')) WHERE word = 'bridge' GROUP BY 1""")

# --- scores ----------------------------------------------------------------------------------------

TERMS = [("bridge", 0, "query"), ("river", 1, "query")]
_HITS = f"WITH {POST}, h AS (SELECT doc_id, section, pos, CASE word WHEN 'bridge' THEN 0 ELSE 1 END AS ord FROM post WHERE word IN ('bridge', 'river'))"


def _over_sql(v: str, best: float, more: float, less: float) -> str:
    return f"(CASE WHEN {v} > {best} THEN {more} * ({v} - {best}) ELSE {less} * ({best} - {v}) END)"


R.add("a01_full_score", lambda s, d: scoring.full(scoring.hits(index(s, d), TERMS), 2),
      f"""{_HITS},
      w AS (SELECT *, max(CASE WHEN ord = 0 THEN pos END) OVER b AS l0, max(CASE WHEN ord = 1 THEN pos END) OVER b AS l1, row_number() OVER o AS nth,
            lead(ord) OVER o AS lo, lead(pos) OVER o AS lp, lead(section) OVER o AS ls FROM h
            WINDOW o AS (PARTITION BY doc_id ORDER BY pos, ord), b AS (PARTITION BY doc_id ORDER BY pos, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      g AS (SELECT doc_id, count(*) AS hits, sum(pos) AS sp, sum(CASE WHEN nth > 1 THEN pos - coalesce(CASE ord WHEN 0 THEN l1 ELSE l0 END, 0) ELSE 0 END) AS gaps,
            sum(CASE WHEN ord = 0 AND lo = 1 AND lp = pos + 1 AND ls = section THEN 1 ELSE 0 END) AS ph, count(DISTINCT section) AS nsec,
            sum(CASE WHEN ord = 0 THEN 1 ELSE 0 END) AS c0, sum(CASE WHEN ord = 1 THEN 1 ELSE 0 END) AS c1, coalesce(min(CASE WHEN ord = 0 THEN pos END), 0) + coalesce(min(CASE WHEN ord = 1 THEN pos END), 0) AS f FROM w GROUP BY 1),
      k AS (SELECT *, hits + 2 AS n, (CASE WHEN c0 > 0 THEN 48 ELSE 0 END + CASE WHEN c1 > 0 THEN 48 ELSE 0 END) * nsec AS xy, (hits + 2) // 2 AS med FROM g),
      u AS (SELECT *, (abs(c0 - med) + abs(c1 - med)) * 30 // 2 // (med + 1) AS uni FROM k)
      SELECT doc_id, hits, CAST(floor(100000.0 * (CAST(xy AS DOUBLE) * (n - 1) / n) / (63.0 * 2 * 24 + 2 * (CASE WHEN ph = 0 THEN 10000 ELSE 100 // (2 * ph) END)
        + {_over_sql('n', 60, 3.5, 70.5)} + (CASE WHEN uni > 10 THEN 2000.0 ELSE 20.0 END) * uni + {_over_sql('((800 + sp) // n)', 390, 1.5, 0.31)} + {_over_sql('f', 13, 1.5, 0.31)} + {_over_sql('((450 + gaps) // n)', 20, 25.0, 1.0)}) + 1) AS BIGINT) AS score FROM u""")  # fmt: skip
_GAPS = f"""{_HITS},
      w AS (SELECT *, lag(pos) OVER o AS pp, lag(ord) OVER o AS po FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY pos, ord)),
      g AS (SELECT doc_id, count(*) AS hits, sum(coalesce(pos - pp + CASE WHEN po <> (ord + 1) % 2 AND ord <> (po + 1) % 2 THEN 16 ELSE 0 END, 0)) AS gaps, min(pos) AS f,
            sum(CASE WHEN ord = 0 THEN 1 ELSE 0 END) AS c0, sum(CASE WHEN ord = 1 THEN 1 ELSE 0 END) AS c1, count(DISTINCT section) AS nsec,
            bit_or(CASE WHEN ord = 0 THEN (1 << (4 + 4 * ((section - 1) % 6))) | 14 ELSE 0 END) AS m0, bit_or(CASE WHEN ord = 1 THEN (1 << (4 + 4 * ((section - 1) % 6))) | 14 ELSE 0 END) AS m1 FROM w GROUP BY 1),
      u AS (SELECT *, (CASE WHEN c0 > 0 THEN abs(c0 - hits // 2) ELSE 2000 END) + (CASE WHEN c1 > 0 THEN abs(c1 - hits // 2) ELSE 2000 END) AS uni FROM g)"""
_LAST = f"{_over_sql('f', 390, 1.5, 0.31)} + {_over_sql('((450 + gaps) // hits)', 20, 25.0, 1.0)}"
R.add("a01_fast_score", lambda s, d: scoring.fast(scoring.hits(index(s, d), TERMS), 2),
      f"""{_GAPS}, v AS (SELECT *, bit_count(xor(CAST(m0 AS BIGINT), CAST(17895711 AS BIGINT))) + bit_count(xor(CAST(m1 AS BIGINT), CAST(17895711 AS BIGINT))) AS xy FROM u)
      SELECT doc_id, hits, CAST(CASE WHEN xy >= 20 THEN 1 ELSE floor(100000.0 * (20 - xy) / (20 + {_over_sql('hits', 60, 3.5, 70.5)} + 2000.0 * uni + {_LAST}) + 1) END AS BIGINT) AS score FROM v""")  # fmt: skip
R.add("a01_ultra_score", lambda s, d: scoring.ultra(scoring.hits(index(s, d), TERMS), 2),
      f"""{_GAPS} SELECT doc_id, hits, CAST(floor(100000.0 * (CAST(hits AS DOUBLE) / (hits * 15) * 1984 / 2032 * ((CASE WHEN c0 > 0 THEN 1984 ELSE 0 END) + (CASE WHEN c1 > 0 THEN 1984 ELSE 0 END)) / 3968 * (1 + nsec) / 24)
        / (1 + ln(1 + 3.5 * (abs(c0 - 30) + abs(c1 - 30)) + 2000.0 * uni + {_LAST})) + 1) AS BIGINT) AS score FROM u""")  # fmt: skip

QUERIES, SQL = R.queries, R.sql

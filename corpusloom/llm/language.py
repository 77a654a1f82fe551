"""Languages of documents and of their stretches, by rank-order profiles of character trigrams.

A profile is a language's most frequent trigrams (of the folded letters, words bounded by blanks) by rank. A line's own trigrams
are ranked by frequency, ties sharing their mean rank, and compared with each profile by out-of-place distance: the sum of
the rank differences, where a trigram that the profile lacks counts the most. Neighbouring lines of one language form
a stretch. The confidence is the lead of the nearest profile over the next one, from 0 to 1.

Profiles are trained here, from a bounded sample of the texts themselves: lines are first told by the common words of the
languages, then by the profiles made of them, so wrong labels do no harm. Everything else covers all texts.

Work is done on arrays of code points, a chunk of texts at a time.

Cases: null, empty and letterless texts have no language; lines with too few words have none of their own and join the
stretch around them; a line that no profile is near to (garbled or of another language) has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Trigrams in a profile, texts in the training sample, characters worked on at once.
PROFILE, SAMPLE, CHUNK = 1000, 3000, 500_000
#: Words that make a line running text, and the greatest mean distance (as a share of the greatest possible) of a line from its language.
WORDS, FAR = 5, 0.5
#: Lead of the nearest profile that a line needs.
LEAD = 0.45
#: At most so many languages.
MAX_LANGUAGES = 64
#: The common words of all languages are held by the driver, at most so many.
MAX_COMMON = 100_000

# Three-letter codes of ISO 639, in the order of the two-letter ones (two where the bibliographic code differs).
_THREE = """
ar ara, az aze, be bel, bg bul, bn ben, bs bos, ca cat, cs ces cze, cy cym wel, da dan, de deu ger, el ell gre, en eng, eo epo, es spa, et est, eu eus baq, fa fas per, fi fin, fr fra fre, ga gle, gl glg, he heb, hi hin,
hr hrv, hu hun, hy hye arm, id ind, is isl ice, it ita, ja jpn, ka kat geo, kk kaz, ko kor, la lat, lt lit, lv lav, mk mkd mac, mn mon, ms msa may, mt mlt, nb nob, nl nld dut, nn nno, no nor, pl pol, pt por, ro ron rum,
ru rus, sk slk slo, sl slv, sq sqi alb, sr srp, sv swe, sw swa, th tha, tr tur, uk ukr, ur urd, uz uzb, vi vie, zh zho chi
"""
# Names of languages in these languages that the names of locales lack.
_NAMES = {
    "de": "deutsch", "fr": "français francais", "es": "español espanol castellano", "it": "italiano", "pl": "polski", "ru": "русский", "nl": "nederlands", "pt": "português portugues", "cs": "čeština cesky", "uk": "українська ukrainian",
    "sv": "svenska", "da": "dansk", "fi": "suomi", "hu": "magyar", "ro": "română", "tr": "türkçe", "el": "ελληνικά", "bg": "български", "ja": "日本語", "zh": "中文 chinese", "ko": "한국어", "ar": "العربية arabic", "he": "עברית",
}


def _codes() -> dict[str, str]:
    """Two-letter codes by what a label may write: the code, three-letter codes, and names (those of the system's locales, in English, and the languages' own)."""
    import locale

    two = {row.split()[0]: row.split() for row in _THREE.replace("\n", " ").split(",")}
    out = {name.lower(): code[:2] for name, code in locale.locale_alias.items() if name.isalpha() and len(name) > 3 and code[:2] in two and code[2:3] == "_"}
    out |= {name: code for code, names in _NAMES.items() for name in names.split()}
    return out | {name: code for code, names in two.items() for name in names}


CODES = _codes()

_LETTERS = 1 << 7


def _alphabet() -> np.ndarray:
    """A class below 128 for each code point below 0x10000: 0 no letter; Latin and Cyrillic letters, folded; 127 other letters."""
    table = np.zeros(0x10000, np.int64)
    common = "abcdefghijklmnopqrstuvwxyzабвгдеёжзийклмнопрстуфхцчшщъыьэюяäöüßàâçéèêëîïôùûœæáíóúñìòąćęłńóśźż"
    number = {c: i + 1 for i, c in enumerate(dict.fromkeys(common))}
    for i in range(0x10000):
        c = chr(i)
        if 0xD800 <= i < 0xE000 or not c.isalpha():
            continue
        low = c.lower()
        table[i] = number.get(low if len(low) == 1 else c, 127)
    return table


_TABLE = _alphabet()


@dataclass
class Lines:
    """Trigrams of the lines of some texts: for each distinct trigram of a line its line, code and count; for each line its text, number in it and words."""

    line: np.ndarray
    code: np.ndarray
    count: np.ndarray
    text: np.ndarray
    number: np.ndarray
    words: np.ndarray


def trigrams(texts: list[str]) -> Lines:
    """The trigrams of all lines of the texts (split at line feeds, empty lines included)."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])[:-1] - 1  # the line feeds between texts
    feed = points == 10
    line = np.cumsum(feed) - feed
    between = np.zeros(len(points), bool)
    between[ends] = True
    own = np.r_[0, np.cumsum(between)[np.flatnonzero(feed)]] if len(points) else np.zeros(1, int)
    n = len(own)
    starts = np.searchsorted(own, np.arange(len(texts)))
    number = np.arange(n) - starts[own]
    c = _TABLE[np.minimum(points, 0xFFFF)]
    c = np.r_[0, c, 0]
    line = np.r_[line[:1] if n and len(line) else 0, line, n - 1]
    begins = (c[1:] > 0) & (c[:-1] == 0)
    words = np.bincount(line[1:][begins], minlength=n)
    a, b, d = c[:-2], c[1:-1], c[2:]
    m = b > 0
    code = (a * _LETTERS + b) * _LETTERS + d
    key = (line[1:-1][m] << 21) + code[m]
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    return Lines(key >> 21, key & ((1 << 21) - 1), count, own, number, words)


def mean_ranks(group: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The rank of each row in its group by falling count; equal counts share their mean rank. Rows are sorted by group."""
    order = np.lexsort((-count, group))
    g, c = group[order], count[order]
    new_group = np.r_[True, g[1:] != g[:-1]]
    start = np.maximum.accumulate(np.where(new_group, np.arange(len(g)), 0))
    new = new_group | np.r_[True, c[1:] != c[:-1]]
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, len(g)])
    mean = np.repeat(at + (size - 1) / 2, size) - start
    out = np.empty(len(g), np.float32)
    out[order] = mean
    return out


@dataclass
class Profiles:
    """ranks[code, k]: the rank of a trigram in language k, PROFILE where the profile lacks it."""

    languages: list[str]
    ranks: np.ndarray

    def distances(self, t: Lines) -> np.ndarray:
        """Mean out-of-place distance of each line from each language, as a share of the greatest one."""
        n, k = len(t.text), len(self.languages)
        out = np.zeros((n, k), np.float32)
        if len(t.line):
            own = np.minimum(mean_ranks(t.line, t.count), PROFILE - 1)
            # A short line's ranks are spread over the profile's length, so that they compare with those of a long one.
            sizes = np.bincount(t.line, minlength=n)
            scaled = own * (PROFILE / np.maximum(sizes, 1))[t.line] * 0.25
            total = np.bincount(t.line, t.count, n)
            for j in range(k):
                r = self.ranks[t.code, j]
                off = np.where(r >= PROFILE, PROFILE, np.minimum(np.abs(r - scaled), PROFILE))
                out[:, j] = np.bincount(t.line, off * t.count, n) / np.maximum(total, 1) / PROFILE
        out[np.bincount(t.line, minlength=n) == 0] = 1
        return out

    def classify(self, t: Lines) -> tuple[np.ndarray, np.ndarray]:
        """For each line its language (-1: none) and the confidence."""
        d = self.distances(t)
        if not d.shape[1]:
            return np.full(len(d), -1), np.zeros(len(d), np.float32)
        best = d.argmin(1)
        near = d.min(1)
        rest = d.copy()
        rest[np.arange(len(d)), best] = np.inf
        second = np.minimum(rest.min(1), 1) if d.shape[1] > 1 else np.ones(len(d), np.float32)
        lead = (second - near) / np.maximum(second, 1e-6)
        best[(near > FAR) | (lead < LEAD)] = -1
        return best, np.clip(lead, 0, 1)


def _profile(code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Ranks by trigram code of the most frequent trigrams; those of equal counts by code."""
    total = np.bincount(code, count, 1 << 21)
    top = np.argsort(-total, kind="stable")[:PROFILE]
    top = top[total[top] > 0]
    ranks = np.full(1 << 21, PROFILE, np.int16)
    ranks[top] = np.arange(len(top))
    return ranks


def train(texts: list[str], common: dict[str, list[str]], rounds: int = 2) -> Profiles:
    """Profiles of the languages of the common words. Lines with common words of one language only begin; rounds of telling lines by profiles follow."""
    languages = sorted(common)
    of: dict[str, int] = {}
    for k, lang in enumerate(languages):
        for w in common[lang]:
            of[w.lower()] = of.get(w.lower(), 0) | 1 << k
    word = re.compile(r"[^\W\d_]+")
    lines = [x for t in texts for x in t.split("\n") if len(x) > 20]
    labels = np.full(len(lines), -1)
    for i, x in enumerate(lines):
        hits = np.zeros(len(languages), int)
        for w in word.findall(x.lower()):
            if bits := of.get(w):
                for k in range(len(languages)):
                    hits[k] += bits >> k & 1
        if len(languages) and hits.max(initial=0) >= 2 and (hits == hits.max()).sum() == 1:
            labels[i] = hits.argmax()
    t = trigrams(lines) if lines else None
    seed = {k: trigrams([" ".join(common[lang]).lower()]) for k, lang in enumerate(languages)}
    ranks = np.full((1 << 21, len(languages)), PROFILE, np.int16)
    for turn in range(rounds + 1):  # the last turn makes the profiles, the others also tell the lines anew
        for k in range(len(languages)):
            mine = labels[t.line] == k if t is not None else np.zeros(0, bool)
            # The common words themselves are behind the lines: they are all there is where no line has been told yet.
            code, count = (np.r_[t.code[mine], seed[k].code], np.r_[t.count[mine], seed[k].count]) if t is not None else (seed[k].code, seed[k].count)
            ranks[:, k] = _profile(code, count)
        if t is None or turn == rounds:
            break
        best, _ = Profiles(languages, ranks).classify(t)
        labels = np.where(t.words >= WORDS, best, -1)
    return Profiles(languages, ranks)


def train_from(texts: DataFrame, stopwords: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from at most `sample` texts (id, text), those with the least hashes of id, and from common words (lang, word)."""
    known = texts.filter("id is not null")
    # Each task would send its own `sample` least hashes to the driver; of many rows only those below a bound can be among the least.
    bound = min(1.0, 2 * sample / max(1, known.select("id").count()))
    low = F.xxhash64("id") <= F.lit(min(2**63 - 1, int(bound * 2**64) - 2**63))
    rows = known.filter(low & F.col("text").isNotNull()).orderBy(F.xxhash64("id"), "id").select("text").limit(sample).collect()
    words: dict[str, list[str]] = {}
    n = 0
    for r in stopwords.filter("lang is not null and word is not null").select("lang", "word").distinct().orderBy("lang", "word").limit(MAX_COMMON + 1).collect():
        words.setdefault(r.lang.lower(), []).append(r.word)
        n += 1
    if n > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    if len(words) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return train([r.text for r in rows], words)


def stretches(texts: DataFrame, profiles: Profiles) -> DataFrame:
    """(id, stretch, first_line, last_line, lang, confidence, words, whole) of texts (id, text).

    Lines of running text have the language of the nearest profile; a stretch is a run of lines of one language and the lines
    without one behind it. whole: the number of lines of running text in it. The lines before the first one belong to the first stretch.
    """
    schema = T.StructType([texts.schema["id"], *(T.StructField(n, T.IntegerType()) for n in ("stretch", "first_line", "last_line")), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("words", T.IntegerType()), T.StructField("whole", T.IntegerType())])
    shared = texts.sparkSession.sparkContext.broadcast(profiles)  # bounded by the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        names = np.array([*p.languages, None], object)
        for batch in batches:
            for at, own in _chunks(batch.column(1).to_pylist()):
                t = trigrams(own)
                lang, sure = p.classify(t)
                whole = (lang >= 0) & (t.words >= WORDS)
                lang = np.where(whole, lang, -1)
                n = len(lang)
                start = np.r_[True, t.text[1:] != t.text[:-1]]
                # Lines without a language take that of the last one with one in their text, else of the next one.
                seen = np.where(whole, np.arange(n), -1)
                begin = np.maximum.accumulate(np.where(start, np.arange(n), 0))
                last = np.maximum.accumulate(seen)
                filled = np.where((last >= begin) & (last >= 0), lang[np.maximum(last, 0)], -1)
                end = np.r_[np.flatnonzero(start)[1:], n]
                stop = end[np.cumsum(start) - 1]
                nxt = np.minimum.accumulate(np.where(whole, np.arange(n), n)[::-1])[::-1]
                filled = np.where((filled < 0) & (nxt < stop), lang[np.minimum(nxt, n - 1)], filled)
                cut = start | np.r_[True, filled[1:] != filled[:-1]]
                first = np.flatnonzero(cut)
                final = np.r_[first[1:], n] - 1
                run_of = np.cumsum(cut) - 1
                weight = np.bincount(run_of, t.words * whole)
                conf = np.bincount(run_of, t.words * whole * sure) / np.maximum(weight, 1)
                text = t.text[first]
                index = np.arange(len(first)) - np.searchsorted(text, text)
                ids = batch.column(0).take(pa.array([at[i] for i in text.tolist()]))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(index.astype(np.int32)), pa.array(t.number[first].astype(np.int32)), pa.array(t.number[final].astype(np.int32)),
                    pa.array(names[filled[first]].tolist(), pa.string()), pa.array(np.round(conf, 6)), pa.array(np.bincount(run_of, t.words).astype(np.int32)), pa.array(np.bincount(run_of, whole).astype(np.int32)),
                ], names=schema.names)

    return texts.select("id", "text").mapInArrow(run, schema)


def _chunks(texts: list) -> Iterator[tuple[list[int], list[str]]]:
    at, size = [], 0
    for i, t in enumerate(texts):
        if t:
            at.append(i)
            size += len(t) + 1
            if size > CHUNK:
                yield at, [texts[i] for i in at]
                at, size = [], 0
    if at:
        yield at, [texts[i] for i in at]


def documents(parts: DataFrame) -> DataFrame:
    """(id, lang, confidence, languages) of stretches: each text's language with most words of running text, and all its languages."""
    by = parts.filter("lang is not null and whole > 0").groupBy("id", "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.greatest(F.sum("words"), F.lit(1))).alias("c"))
    best = by.groupBy("id").agg(F.max(F.struct("words", "c", "lang")).alias("b"), F.sum("words").alias("words"), F.sort_array(F.collect_set("lang")).alias("languages"))
    return best.select("id", F.col("b.lang").alias("lang"), F.round(F.col("b.c") * F.col("b.words") / F.greatest("words", F.lit(1)), 6).alias("confidence"), "languages")


def named_languages(label: Column) -> Column:
    """The two-letter codes that a label names, as an array: codes with or without a region, three-letter codes, names; null for a null label."""
    lookup = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    parts = F.split(F.lower(label), r"[,;/|\s]+")
    # A two-letter code that the table lacks names itself.
    codes = F.transform(F.transform(parts, lambda p: F.regexp_replace(p, r"^([^-_]*)[-_].*$", "$1")), lambda p: F.coalesce(lookup[p], F.when(p.rlike("^[a-z]{2}$"), p)))
    return F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))


def missing_labels(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, lang): languages of at least one whole line of running text that no label (id, label) of the text names."""
    held = parts.filter("lang is not null and whole > 0").select("id", "lang").distinct()
    given = labels.select("id", F.explode(named_languages(F.col("label"))).alias("lang")).distinct()
    return held.join(given, ["id", "lang"], "left_anti")

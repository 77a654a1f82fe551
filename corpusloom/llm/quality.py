"""Per-document text statistics, and an ordered rule list that tells prose from lists, tables and junk.

All statistics of a text come from one pass over arrays of code points, a chunk of texts at a time. The rules are induced
by incremental reduced-error pruning: rules are grown for one kind after another, each pruned at once on documents held
back, until a rule no longer holds. Learned thresholds are exported as one SQL CASE expression over the statistics.

The labels for training are given by hand for the documents of `quality_seeds.py`, which cover the forms of a bounded sample;
the sample's other documents take the label that most of their nearest seeds have, by all statistics (`spread_labels`).
`python -m corpusloom.llm.quality_seeds DIRECTORY` makes the rules anew from the tables in a directory (documents, stopwords).

Cases: null, empty and blank texts have zero counts, null shares and no kind; a text of any length is taken whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the induced rules lie; train writes them.
RULES = Path(__file__).with_name("quality_rules.json")
#: At most so many labelled documents are used for training.
TRAINING_ROWS = 20_000
#: Common words are taken from a table of at most so many.
MAX_COMMON = 20_000
#: In this order kinds are learned; what no rule covers is prose.
KINDS = ["junk", "table", "list"]

#: Each statistic with the counts it is made of: a share of two counts, rounded to six decimals, or a count.
SHARES = {
    "mean_word_length": ("letters", "n_words"), "symbol_ratio": ("signs", "visible"), "digit_ratio": ("digits", "visible"), "strange_ratio": ("strange", "visible"),
    "ended_lines": ("ended", "n_lines"), "wordy_lines": ("wordy", "n_lines"), "sentences_per_line": ("sentences", "n_lines"), "fielded_lines": ("fielded", "n_lines"), "marked_lines": ("marked", "n_lines"),
    "tokens_per_line": ("tokens", "n_lines"), "common_words": ("n_common", "n_words"), "distinct_share": ("n_distinct", "n_words"), "coded_share": ("coded", "visible"), "hex_share": ("hex", "tokens"), "markup_share": ("markup", "visible"),
}
COUNTS = {"chars": "n_chars", "lines": "n_lines", "words": "n_words", "distinct_words": "n_distinct"}
STATISTICS = [*COUNTS, *SHARES]


#: Characters worked on at once, and nearest seeds that label a document of the sample.
CHUNK, NEAREST = 500_000, 3
#: How often a text of known prose written by hand counts in training.
WRITTEN = 2
LETTER, DIGIT, SPACE, LINE, STRANGE, STOP, CLOSING, CODED, HEX, MARK = (1 << k for k in range(10))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Flags and small letters by code point below 0x10000."""
    flags, low = np.zeros(0x10000, np.int32), np.arange(0x10000, dtype=np.uint64)
    for i in range(0x10000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        kind = unicodedata.category(c)[0]
        small = c.lower()
        if len(small) == 1:
            low[i] = ord(small)
        flags[i] = LETTER * (kind == "L") | DIGIT * (kind == "N") | SPACE * c.isspace()
    for chars, flag in (("\n\r\x85\u2028\u2029", LINE), (".!?…:", STOP), ("'\"”»’)", CLOSING), ("-*•+·–#", MARK), ("+/=", CODED)):
        for c in chars:
            flags[ord(c)] |= flag
    for c in (*range(9), 0xB, *range(0xE, 0x1C), *range(0x7F, 0x85), *range(0x86, 0xA0), 0xFFFD):
        flags[c] |= STRANGE
    for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        flags[ord(c)] |= CODED | HEX * (c.lower() in "0123456789abcdef")
    return flags, low


def word_hash(words: list[str]) -> np.ndarray:
    """The hashes of words as `measure` has them."""
    m = _Text(words)
    return m.hashes


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where the flag is set."""
    edge = np.diff(np.r_[0, flag.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class _Text:
    """Texts joined by line feeds, as code points with their flags, words, tokens and lines."""

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        flags, low = _tables()
        plane = np.minimum(self.points, 0xFFFF)
        self.f = flags[plane]
        for c in np.unique(self.points[self.points > 0xFFFF]).tolist():
            kind = unicodedata.category(chr(c))[0]
            self.f[self.points == c] = LETTER * (kind == "L") | DIGIT * (kind == "N")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.ends = np.cumsum(sizes) - 1  # of each text
        self.starts = self.ends + 1 - sizes
        self.n = len(texts)
        self.text_of = np.repeat(np.arange(self.n), sizes)
        self.word, self.word_end = _runs(self.has(LETTER | DIGIT))
        powers = np.multiply.accumulate(np.full(len(self.points) + 1, _BASE, np.uint64))
        letters = np.where(self.points > 0xFFFF, self.points, low[plane]).astype(np.uint64) + np.uint64(1)
        sums = np.r_[np.uint64(0), np.cumsum(letters * powers[:-1], dtype=np.uint64)]
        back = np.multiply.accumulate(np.full(len(self.points) + 1, _INVERSE, np.uint64))
        h = (sums[self.word_end] - sums[self.word]) * back[self.word]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.hashes = h ^ (h >> np.uint64(32))

    def has(self, flag: int) -> np.ndarray:
        return (self.f & flag) != 0

    def count(self, flag: np.ndarray) -> np.ndarray:
        """How many characters of each text have the flag."""
        sums = np.r_[0, np.cumsum(flag)]
        return sums[self.ends] - sums[self.starts]

    def at(self, places: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """How many of the places lie in each text, or the sum of their weights."""
        return np.bincount(self.text_of[places], weight, self.n).astype(np.int64)


def measure(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """The counts that STATISTICS are made of, one value a text. common: sorted hashes of the common words."""
    t = _Text(texts)
    p, n = t.points, len(t.points)
    space = t.has(SPACE)
    visible = ~space
    token, token_end = _runs(visible)
    line_of = np.cumsum(t.has(LINE)) - t.has(LINE)
    lines = int(line_of[-1]) + 1 if n else 0
    begin = np.searchsorted(line_of, np.arange(lines))
    stop = np.r_[begin[1:], n] - 1
    seen = np.bincount(line_of[visible], minlength=lines) > 0
    per = lambda places, weight=None: np.bincount(line_of[places], weight, lines)
    following = np.r_[visible[1:], False]
    # The last sign of a line that is no closing one, and the first sign of a line.
    last = np.maximum.accumulate(np.where(visible & ~t.has(CLOSING), np.arange(n), -1))[stop]
    ended = seen & (last >= begin) & t.has(STOP)[np.maximum(last, 0)]
    first = np.minimum.accumulate(np.where(visible, np.arange(n), n)[::-1])[::-1][np.minimum(begin, n - 1)]
    first = np.minimum(first, n - 1)
    # Enumerated: a sign of lists, or a number or letter with a point or bracket, and a blank.
    opened = np.minimum(first + (p[first] == ord("(")), n - 1)
    end_of = np.zeros(n + 1, np.int64)
    end_of[t.word] = t.word_end
    after = np.minimum(end_of[opened], n - 1)
    size = after - opened
    short = (size == 1) & t.has(LETTER)[opened] | (size >= 1) & (size <= 3) & t.has(DIGIT)[opened] & t.has(DIGIT)[np.maximum(after - 1, 0)]
    numbered = short & np.isin(p[after], [ord("."), ord(")")]) & space[np.minimum(after + 1, n - 1)]
    marked = seen & (t.has(MARK)[first] & space[np.minimum(first + 1, n - 1)] | numbered)
    # Fields: separators that stand at least twice in a line.
    is_ = lambda c: p == ord(c)
    gap_end = np.r_[False, False, space[:-2] & space[1:-1] & visible[2:]] if n > 2 else np.zeros(n, bool)
    places = np.flatnonzero(gap_end)
    gap_end = places[places > first[line_of[places]]]
    digits = np.r_[0, np.cumsum(t.has(DIGIT))]
    tokens_in = per(token)
    numbers_in = per(token[digits[token_end] > digits[token]])
    ruled = np.isin(p, [ord(c) for c in "+|=-"])
    border = (per(np.flatnonzero(ruled)) >= 3) & (per(np.flatnonzero(visible & ~ruled)) == 0) & (per(np.flatnonzero(is_("|") | is_("+"))) > 0)
    fielded = per(np.flatnonzero(is_("\t") & following)) >= 2
    fielded |= per(np.flatnonzero(is_("|"))) >= 2
    for c in ";,":
        fielded |= per(np.flatnonzero(is_(c) & following)) >= 2
    fielded |= (per(gap_end) >= 2) | (numbers_in >= 3) & (tokens_in >= 4) & (numbers_in >= 0.6 * tokens_in) | border
    owner = t.text_of[begin] if lines else np.zeros(0, int)
    by_line = lambda m: np.bincount(owner[m & seen], minlength=t.n)
    # Markup: tags, entities, braces and double strokes.
    tag = np.flatnonzero(is_("<") | is_(">"))
    pair = np.flatnonzero(is_("<")[tag[:-1]] & is_(">")[tag[1:]] & (np.diff(tag) <= 41) & (line_of[tag[:-1]] == line_of[tag[1:]]))
    entity = np.flatnonzero(is_("&") | is_(";"))
    names = np.flatnonzero(is_("&")[entity[:-1]] & is_(";")[entity[1:]] & (np.diff(entity) <= 10) & (np.diff(entity) > 1))
    strokes = np.flatnonzero(is_("/") & np.r_[is_("/")[1:], False])
    markup = t.at(tag[pair], np.diff(tag)[pair] + 1) + t.at(entity[names], np.diff(entity)[names] + 1) + t.count(is_("{") | is_("}")) + 2 * t.at(strokes)
    code, code_end = _runs(t.has(CODED))
    long = code_end - code >= 24
    hexed = np.r_[0, np.cumsum(t.has(HEX))]
    pairs = (token_end - token == 2) & (hexed[token_end] - hexed[token] == 2)
    stop_sign = t.has(STOP) & ~is_(":")
    behind = np.r_[space[1:], True]
    sentence = stop_sign & (behind | np.r_[t.has(CLOSING)[1:], False] & np.r_[behind[1:], True])
    words_of = t.text_of[t.word]
    known = np.zeros(len(t.word), bool)
    if len(common):
        known = common[np.minimum(np.searchsorted(common, t.hashes), len(common) - 1)] == t.hashes
    different = np.unique(t.hashes ^ (words_of.astype(np.uint64) * _BASE), return_index=True)[1]
    letters, numbers, shown = t.count(t.has(LETTER)), t.count(t.has(DIGIT)), t.count(visible)
    return {
        "n_chars": t.ends - t.starts - t.count(is_("\r") & np.r_[is_("\n")[1:], False]), "visible": shown, "letters": letters, "digits": numbers, "signs": shown - letters - numbers, "strange": t.count(t.has(STRANGE)),
        "n_lines": by_line(seen), "tokens": t.at(token), "ended": by_line(ended), "wordy": by_line(tokens_in >= 6), "sentences": t.count(sentence), "fielded": by_line(fielded), "marked": by_line(marked),
        "coded": t.at(code[long], (code_end - code)[long]), "hex": t.at(token[pairs]), "markup": markup,
        "n_words": t.at(t.word), "n_distinct": np.bincount(words_of[different], minlength=t.n), "n_common": np.bincount(words_of[known], minlength=t.n),
    }


def statistics(df: DataFrame, common: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row (key, STATISTICS) for each row of df."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *[T.StructField(n, T.LongType() if n in COUNTS else T.DoubleType()) for n in STATISTICS]])
    shared = df.sparkSession.sparkContext.broadcast(np.sort(word_hash(common)) if common else np.zeros(0, np.uint64))  # at most MAX_COMMON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            start = size = 0
            for i, x in enumerate(texts):
                size += len(x)
                if size > CHUNK or i + 1 == len(texts):
                    c = measure(texts[start : i + 1], shared.value)
                    out = [b.column(0).slice(start, i + 1 - start)]
                    for name in STATISTICS:
                        if name in COUNTS:
                            out.append(pa.array(c[COUNTS[name]].astype(np.int64)))
                        else:
                            x, y = (c[k].astype(float) for k in SHARES[name])
                            out.append(pa.array(np.round(x / np.maximum(y, 1), 6), mask=y == 0))
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)
                    start, size = i + 1, 0

    return df.select(key, text).mapInArrow(run, schema)


FEATURES = ["lines", "words", "distinct_words", "mean_word_length", "symbol_ratio", "digit_ratio", "strange_ratio", "ended_lines", "wordy_lines", "sentences_per_line", "fielded_lines", "marked_lines", "tokens_per_line", "common_words", "distinct_share", "coded_share", "hex_share", "markup_share"]


@dataclass(frozen=True)
class Condition:
    """feature <= at, or feature > at."""

    feature: str
    above: bool
    at: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.at if self.above else v <= self.at

    def sql(self) -> str:
        return f"coalesce({self.feature}, 0) {'>' if self.above else '<='} {self.at:.6g}"


Rule = tuple[str, list[Condition]]


def _covers(conditions: list[Condition], x: np.ndarray) -> np.ndarray:
    m = np.ones(len(x), bool)
    for c in conditions:
        m &= c.holds(x)
    return m


def _grow(x: np.ndarray, y: np.ndarray) -> list[Condition]:
    """Conditions added by information gain until no negative is covered."""
    out: list[Condition] = []
    inside = np.ones(len(x), bool)
    while True:
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        if not n or not p:
            return out
        best, gain, base = None, 1e-9, np.log2(p / (p + n))
        for j, name in enumerate(FEATURES):
            v, t = x[inside, j], y[inside]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            cut = np.flatnonzero(v[1:] != v[:-1])
            if not len(cut):
                continue
            low_p = np.cumsum(t)[cut]
            low_n = cut + 1 - low_p
            for above, pp, nn in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1)
                k = int(np.argmax(g))
                if g[k] > gain:
                    gain, best = g[k], Condition(name, above, float(f"{(v[cut[k]] + v[cut[k] + 1]) / 2:.6g}"))
        if best is None:
            return out
        out.append(best)
        inside &= best.holds(x)


def _prune(rule: list[Condition], x: np.ndarray, y: np.ndarray) -> tuple[list[Condition], float]:
    """The rule without the last conditions that do not help on held-back documents, and its worth there."""
    def worth(r: list[Condition]) -> float:
        m = _covers(r, x)
        p, n = int(y[m].sum()), int((~y[m]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best, value = rule, worth(rule)
    for k in range(len(rule) - 1, 0, -1):
        if (w := worth(rule[:k])) >= value:
            best, value = rule[:k], w
    return best, value


def induce(x: np.ndarray, kinds: np.ndarray, seed: int = 7, least: float = 0.8, tries: int = 8) -> list[Rule]:
    """An ordered rule list. x: documents by FEATURES; kinds: their labels; least: worth a pruned rule must have; tries: splits without such a rule before a kind ends."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    for kind in KINDS:
        failed = 0
        while (kinds[left] == kind).any() and failed < tries:
            at = rng.permutation(np.flatnonzero(left))
            y = kinds[at] == kind
            grow = np.zeros(len(at), bool)  # two thirds of either side
            for side in (True, False):
                own = np.flatnonzero(y == side)
                grow[own[: -(-2 * len(own) // 3)]] = True
            rule = _grow(x[at[grow]], y[grow])
            worth = -1.0
            if rule:
                rule, worth = _prune(rule, x[at[~grow]], y[~grow])
                covered = _covers(rule, x) & left
            if not rule or worth < least or not (kinds[covered] == kind).any():
                failed += 1  # another split may give one that holds
                continue
            failed = 0
            rules.append((kind, rule))
            left &= ~covered
    return rules


def case_sql(rules: list[Rule]) -> str:
    """The rules as one CASE expression over the statistics; null for prose."""
    if not rules:
        return "CAST(NULL AS STRING)"
    return "CASE WHEN coalesce(words, 0) + coalesce(symbol_ratio, 0) + coalesce(strange_ratio, 0) = 0 THEN NULL " + " ".join(f"WHEN {' AND '.join(c.sql() for c in r)} THEN '{k}'" for k, r in rules) + " END"


def save(rules: list[Rule], path: Path = RULES) -> None:
    path.write_text(json.dumps([{"kind": k, "if": [[c.feature, ">" if c.above else "<=", c.at] for c in r]} for k, r in rules], indent=1) + "\n")


def load(path: Path = RULES) -> list[Rule]:
    return [(r["kind"], [Condition(f, op == ">", at) for f, op, at in r["if"]]) for r in json.loads(path.read_text())]


def common_words(stopwords: DataFrame) -> list[str]:
    """The common words of all languages, from (lang, word)."""
    got = [r.w for r in stopwords.select(F.lower("word").alias("w")).filter("w is not null").distinct().limit(MAX_COMMON + 1).collect()]
    if len(got) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return sorted(got)


def kinds(df: DataFrame, stopwords: DataFrame, rules: list[Rule] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The statistics of each row with its kind: list, table, junk, or null for prose."""
    rules = load() if rules is None else rules
    return statistics(df, common_words(stopwords), text, key).withColumn("kind", F.expr(case_sql(rules)))


def spread_labels(x: np.ndarray, seeds: np.ndarray, labels: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """For each row of x the label that most of its nearest seeds (row numbers) have, by statistics brought to one scale; ties go to the nearest."""
    scaled = np.log1p(np.maximum(x, 0) * np.where(x.max(0) > 1.5, 1, 10))
    scaled = (scaled - scaled.mean(0)) / np.maximum(scaled.std(0), 1e-9)
    own = scaled[seeds]
    out = np.empty(len(x), object)
    for start in range(0, len(x), 1000):
        gap = ((scaled[start : start + 1000, None, :] - own[None]) ** 2).sum(2)
        for i, row in enumerate(np.argsort(gap, 1, kind="stable")[:, :nearest]):
            near = labels[row].tolist()
            out[start + i] = max(near, key=lambda k: (near.count(k), -near.index(k)))
    return out


def train(df: DataFrame, stopwords: DataFrame, seeds: dict[int, str], prose: list[str] = (), rows: int = TRAINING_ROWS, path: Path | None = None) -> list[Rule]:
    """Induce rules from at most `rows` documents (doc_id, text) and those of the seeds (doc_id: kind or prose); save them if a path is given.

    prose: further texts known as prose, each counted WRITTEN times, as the sample has few or none of their form.
    """
    known = df.filter("text is not null").select("doc_id", "text")
    sample = known.orderBy(F.xxhash64("doc_id")).limit(rows).unionByName(known.filter(F.col("doc_id").isin(list(seeds)))).dropDuplicates(["doc_id"])
    stats = statistics(sample, common_words(stopwords)).toPandas().set_index("doc_id").sort_index()
    stats = stats[stats.words + stats.symbol_ratio.fillna(0) + stats.strange_ratio.fillna(0) > 0]
    x = stats[FEATURES].fillna(0).to_numpy(float)
    given = [(k, seeds[i]) for k, i in enumerate(stats.index) if i in seeds]
    names = spread_labels(x, np.array([k for k, _ in given]), np.array([v for _, v in given], object))
    if prose:
        own = statistics(df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(prose)], "doc_id bigint, text string"), common_words(stopwords)).toPandas()[FEATURES].fillna(0).to_numpy(float)
        x, names = np.concatenate([x, np.repeat(own, WRITTEN, 0)]), np.concatenate([names, np.full(WRITTEN * len(own), "prose", object)])
    rules = induce(x, names)
    if path:
        save(rules, path)
    return rules

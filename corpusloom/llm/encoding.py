"""Texts decoded with another encoding than the one they were written in: finding and restoring them.

A swap is a pair (read as, written in). A single-byte swap is a substitution cipher of letters; text written in UTF-8
and read as a single-byte encoding replaces one letter by two or three signs. Which swap a source has suffered from is unknown.

1. Letter bigrams of all texts are counted (one pass; the table is bounded by the alphabet), and once more by groups into
   which sources are hashed. Each group has a model in which its own counts hardly weigh, so damage that fills a source is
   as improbable there as it is elsewhere. Bigrams that are explained as a UTF-8 sequence of a much more frequent letter
   are taken out of the models.
2. Every value with a sign beyond ASCII is scored: the gain in bigram likelihood under each swap, over the words which the
   swap improves (so a value may be affected in part). Every swap is kept whose gain is not hopelessly below the best one.
3. Expectation-maximization over the values that gain, in logarithms: the chance of each swap by source (with the whole
   collection behind it), and so each value's swap.
4. Each source's cipher is then learned by EM of its own from the bigrams of its affected words: the E-step gives each sign
   a distribution over letters from those of its neighbours and the language's bigrams, the M-step the mapping of the sign, for
   which the code pages' table is a prior that enough evidence overrules (`learned_table`).
5. All bad words of a source (those improved, and those no swap improves though their signs are improbable) also go through
   one EM without a trusted table: that finds swaps of pages outside PAGES. Such a cipher takes the place of the known swaps if
   it reads the words better than these by more than its description costs (`unknown_table`).
6. A value is affected if a swap or its source's unknown cipher is likelier than none; it is restored with translate() by the
   learned mapping or by reading the sequences as UTF-8, repeated while it helps (text garbled twice).

Cases: null and empty values are never affected; a value with U+FFFD or C1 control signs is affected, though what U+FFFD
stood for is lost; other improbable texts stay as they are; a null id gives a row with a null id; repeated rows give one place;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import materialize

# Encodings a text may have been read as or written in.
PAGES = ["cp1252", "latin-1", "cp1250", "cp1251", "iso8859-2", "iso8859-5", "iso8859-15", "koi8-r", "cp866", "cp437", "cp850", "cp852", "mac-roman", "mac-cyrillic"]
#: Letters (folded) the model knows; others are one sign. Values are worked on up to so many characters at once.
ALPHABET, CHUNK = 512, 1_000_000
#: Share of a letter's bigrams up to which a sequence that is this letter in UTF-8 is taken as garbled.
GARBLED = 0.05
#: Groups that sources are hashed into, each with a model of the other groups, and the weight of a group in its own model.
GROUPS, OWN = 16, 0.02
#: Rounds of EM, and values that the whole collection counts for in the prior of a source.
ROUNDS, BEHIND = 3, 50.0
#: A swap is left out of a value's list if another one gains so much more that no prior could make up for it (the least prior is exp(-27.6)).
HOPELESS = 60.0
#: Times a text may have been garbled.
TIMES = 3


@lru_cache(None)
def decoded(page: str) -> tuple[str, ...]:
    """The signs of the 256 bytes; bytes without one are C1 controls."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@dataclass(frozen=True)
class Swap:
    """written is 'utf-8' or a page."""

    read: str
    written: str

    @property
    def name(self) -> str:
        return f"{self.written} read as {self.read}"


SWAPS = [Swap(r, "utf-8") for r in PAGES] + [Swap(r, w) for r in PAGES for w in PAGES if r != w and decoded(r) != decoded(w)]
NAMES = [s.name for s in SWAPS]


@lru_cache(None)
def letters() -> tuple[list[str], np.ndarray]:
    """The folded signs of the model (0 is any other), and the class of each code point below 0x10000."""
    signs = {c for p in PAGES for c in decoded(p)} | set("„“”’«»—–…№\ufffd") | set(map(chr, range(0x80, 0xA0)))
    folded = sorted({_fold(c) for c in signs})[: ALPHABET - 1]
    number = {c: i + 1 for i, c in enumerate(folded)}
    table = np.zeros(0x10000, np.int32)
    for c in signs:
        table[ord(c)] = number.get(_fold(c), 0)
    for c in map(chr, range(0x250)):
        table[ord(c)] = number.get(_fold(c), 0)
    return ["", *folded], table


def _fold(c: str) -> str:
    if c.isspace() and c != "\x85":
        return " "
    if c.isdigit() and c.isascii():
        return "0"
    low = c.lower()
    return low if len(low) == 1 else c


def classes(text: str) -> np.ndarray:
    """Classes of the signs of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = letters()[1]
    return table[np.minimum(points, 0xFFFF)]


@lru_cache(None)
def mapping(swap: Swap) -> dict[int, str]:
    """For str.translate: what each sign above ASCII becomes under a single-byte swap."""
    return {ord(a): b for a, b in zip(decoded(swap.read)[128:], decoded(swap.written)[128:]) if a != b}


@lru_cache(None)
def _sign_maps() -> tuple[np.ndarray, np.ndarray]:
    """The number of each code point below 0x10000 (0 is any sign the model does not know), and the classes of the numbers: first as they are, then under each single-byte swap."""
    table = letters()[1]
    signs = sorted({*map(chr, np.flatnonzero(table).tolist()), *(c for p in PAGES for c in decoded(p))})
    number = np.zeros(0x10000, np.int32)
    number[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
    rows = [[0, *(table[ord(mapping(s).get(ord(c), c) if s else c)] for c in signs)] for s in (None, *SWAPS[len(PAGES) :])]
    return number, np.array(rows, np.int32)


@lru_cache(None)
def _lead_and_tail() -> tuple[np.ndarray, np.ndarray]:
    """By code point below 0x10000 a bit for each page: whether the sign starts a UTF-8 sequence read as the page, and whether it goes on with one."""
    lead, tail = np.zeros(0x10000, np.int32), np.zeros(0x10000, np.int32)
    for k, page in enumerate(PAGES):
        for b, c in enumerate(decoded(page)):
            if 0xC2 <= b <= 0xF4:
                lead[ord(c)] |= 1 << k
            elif 0x80 <= b <= 0xBF:
                tail[ord(c)] |= 1 << k
    return lead, tail


@lru_cache(None)
def sequences(read: str) -> re.Pattern:
    """UTF-8 sequences as they look when read as a page."""
    d = decoded(read)
    some = lambda a, b: "[" + "".join(map(re.escape, d[a : b + 1])) + "]"
    tail = some(0x80, 0xBF)
    return re.compile(f"{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{tail}|{some(0xF0, 0xF4)}{tail}{tail}{tail}")


@lru_cache(None)
def _bytes_of(read: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(decoded(read))))}


def read_utf8(text: str, read: str) -> str:
    """The text with its UTF-8 sequences, read as a page, put right."""
    of = _bytes_of(read)

    def right(m: re.Match) -> str:
        try:
            return bytes(of[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return sequences(read).sub(right, text)


@dataclass
class Model:
    """gain[a, b]: log of the bigram's chance over that of an even spread."""

    gain: np.ndarray


def bigram_counts(values: DataFrame, text: str = "sval") -> np.ndarray:
    """Counts of class bigrams over all texts: summed by task, then over at most (number of classes)² rows."""
    return _counts(values.select(F.lit(0).alias("group"), text), 1)[0]


def group_counts(held: DataFrame, text: str = "sval") -> np.ndarray:
    """The counts of each group of sources (group, text), of bigrams with a sign beyond ASCII."""
    counts = _counts(held.select("group", text), GROUPS)
    ascii_ = _ascii()
    counts[:, np.ix_(ascii_, ascii_)[0], np.ix_(ascii_, ascii_)[1]] = 0
    return counts


def _ascii() -> np.ndarray:
    return np.array([bool(s) and s.isascii() for s in letters()[0]])


def _counts(rows: DataFrame, groups: int) -> np.ndarray:
    n = len(letters()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, n * n), np.int64)
        for b in batches:
            group = np.asarray(b.column(0))
            for g in np.unique(group):
                for _, joined, _ in _joined(b.column(1).filter(pa.array(group == g)).to_pylist()):
                    c = classes(joined).astype(np.int64)
                    total[g] += np.bincount(c[:-1] * n + c[1:], minlength=n * n)
        of, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[of, at])], names=["group", "bigram", "n"])

    counts = np.zeros((groups, n * n), np.int64)
    for r in rows.mapInArrow(run, "group int, bigram int, n bigint").groupBy("group", "bigram").agg(F.sum("n").alias("n")).collect():
        counts[r.group, r.bigram] = r.n
    return counts.reshape(groups, n, n)


def _joined(texts: list) -> Iterator[tuple[list[int], str, np.ndarray]]:
    """Texts joined by line feeds up to CHUNK characters: their indices, the whole, and the starts."""
    at, size = [], 0
    for i, t in enumerate(texts):
        if t:
            at.append(i)
            size += len(t) + 1
            if size > CHUNK:
                yield _one(at, texts)
                at, size = [], 0
    if at:
        yield _one(at, texts)


def _one(at: list[int], texts: list) -> tuple[list[int], str, np.ndarray]:
    own = [texts[i] for i in at]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in own])])
    return at, "\n".join(own) + "\n", starts


@lru_cache(None)
def _letters_as_utf8() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, which): bigrams that are a letter, or the start of dashes, quotation marks and the like, in UTF-8; and the classes of these letters, one row for each."""
    table = letters()[1]
    n = len(letters()[0])
    code = lambda c: int(table[min(ord(c), 0xFFFF)])
    a, b, which = [], [], []
    for page in PAGES:
        d = decoded(page)
        for first in (*range(0xC2, 0xE0), 0xE2):
            for second in range(0x80, 0xC0):
                if _fold(d[second]) == " ":  # the class of all blanks: a common end of a word is no sequence
                    continue
                of = np.zeros(n, np.float32)
                if first == 0xE2:
                    for third in range(0x80, 0xC0):
                        if k := code(bytes([first, second, third]).decode("utf-8", "replace")[0]):
                            of[k] += 1
                else:
                    of[code(bytes([first, second]).decode())] = 1
                a.append(code(d[first]))
                b.append(code(d[second]))
                which.append(of)
    return np.array(a), np.array(b), np.array(which)


def model(counts: np.ndarray) -> Model:
    """The bigram model of counts, without what UTF-8 sequences of more frequent letters explain."""
    n = len(counts)
    a, b, which = _letters_as_utf8()
    kept = counts.astype(float)
    explained = counts[a, b] <= GARBLED * (which @ counts.sum(1).astype(float))
    kept[a[explained], b[explained]] = 0
    return Model(np.log((kept + 0.5) / (max(1.0, float(counts.sum())) + 0.5 * n * n) * n * n).astype(np.float32))


def models(counts: np.ndarray, own: np.ndarray) -> list[Model]:
    """A model for each group of sources, in which the group itself hardly counts: so damage that fills a source is not taken for its spelling.

    Where the other groups hold less than a group itself, it counts by so much more, up to all if there is no other.
    """
    sums = own.sum((1, 2)).astype(float)
    out = []
    for k, s in enumerate(sums):
        weight = max(OWN, 1 - (sums.sum() - s) / s) if s else 1.0
        out.append(model(counts - (1 - weight) * own[k]))
    return out


def _score(c: np.ndarray, gain: np.ndarray) -> float:
    return float(gain[c[:-1], c[1:]].sum())


#: What each different sequence that is a known letter in UTF-8 counts beside the bigrams: by chance it would hardly be one.
SEQUENCE = 5.0


@lru_cache(1 << 16)
def _known(sign: str) -> bool:
    return len(sign) == 1 and sign.isprintable() and classes(sign)[0] > 0


def sequence_gains(text: str, m: Model, pages: Iterable[int] = range(len(PAGES))) -> dict[int, float]:
    """What reading a text's UTF-8 sequences adds to the log likelihood of its bigrams, by page."""
    out = {}
    base = None
    for k in pages:
        page, now, valid = PAGES[k], text, 0
        for _ in range(TIMES):  # text garbled twice gains only when it is put right twice
            if not (found := set(sequences(page).findall(now))):
                break
            if base is None:
                base = _score(classes(f" {text} "), m.gain)
            valid += sum(_known(read_utf8(x, page)) for x in found)
            now = read_utf8(now, page)
            out[k] = max(out.get(k, 0.0), _score(classes(f" {now} "), m.gain) - base + SEQUENCE * valid)
    return out


_LOST = re.compile("[�\x80-\x84\x86-\x9f]")


def marked(held: DataFrame, by_group: list[Model], keys: list[str], text: str = "sval") -> DataFrame:
    """The keys, source, group and text of values that a swap improves, that are `lost` (hold U+FFFD or C1 controls) or have odd words, with the swaps and their gains.

    Each value of held (keys, source, group, text) is scored under every swap. odd: the improbable words of a value that no swap improves.
    """
    first = [*keys, "source", "group"]
    schema = T.StructType([*(held.schema[k] for k in first), T.StructField("text", T.StringType()), T.StructField("lost", T.BooleanType()), T.StructField("swaps", T.ArrayType(T.IntegerType())), T.StructField("gains", T.ArrayType(T.DoubleType())), T.StructField("odd", T.ArrayType(T.StringType()))])
    shared = held.sparkSession.sparkContext.broadcast(by_group)  # bounded by the alphabet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [_WordSwaps(m) for m in shared.value]
        lead, tail = _lead_and_tail()
        for b in batches:
            group, everything = np.asarray(b.column(len(keys) + 1)), b.column(len(first)).to_pylist()
            rows, lost, swaps, worth, odd = [], [], [], [], []
            for g in np.unique(group).tolist():
                mine = np.flatnonzero(group == g).tolist()
                for at, joined, starts in _joined([everything[i] for i in mine]):
                    points = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
                    bits = lead[points[:-1]] & tail[points[1:]]
                    hits = np.flatnonzero(bits)
                    pages = np.zeros(len(at), np.int32)
                    np.bitwise_or.at(pages, np.searchsorted(starts, hits, "right") - 1, bits[hits])
                    texts = [everything[mine[i]] for i in at]
                    own = [words_of(t) for t in texts]
                    words[g].learn(set().union(*own))
                    for i, t, x, p in zip(at, texts, own, pages.tolist()):
                        best, gain = ranked(t, x, p, words[g])
                        gone = _LOST.search(t) is not None
                        strange = [] if best else sorted(w for w in x if words[g].odd(w))
                        if gone or best or strange:
                            rows.append(mine[i])
                            odd.append(strange)
                            lost.append(gone)
                            swaps.append(best)
                            worth.append(gain)
            if rows:
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], part.columns[-1].cast(pa.string()), pa.array(lost), pa.array(swaps, pa.list_(pa.int32())), pa.array(worth, pa.list_(pa.float64())), pa.array(odd, pa.list_(pa.string()))], names=schema.names)

    return held.select(*first, text).mapInArrow(run, schema)


def learn(cases: DataFrame, sizes: DataFrame) -> DataFrame:
    """EM over cases (source, id, swaps, gains): each case's likeliest swap and its posterior, as (id, swap, chance).

    sizes: (source, n), the number of values of each source, affected or not.
    """
    each = materialize(cases.select("id", "source", F.explode(F.arrays_zip("swaps", "gains")).alias("x")).select("id", "source", F.col("x.swaps").alias("swap"), F.col("x.gains").alias("gain")), "gains")
    spread = {i: 1e-4 for i in range(len(SWAPS))}
    own = each.select("source", "swap").limit(0).withColumn("n", F.lit(0.0))
    total = max(1.0, float(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    posterior = None
    for _ in range(ROUNDS):
        prior = F.create_map(*[F.lit(v) for kv in spread.items() for v in kv])
        rows = each.join(sizes, "source", "left").join(own, ["source", "swap"], "left")
        p = (F.coalesce(F.col("n_own"), F.lit(0.0)) + BEHIND * prior[F.col("swap")]) / (F.coalesce(F.col("n"), F.lit(0)) + BEHIND) if "n_own" in own.columns else prior[F.col("swap")]
        # In logarithms, relative to the greatest weight of the value; the weight of no swap is 1.
        rows = rows.withColumn("l", F.ln(F.greatest(p, F.lit(1e-12))) + F.col("gain"))
        rows = rows.withColumn("top", F.greatest(F.lit(0.0), F.max("l").over(_by_id()))).withColumn("w", F.exp(F.col("l") - F.col("top"))).withColumn("none", F.exp(-F.col("top")))
        rows = rows.withColumn("all", F.sum("w").over(_by_id()))
        posterior = materialize(rows.select("id", "source", "swap", (F.col("w") / (F.col("none") + F.col("all"))).alias("chance"), (F.col("all") > F.col("none")).alias("likely")), "posterior")
        # Only likely cases teach: a common word that gains a little by chance, in thousands of values, is no swap.
        taught = posterior.filter("likely")
        sums = taught.groupBy("swap").agg(F.sum("chance").alias("n")).collect()  # one row a swap
        spread = {i: 1e-6 for i in range(len(SWAPS))} | {r.swap: max(1e-6, r.n / total) for r in sums}
        own = taught.groupBy("source", "swap").agg(F.sum("chance").alias("n_own"))
    best = posterior.groupBy("id").agg(F.max(F.struct("chance", -F.col("swap"))).alias("b"), F.least(F.lit(1.0), F.sum("chance")).alias("chance"))
    return best.select("id", (-F.col("b.col2")).alias("swap"), "chance")


def _by_id():
    from pyspark.sql.window import Window

    return Window.partitionBy("id")


def restore_text(text: str, swap: int | None, m: Model, table: dict[int, str] | None = None) -> str:
    """The text under a swap (its mapping, or the learned table), in the words that it improves; again while another UTF-8 reading improves it."""
    s = None if swap is None else SWAPS[swap]
    for turn in range(TIMES):
        if s is not None and s.written == "utf-8":
            new = read_utf8(text, s.read)
        else:
            table = mapping(s) if table is None or turn else table
            words = _WordGains(m, table)
            parts = re.split(r"([ \t\r\n]+)", text)
            good = [bool(words[w]) for w in parts]
            changed = [w.translate(table) != w for w in parts]
            # In a value garbled throughout, words that say little by themselves follow the others, unless they clearly lose.
            if sum(good) >= WHOLE * sum(changed):
                good = [g or c and (words.raw(w) > -LEAST or not _plausible(w) and _plausible(w.translate(table))) for g, c, w in zip(good, changed, parts)]
            # A sign alone follows the words around it.
            new = "".join(w.translate(table) if good[i] or len(w) == 1 and (i > 1 and good[i - 2] or i + 2 < len(parts) and good[i + 2]) else w for i, w in enumerate(parts))
        if new == text:
            break
        text = new
        again = sequence_gains(text, m)
        swap = max(again, key=again.get, default=0)
        if again.get(swap, 0) < 8 or turn + 1 == TIMES:
            break
        s = SWAPS[swap]
    return text


#: What a word has to gain before it counts as improved, and words whose gains are remembered.
LEAST, WORDS = 3.0, 200_000
#: Share of the words a table changes that it has to improve before the others follow.
WHOLE = 0.6
#: Mean log of a word's bigrams, against an even spread, below which its signs are odd.
ODD = -1.0
_ODD_WORD = re.compile(r"[A-Za-z\u00c0-\u024f][^\s\w]*[\u0400-\u04ff]|[\u0400-\u04ff][^\s\w]*[A-Za-z\u00c0-\u024f]|[\u2190-\u2bff\u0080-\u009f\ufffd]")


def _plausible(word: str) -> bool:
    """Whether a word is of one script, without signs of drawings, and has no capital after a small letter."""
    if _ODD_WORD.search(word) or any(a.isdigit() and b.isalpha() and not b.isascii() or b.isdigit() and a.isalpha() and not a.isascii() for a, b in zip(word, word[1:])):
        return False
    return not any(a.islower() and b.isupper() for a, b in zip(word, word[1:]))


class _WordGains(dict):
    """By word: what it gains under a table, 0 if that is too little or the new word implausible."""

    def __init__(self, m: Model, table: dict[int, str]):
        self.m, self.table = m, table

    def raw(self, word: str) -> float:
        return _score(classes(f" {word.translate(self.table)} "), self.m.gain) - _score(classes(f" {word} "), self.m.gain)

    def __missing__(self, word: str) -> float:
        new = word.translate(self.table)
        value = 0.0
        if new != word and _allowed(word, new):
            value = self.raw(word)
        self[word] = value = value if value > LEAST else 0.0
        return value


def words_of(text: str) -> set[str]:
    """The different words with a sign beyond ASCII: a word that a text repeats proves no more than one."""
    return {w for w in text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if not w.isascii()}


@lru_cache(1 << 17)
def _allowed(word: str, new: str) -> bool:
    return len(word.strip("\xa0")) > 1 and new.count("\xa0") <= word.count("\xa0") and _plausible(new)


class _WordSwaps(dict):
    """By word: the single-byte swaps that improve it to a plausible word, with what it gains (as _WordGains has it). Learn words first."""

    def __init__(self, m: Model):
        self.m, self._odd = m, set()

    def odd(self, word: str) -> bool:
        """Whether the bigrams of a learned word are improbable where they hold signs beyond ASCII."""
        return word in self._odd

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) >= WORDS:
            self.clear()
            self._odd.clear()
        new = [w for w in words if w not in self]
        block, size = [], 0
        for w in new:
            block.append(w)
            size += len(w) + 1
            if size > 8192:
                self._learn(block)
                block, size = [], 0
        if block:
            self._learn(block)

    def _learn(self, words: list[str]) -> None:
        number, maps = _sign_maps()
        joined = " " + " ".join(words) + " "
        points = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
        signs = number[points]
        firsts = np.r_[0, np.cumsum([len(w) + 1 for w in words])[:-1]]  # the blank before a word
        at = np.flatnonzero((points[:-1] > 127) | (points[1:] > 127))
        a, b = signs[at], signs[at + 1]
        start = np.searchsorted(at, firsts)  # each word holds a sign beyond ASCII
        before = self.m.gain[maps[0, a], maps[0, b]]
        mean = np.add.reduceat(before, start) / np.diff(np.r_[start, len(at)])
        self._odd.update(words[i] for i in np.flatnonzero(mean < ODD).tolist())
        change = self.m.gain[maps[1:, a], maps[1:, b]]
        change -= before
        worth = np.add.reduceat(change, start, axis=1).T
        for w in words:
            self[w] = ()
        found: dict[int, list] = {}
        for i, k in zip(*(x.tolist() for x in np.nonzero(worth > LEAST))):
            new = words[i].translate(mapping(SWAPS[len(PAGES) + k]))
            if new != words[i] and _allowed(words[i], new):
                found.setdefault(i, []).append((len(PAGES) + k, float(worth[i, k])))
        for i, x in found.items():
            self[words[i]] = tuple(x)


def ranked(text: str, own: set[str], pages: int, words: _WordSwaps) -> tuple[list[int], list[float]]:
    """The best swaps of a text with their gains; own: its words beyond ASCII; pages: a bit for each page in which it may hold UTF-8 sequences."""
    g = sequence_gains(text, words.m, [k for k in range(len(PAGES)) if pages >> k & 1]) if pages else {}
    for w in sorted(own):
        for k, x in words[w]:
            g[k] = g.get(k, 0.0) + x
    top = max(g.values(), default=0.0)
    best = sorted((k for k in g if g[k] > max(LEAST, top - HOPELESS)), key=lambda k: (-g[k], k))
    return best, [float(g[k]) for k in best]


#: Log chances before the evidence: the prior of the table's own letter for a sign, of a letter of another page at that byte, and of any other letter.
OWN_LETTER, PAGE_LETTER, ANY_LETTER = (float(np.log(x)) for x in (0.95, 1e-3, 1e-5))
#: Rounds of EM over a cipher, and the weight of the bigram evidence for one sign (its bigrams are not independent).
CIPHER_ROUNDS, EVIDENCE = 8, 0.5
#: An unknown cipher has to gain so much more than it costs, over at least so many bigrams; a value under it has to gain so much.
MARGIN, LEAST_BIGRAMS, SURE = 30.0, 30, 8.0
# Further pages of one byte a sign, from whose tables the EM over an unknown cipher may start.
STARTS = ["cp1253", "cp1254", "cp1257", "cp855", "cp857", "cp775", "cp737", "cp869", "iso8859-3", "iso8859-4", "iso8859-7", "iso8859-9", "iso8859-10", "iso8859-13", "iso8859-14", "iso8859-16", "koi8-u", "mac-latin2", "mac-greek", "mac-turkish", "mac-iceland", "kz1048", "ptcp154"]


@lru_cache(None)
def _letters() -> tuple[list[str], np.ndarray]:
    """The characters a sign may stand for (all letters of the pages), and their classes."""
    found = sorted({c for p in PAGES for c in decoded(p)[128:] if c.isalpha()})
    return found, classes("".join(found))


def _conditional(gain: np.ndarray) -> np.ndarray:
    """log P(b after a) of a model's bigrams."""
    top = gain.max(1, keepdims=True)
    return gain - top - np.log(np.exp(gain - top).sum(1, keepdims=True))


class _Cipher:
    """The bigrams of one source's words, read as a letter sequence that went through an unknown mapping of letters to signs.

    signs: those beyond ASCII first (`own` of them); the likelihood of a reading is that of the letters' bigrams, of their case, and of
    each sign given its letter (so that two signs for one letter share its chance).
    """

    def __init__(self, rows: "pd.DataFrame", m: Model):
        self.signs = sorted({*rows.a, *rows.b}, key=lambda c: (c.isascii(), c))
        number = {c: i for i, c in enumerate(self.signs)}
        self.counts = np.zeros((len(number), len(number)), np.float32)
        np.add.at(self.counts, (rows.a.map(number).to_numpy(int), rows.b.map(number).to_numpy(int)), rows.n.to_numpy(float))
        self.own = sum(not c.isascii() for c in self.signs)
        self.total = self.counts[:, : self.own].sum(0)
        outside = np.array([c.isascii() and not c.isalpha() for c in self.signs])
        self.first = self.counts[outside][:, : self.own].sum(0)
        self.cond = _conditional(m.gain)

    def case(self, upper: np.ndarray, k: slice | int = slice(None)) -> np.ndarray:
        """Log chance of a sign's places if it stands for capitals or small letters: capitals mostly begin words."""
        first, inside = self.first[k], self.total[k] - self.first[k]
        return np.where(upper, np.log(0.3) * first + np.log(0.02) * inside, np.log(0.7) * first + np.log(0.98) * inside)

    def likelihood(self, table: dict[int, str]) -> float:
        to = [c.translate(table)[:1] or c for c in self.signs]
        at = classes("".join(to))
        upper = np.array([c.isupper() for c in to[: self.own]], bool)
        share: dict[str, float] = {}
        for c, n in zip(to, self.total.tolist()):
            share[c] = share.get(c, 0.0) + n
        emission = sum(n * np.log(n / share[c]) for c, n in zip(to, self.total.tolist()) if n)
        return float((self.counts * self.cond[np.ix_(at, at)]).sum() + self.case(upper).sum() + emission)

    def em(self, prior: np.ndarray) -> np.ndarray:
        """The distribution (sign beyond ASCII, letter) of what each sign stands for; prior: its log chances before the evidence."""
        chars, of = _letters()
        upper = np.array([c.isupper() for c in chars])
        known = classes("".join(self.signs))
        n, own = len(self.cond), self.own
        spread = np.zeros((len(self.signs), n), np.float32)
        spread[np.arange(len(known)), known] = 1
        q = np.exp(prior - prior.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        for k in range(own):
            spread[k] = np.bincount(of, q[k], n)
        ahead, behind = spread @ self.cond, spread @ self.cond.T
        order = np.argsort(-self.total, kind="stable")
        held = self.total @ q
        for _ in range(CIPHER_ROUNDS):
            for k in order.tolist():
                # E-step of one sign: the bigrams with its neighbours as they are read now.
                seen = self.counts[:, k] @ ahead + self.counts[k] @ behind
                # M-step: the chance of the sign given the letter, from what the other signs take of it.
                held -= self.total[k] * q[k]
                theta = np.log((self.total[k] + 0.5) / (held + self.total[k] + 1.0))
                log = EVIDENCE * (seen[of] + self.case(upper, k) + self.total[k] * theta) + prior[k]
                new = np.exp(log - log.max())
                q[k] = new / new.sum()
                held += self.total[k] * q[k]
                spread[k] = np.bincount(of, q[k], n)
                ahead[k], behind[k] = spread[k] @ self.cond, self.cond @ spread[k]
        return q


def learned_table(rows: "pd.DataFrame", swap: Swap, m: Model) -> dict[int, str]:
    """The mapping of signs to letters of a source that suffered a swap, from the bigrams (a, b, n) of its affected words.

    The swap's own table is the prior: where the bigrams say little, it stays; a sign it maps to something improbable is learned anew.
    """
    cipher = _Cipher(rows, m)
    table, chars = mapping(swap), _letters()[0]
    number = {c: i for i, c in enumerate(chars)}
    prior = np.full((cipher.own, len(chars)), ANY_LETTER)
    byte = _bytes_of(swap.read)
    for i, c in enumerate(cipher.signs[: cipher.own]):
        if c in byte:
            for p in PAGES:
                if (k := number.get(decoded(p)[byte[c]])) is not None:
                    prior[i, k] = PAGE_LETTER
        if (k := number.get(table.get(ord(c), c))) is not None:
            prior[i, k] = OWN_LETTER
    q = cipher.em(prior)
    out, now = dict(table), cipher.likelihood(table)
    for i, c in enumerate(cipher.signs[: cipher.own]):
        k = int(q[i].argmax())
        to = table.get(ord(c), c)
        if to in number and chars[k] != to and q[i, k] > 0.99:
            # A letter is learned against the table only if the reading of all words gains more than its prior costs.
            other = out | {ord(c): chars[k]}
            new = cipher.likelihood(other)
            if EVIDENCE * (new - now) > OWN_LETTER - prior[i, k]:
                out, now = other, new
    return out


@lru_cache(None)
def _starting_tables() -> list[dict[int, str]]:
    known = [mapping(s) for s in SWAPS[len(PAGES) :]]
    return known + [mapping(Swap(r, w)) for r in ("cp1252", "cp1251", "cp1250", "latin-1") for w in STARTS]


def unknown_table(rows: "pd.DataFrame", m: Model, known: float) -> dict[int, str] | None:
    """The one cipher of all bad words of a source, from their bigrams (a, b, n), or null if it does not read them better than what is known.

    known: the likelihood of the words as the known swaps read them. The gain over it has to exceed what the cipher costs
    (a letter of the alphabet for each sign) by MARGIN.
    """
    cipher = _Cipher(rows, m)
    if not cipher.own or cipher.counts.sum() < LEAST_BIGRAMS:
        return None
    chars = _letters()[0]
    number = {c: i for i, c in enumerate(chars)}
    start = max(_starting_tables(), key=cipher.likelihood)
    best, top = None, 0.0
    for first in ({}, start):
        prior = np.full((cipher.own, len(chars)), ANY_LETTER)
        for i, c in enumerate(cipher.signs[: cipher.own]):
            if first and (k := number.get(first.get(ord(c), c))) is not None:
                prior[i, k] = PAGE_LETTER
        to = [chars[k] for k in cipher.em(prior).argmax(1).tolist()]
        table = {ord(c): x for c, x in zip(cipher.signs, to) if x != c}
        worth = EVIDENCE * (cipher.likelihood(table) - known) - len(table) * np.log(len(chars)) - MARGIN
        if worth > top:
            best, top = table, worth
    return best


def _odd(word: str, m: Model) -> bool:
    """Whether a word's bigrams with signs beyond ASCII are improbable on the mean."""
    c = classes(f" {word} ")
    beyond = np.array([not x.isascii() for x in f" {word} "])
    return float(m.gain[c[:-1], c[1:]][beyond[:-1] | beyond[1:]].mean()) < ODD


def _pairs_of(word: str) -> Iterator[tuple[str, str]]:
    """Bigrams of a word that hold a sign beyond ASCII, blanks around it."""
    w = f" {word} "
    return ((a, b) for a, b in zip(w, w[1:]) if not (a.isascii() and b.isascii()))


def ciphers(cases: DataFrame, chosen: DataFrame, by_group: list[Model]) -> DataFrame:
    """(source, swap, signs, letters): for each source and single-byte swap of its likely cases the learned mapping, and for a source with an unknown cipher that, with swap null.

    The EM of a source sees bigram counts by swap, a number of rows that the alphabet bounds.
    """
    shared = cases.sparkSession.sparkContext.broadcast(by_group)
    likely = cases.join(chosen, "id").filter((F.col("chance") > 0.5) & (F.col("swap") >= len(PAGES))).select("source", "group", "swap", "text")

    def improved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(source, group, swap, word) of the words that the value's swap improves, and of its odd ones: its table may lack their letters."""
        gains: dict = {}
        for b in batches:
            at, words = [], []
            for i, (g, k, t) in enumerate(zip(*(b.column(j).to_pylist() for j in (1, 2, 3)))):
                w = gains.setdefault((g, k), _WordGains(shared.value[g], mapping(SWAPS[k])))
                if len(w) > WORDS:
                    w.clear()
                for x in words_of(t):
                    if w[x] or _odd(x, shared.value[g]):
                        at.append(i)
                        words.append(x)
            keys = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(keys.column(j) for j in range(3)), pa.array(words, pa.string())], names=["source", "group", "swap", "word"])

    words = likely.mapInArrow(improved, "source string, group int, swap int, word string")
    odd = cases.filter("not lost and size(swaps) = 0").select("source", "group", F.lit(-1).alias("swap"), F.explode("odd").alias("word"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x, y = [], [], []
            for i, w in enumerate(b.column(3).to_pylist()):
                for a, c in _pairs_of(w):
                    at.append(i)
                    x.append(a)
                    y.append(c)
            keys = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(keys.column(j) for j in range(3)), pa.array(x, pa.string()), pa.array(y, pa.string())], names=["source", "group", "swap", "a", "b"])

    counted = words.unionByName(odd).distinct().mapInArrow(pairs, "source string, group int, swap int, a string, b string").groupBy("source", "group", "swap", "a", "b").agg(F.count("*").alias("n"))

    def fit(key, rows):
        import pandas as pd

        source, group = key
        m, found, known = shared.value[int(group)], [], 0.0
        for swap, own in rows.groupby("swap"):  # -1: odd words without a swap
            table = learned_table(own, SWAPS[swap], m) if swap >= 0 else {}
            known += _Cipher(own, m).likelihood(table)
            if swap >= 0:
                found.append((source, int(swap), table))
        if (table := unknown_table(rows.groupby(["a", "b"], as_index=False).n.sum(), m, known)) is not None:
            found.append((source, None, table))
        out = pd.DataFrame([(x, k, [chr(c) for c in t], list(t.values())) for x, k, t in found], columns=["source", "swap", "signs", "letters"])
        return out.astype({"swap": "Int32"})

    # Little data but much work for each source: the sources are dealt to as many tasks as there are, not joined up by size.
    tasks = max(64, int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return counted.repartition(tasks, "source", "group").groupBy("source", "group").applyInPandas(fit, "source string, swap int, signs array<string>, letters array<string>")


@dataclass
class Findings:
    """places: (keys, text, lost, source, group, swap, chance, signs, letters) of affected values, with the learned mapping; models: the bigrams, by group."""

    places: DataFrame
    models: list[Model]


def find(values: DataFrame, sources: DataFrame, keys: list[str], text: str = "sval") -> Findings:
    """Affected values of (keys, text). keys[1] is the id by which sources (id, source) names each value's source."""
    named = sources.filter("id is not null").groupBy("id").agg(F.min("source").alias("source"))
    sizes = named.groupBy("source").agg(F.count("*").alias("n"))
    held = values.select(*keys, text).filter(F.col(text).rlike(r"[^\x00-\x7f]")).join(named.withColumnRenamed("id", keys[1]), keys[1], "left").withColumn("source", F.coalesce("source", F.lit("")))
    held = materialize(held.select(*keys, "source", F.pmod(F.xxhash64("source"), F.lit(GROUPS)).cast("int").alias("group"), text), "held")
    by_group = models(bigram_counts(values, text), group_counts(held, text))
    cases = marked(held, by_group, keys, text)
    cases = materialize(cases.withColumn("id", F.xxhash64(*keys, "text")).dropDuplicates(["id", *keys]), "marked")
    chosen = materialize(learn(cases, sizes), "chosen")
    tables = materialize(ciphers(cases, chosen, by_group), "ciphers")
    names = [*keys, "text", "lost", "source", "group", "swap", "chance", "signs", "letters"]
    both = cases.join(chosen, "id", "left")
    # In a source with an unknown cipher the values that it improves are its cases, whatever swap might explain a part of them.
    other = materialize(under_unknown(both.filter("not lost").filter(F.col("swap").isNull() | (F.col("swap") >= len(PAGES))).join(tables.filter("swap is null").select("source", "signs", "letters"), "source"), by_group, ["id", *names]), "unknown")
    known = both.filter("lost or chance > 0.5").join(other.select("id", *keys), ["id", *keys], "left_anti").join(tables.filter("swap is not null"), ["source", "swap"], "left")
    return Findings(known.select(names).unionByName(other.select(names)), by_group)


def under_unknown(cases: DataFrame, by_group: list[Model], names: list[str]) -> DataFrame:
    """The cases that their source's unknown cipher (signs, letters) improves enough, with its chance."""
    shared = cases.sparkSession.sparkContext.broadcast(by_group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gains = []
            for g, t, x, y in zip(*(b.column(k).to_pylist() for k in ("group", "text", "signs", "letters"))):
                w = _WordGains(shared.value[g], dict(zip(map(ord, x), y)))
                gains.append(sum(w[x] for x in words_of(t)))
            keep = pa.array(np.flatnonzero(np.array(gains) > SURE))
            chance = pa.array([1 - float(np.exp(-g)) for g in gains], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in b.schema.names), chance], names=[*b.schema.names, "chance"]).take(keep)

    wanted = cases.select(*[n for n in names if n not in ("swap", "chance")])
    found = wanted.mapInArrow(run, T.StructType([*wanted.schema, T.StructField("chance", T.DoubleType())]))
    return found.withColumn("swap", F.lit(None).cast("int")).select(names)


def restored(found: Findings, keys: list[str]) -> DataFrame:
    """The places of affected values with the text as first written where it can be told (else null), and the swap's name ('unknown' for a cipher outside PAGES)."""
    places = found.places
    schema = T.StructType([*(places.schema[k] for k in keys), T.StructField("text", T.StringType()), T.StructField("restored", T.StringType()), T.StructField("swap", T.StringType()), T.StructField("chance", T.DoubleType())])
    shared = places.sparkSession.sparkContext.broadcast(found.models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(keys)
            texts, swaps, groups, signs, to = (b.column(n + i).to_pylist() for i in (0, 1, 3, 4, 5))
            new, names = [], []
            for t, s, g, x, y in zip(texts, swaps, groups, signs, to):
                table = dict(zip(map(ord, x), y)) if x else None
                out = None if s is None and not table else restore_text(t, s, shared.value[g], table)
                new.append(out if out != t else None)
                names.append(NAMES[s] if s is not None else "unknown" if table else None)
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], pa.array(new, pa.string()), pa.array(names, pa.string()), b.column(n + 2)], names=schema.names)

    sure = F.col("chance") > 0.5
    return places.select(*keys, "text", F.when(sure, F.col("swap")).cast("int").alias("swap"), "chance", "group", F.when(sure, F.col("signs")).alias("signs"), F.when(sure, F.col("letters")).alias("letters")).mapInArrow(run, schema)

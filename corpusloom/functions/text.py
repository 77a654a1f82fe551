"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Pattern of a word: a run of letters and digits. A loose word keeps other signs attached.
WORD, LOOSE_WORD = r"[\p{L}\p{N}]+", r"[^\s]*[\p{L}\p{N}][^\s]*"


def words(text: Column) -> Column:
    """The lower-cased words of a text, as an array; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def loose_words(text: Column) -> Column:
    """Words with the punctuation that adjoins them."""
    return F.regexp_extract_all(F.lower(text), F.lit(LOOSE_WORD), 0)


@lru_cache(1)
def _accents() -> tuple[str, str]:
    pairs = []
    for i in range(0xC0, 0x2000):
        c = chr(i)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    """Letters without their marks (composed and combining)."""
    return F.regexp_replace(F.translate(text, *_accents()), r"[̀-ͯ]", "")


def german_spelling(text: Column) -> Column:
    """Umlauts and sharp s written out."""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def collapse_spaces(text: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    """The sentences of a text: stretches that end after . ! ? or … and closing quotation marks before white space, or at a line end."""
    parts = F.split(F.regexp_replace(text, r"([.!?…]['\"”»’)]*)[ \t\r\n\f]+", "$1\n"), r"\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def pack_position(position: Column, section: Column, length: Column) -> Column:
    """The packed posting: position, section and word length."""
    return F.shiftleft(position, 16) + F.shiftleft(section, 8) + length


def unpack_position(packed: Column) -> tuple[Column, Column, Column]:
    """Position, section and word length of a packed posting."""
    return F.shiftright(packed, 16), F.shiftright(packed, 8).bitwiseAND(255), packed.bitwiseAND(255)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


@F.pandas_udf(StringType())
def normalize_nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode normal form C."""
    for s in texts:
        yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def unescape_entities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references and entities as their signs."""
    import html

    for s in texts:
        yield s.map(html.unescape, na_action="ignore")


def highlight(text: Column, terms: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """The text with the terms, as whole words in any case, between marks."""
    own = "|".join(sorted((t.lower() for t in terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({own})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}") if own else text


def period_seconds(text: Column) -> Column:
    """Seconds of a period such as 1d12h or 90: units s, M (minutes), h, d, m (30 days), y (365 days); null for other texts."""
    units = (("y", 31536000), ("m", 2592000), ("d", 86400), ("h", 3600), ("M", 60), ("s", 1))
    total = F.lit(0).cast("bigint")
    for u, n in units:
        found = F.regexp_extract(text, rf"(-?\d+){u}", 1)
        total = total + F.coalesce(found.try_cast("bigint"), F.lit(0)) * n
    return F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint")).when(text.rlike(r"^(-?\d+[yMmdhs])+$"), total)


def words_in(text: str) -> list[str]:
    """The lower-cased words of one text on the driver (a query)."""
    import re

    return re.findall(r"[^\W_]+", text.lower())


def between(text: Column, begin: str, end: str) -> Column:
    """What stands between the first `begin` and the next `end`, the whole text where either is missing."""
    at = F.instr(text, begin)
    rest = F.substring(text, at + len(begin), F.length(text))
    stop = F.instr(rest, end)
    return F.when((at > 0) & (stop > 0), F.substring(rest, F.lit(1), stop - 1)).otherwise(text)


def desegmented(text: Column) -> Column:
    """Text without blanks between two signs of scripts that write no blanks (Chinese, Japanese, Thai), so that it can be segmented anew."""
    signs = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
    return F.regexp_replace(text, rf"(?<=[{signs}])[ \u3000]+(?=[{signs}])", "")

"""Words in scripts that are written without blanks, by a dictionary of word frequencies."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entries a dictionary may have, as each worker holds it.
MAX_ENTRIES = 2_000_000
#: Runs of Han, kana, Hangul, Thai, Lao or Khmer signs.
RUNS = re.compile(r"[฀-໿ក-៿぀-ヿ㐀-䶿一-鿿가-힯]+")


def best_path(text: str, frequency: dict[str, int], longest: int, total: int) -> list[str]:
    """The words of a run whose product of frequencies is greatest; signs of no word stand alone. Of equal paths the one with the longer last word."""
    n = len(text)
    score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    unknown = -math.log(total) - 10
    for i in range(1, n + 1):
        for k in range(min(longest, i), 0, -1):
            f = frequency.get(text[i - k : i])
            gain = math.log(f / total) if f else unknown if k == 1 else None
            if gain is not None and score[i - k] + gain > score[i]:
                score[i], back[i] = score[i - k] + gain, i - k
    out = []
    while n:
        out.append(text[back[n] : n])
        n = back[n]
    return out[::-1]


def segment(text: str | None, frequency: dict[str, int], longest: int, total: int) -> str | None:
    """The text with blanks between the words of its runs. Blanks inside of a run do not count: they are taken out first."""
    if text is None:
        return None
    joined = re.sub(rf"(?<={RUNS.pattern[:-1]})[ \t]+(?={RUNS.pattern[:-1]})", "", text)
    return re.sub(r" {2,}", " ", RUNS.sub(lambda m: " " + " ".join(best_path(m.group(), frequency, longest, total)) + " ", joined)).strip()


def segmented(text: Column, frequency: dict[str, int]) -> Column:
    """segment as a column expression."""
    if len(frequency) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries")
    known = {w: f for w, f in frequency.items() if w and f > 0}
    longest, total = max(map(len, known), default=1), max(1, sum(known.values()))

    @F.pandas_udf(StringType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: segment(t, known, longest, total), na_action="ignore")

    return run(text)

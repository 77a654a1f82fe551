"""Readings of text as typed values; null where the text can't be read as the type without doubt.

All are built-in column expressions, safe under ANSI mode and independent of the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names as HTTP dates write them, and words for truth.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
TRUE_WORDS = ["1", "true", "t", "yes", "y", "on"]
FALSE_WORDS = ["0", "false", "f", "no", "n", "off"]

_GROUP = "[,.'’    ]"
_UNIT = r"(?:\s*(?:bytes?|b|octets?))?"
_CLOCK = r"(\d{1,2}):(\d{2}):(\d{2})"
_ZONE = r"(?:\s*(z|gmt|utc|[+-]\d{2}:?\d{2}))?"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s  ﻿]+|[\s  ﻿]+$", "")


def as_long(text: Column) -> Column:
    """A whole number, perhaps signed, with grouping signs (of one kind, in threes) or a unit of bytes."""
    t = F.regexp_replace(F.lower(_strip(text)), _UNIT + "$", "")
    plain = F.when(t.rlike(r"^[+-]?\d{1,18}$"), t)
    grouped = F.when(t.rlike(rf"^[+-]?\d{{1,3}}({_GROUP})\d{{3}}(\1\d{{3}})*$"), F.regexp_replace(t, _GROUP, ""))
    return F.coalesce(plain, grouped).try_cast("bigint")


def as_double(text: Column) -> Column:
    """A number with a point or comma as decimal sign, or an exponent."""
    t = F.lower(_strip(text))
    t = F.when(t.rlike(r"^[+-]?\d*,\d+$"), F.translate(t, ",", ".")).otherwise(t)
    return F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d{1,3})?$"), t).try_cast("double")


def as_boolean(text: Column) -> Column:
    """A word or digit for true or false."""
    t = F.lower(_strip(text))
    return F.when(t.isin(TRUE_WORDS), F.lit(True)).when(t.isin(FALSE_WORDS), F.lit(False))


def as_epoch_seconds(text: Column) -> Column:
    """Seconds since 1970 in UTC of an ISO, RFC 1123, RFC 850 or asctime date with a time of day, or of such seconds.

    A time without a zone is UTC. Two-digit years below 70 lie after 2000. Days and hours that do not exist give null.
    """
    t = F.lower(_strip(text))
    month = "(" + "|".join(MONTHS) + ")[a-z]*"
    day_name = r"(?:[a-z]{3,9},?\s+)?"
    # Each form is rewritten to year, month, day, hours, minutes, seconds, zone; other texts stay as they are.
    forms = [
        (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:t|\s+){_CLOCK}(?:\.\d+)?{_ZONE}$", "$1,$2,$3,$4,$5,$6,$7"),
        (rf"^{day_name}(\d{{1,2}})[\s-]+{month}[\s-]+(\d{{4}}|\d{{2}})\s+{_CLOCK}{_ZONE}$", "$3,$2,$1,$4,$5,$6,$7"),
        (rf"^{day_name}{month}\s+(\d{{1,2}})\s+{_CLOCK}{_ZONE}\s+(\d{{4}})$", "$7,$1,$2,$3,$4,$5,$6"),
        (r"^(\d{8,10})$", "epoch,$1"),
    ]
    row = t
    for pattern, order in forms:
        row = F.regexp_replace(row, pattern, order)
    numbers = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(str(i + 1)))])

    def read(p: Column) -> Column:
        year = F.when(F.length(p[0]) == 2, F.concat(F.when(p[0] < "70", F.lit("20")).otherwise(F.lit("19")), p[0])).otherwise(p[0])
        day = F.unix_date(F.try_to_date(F.concat_ws("-", year, F.coalesce(numbers[p[1]], p[1]), p[2]), "yyyy-M-d"))
        h, mi, s = (p[i].cast("int") for i in (3, 4, 5))
        digits = F.regexp_replace(p[6], "[^0-9]", "")
        ahead = F.substring(digits, 1, 2).cast("int") * 3600 + F.substring(digits, 3, 2).cast("int") * 60
        shift = F.when(F.length(digits) == 4, F.when(p[6].startswith("-"), -ahead).otherwise(ahead)).otherwise(F.lit(0))
        return day.cast("bigint") * 86400 + F.when((h < 24) & (mi < 60) & (s < 60), h * 3600 + mi * 60 + s) - shift

    def kind(p: Column) -> Column:
        return F.when(F.size(p) == 7, read(p)).when((F.size(p) == 2) & (p[0] == "epoch"), p[1].try_cast("bigint"))

    return F.transform(F.array(F.split(row, ",")), kind)[0]  # binds the parts once


def utc_text(seconds: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in UTC of epoch seconds, in any session time zone."""
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit(" "), two(rest / 3600), F.lit(":"), two(F.pmod(rest, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(rest, F.lit(60))))

"""Texts of protocols: headers as sections, encoded words, listings of file servers."""

from __future__ import annotations

import re
from email.header import decode_header
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encoded_words(text: str | None) -> str | None:
    """A header value with its =?charset?B|Q?...?= words decoded; what cannot be decoded stays."""
    if text is None or "=?" not in text:
        return text
    try:
        return "".join(x.decode(c or "latin-1", "replace") if isinstance(x, bytes) else x for x, c in decode_header(text))
    except (LookupError, ValueError):
        return text


def parse_headers(text: str | None) -> dict[str, str] | None:
    """header.<name>: value of the lines before the first empty one; folded lines joined, repeated names with blanks between."""
    if text is None:
        return None
    out: dict[str, str] = {}
    head = re.split(r"\r?\n\r?\n", text, maxsplit=1)[0]
    for line in re.sub(r"\r?\n[ \t]+", " ", head).splitlines():
        name, sep, value = line.partition(":")
        if sep and re.fullmatch(r"[!-9;-~]+", name.strip()):
            key = f"header.{name.strip().lower()}"
            out[key] = f"{out[key]} {encoded_words(value.strip())}" if key in out else encoded_words(value.strip())
    return out


def http_date(text: str | None) -> int | None:
    """Epoch seconds of a date as mail and web headers write it."""
    try:
        return None if text is None else int(parsedate_to_datetime(text).timestamp())
    except (TypeError, ValueError, IndexError):
        return None


_UNIX = re.compile(r"^([-dl])\S{9}\s+\d+\s+\S+\s+\S+\s+(\d+)\s+(\w{3}\s+\d+\s+[\d:]+)\s+(.+?)(?: -> .*)?$")
_DOS = re.compile(r"^(\d\d-\d\d-\d{2,4}\s+\d\d:\d\d\w*)\s+(<DIR>|\d+)\s+(.+)$")


def parse_listing(text: str | None) -> list[dict] | None:
    """Entries {name, size, directory} of a file server's listing, in the Unix or the DOS form; other lines are left out."""
    if text is None:
        return None
    out = []
    for line in text.splitlines():
        if m := _UNIX.match(line):
            out.append({"name": m.group(4), "size": int(m.group(2)), "directory": m.group(1) == "d"})
        elif m := _DOS.match(line):
            out.append({"name": m.group(3), "size": 0 if m.group(2) == "<DIR>" else int(m.group(2)), "directory": m.group(2) == "<DIR>"})
    return [x for x in out if x["name"] not in (".", "..")]


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def header_sections(texts: pd.Series) -> pd.Series:
    """parse_headers over a column."""
    return texts.map(parse_headers)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("directory", T.BooleanType())])))
def listing_entries(texts: pd.Series) -> pd.Series:
    """parse_listing over a column."""
    return texts.map(parse_listing)

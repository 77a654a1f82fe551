"""Readers of files, lists, rows of databases and feeds, by scheme."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(url, content, size, modified) of all files below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.select(F.col("path").alias("url"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of the lines of text files; empty lines and comments are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.filter((F.col("url") != "") & ~F.col("url").startswith("#")).distinct()


def read_query(spark: SparkSession, query: str, key: str, text: list[str], prefix: str = "htdb:/", parameters: list[str] = ()) -> DataFrame:
    """(url, text) of the rows of a SQL query: rows as documents. $1 to $9 in the query stand for the parameters (parts of a path), quotation marks in them doubled."""
    for i in range(9, 0, -1):
        value = parameters[i - 1].replace("'", "''") if i <= len(parameters) else ""
        query = query.replace(f"${i}", value)
    rows = spark.sql(query)
    return rows.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("url"), F.concat_ws(" ", *text).alias("text"))


def store_copies(documents: DataFrame, path: str) -> None:
    """Write compressed copies (doc_id, text), sorted by doc_id so that one is found by row-group statistics."""
    rows = documents.filter("text is not null").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_copies(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """Stored copies, all or of some ids."""
    rows = spark.read.parquet(path)
    return rows if ids is None else rows.filter(F.col("doc_id").isin(ids))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database, read in ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


#: Readers by the scheme of an address.
SCHEMES: dict[str, Callable[..., DataFrame]] = {"file": read_files, "list": read_url_list, "htdb": read_query, "jdbc": read_jdbc}


def reader_of(address: str) -> Callable[..., DataFrame]:
    """The reader for an address; fetching over a network is left to other tools, whose pages are read as tables."""
    scheme = address.split(":", 1)[0]
    if scheme not in SCHEMES:
        raise ValueError(f"no reader for {scheme}")
    return SCHEMES[scheme]


def decode_content(data: bytes | None, encodings: str | None) -> bytes | None:
    """Content without its transfer and content encodings (gzip, deflate, chunked), undone from the last; null for null and if broken."""
    if data is None:
        return None
    for e in reversed([x.strip().lower() for x in (encodings or "").split(",") if x.strip()]):
        try:
            if e in ("gzip", "x-gzip"):
                data = gzip.decompress(data)
            elif e == "deflate":
                try:
                    data = zlib.decompress(data)
                except zlib.error:
                    data = zlib.decompress(data, -15)
            elif e == "chunked":
                data = _unchunk(data)
        except (OSError, EOFError, zlib.error, ValueError, TypeError):
            return None
    return data


def _unchunk(data: bytes) -> bytes:
    out, i = [], 0
    while True:
        end = data.index(b"\r\n", i)
        n = int(data[i:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        i = end + 4 + n


@F.pandas_udf(BinaryType())
def decoded_content(data: pd.Series, encodings: pd.Series) -> pd.Series:
    """decode_content over columns."""
    return pd.Series([decode_content(d, e) for d, e in zip(data, encodings)], dtype=object)


def decoded_text(data: Column, charset: Column) -> Column:
    """Text of bytes in a charset Spark can name; UTF-8 where the name is missing."""
    name = F.upper(F.coalesce(charset, F.lit("UTF-8")))
    out = F.decode(data, "UTF-8")
    for c in ("ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        out = F.when(name == c, F.decode(data, c)).otherwise(out)
    return out


def parse_feed(xml: str | None) -> list[dict] | None:
    """Entries {loc, title, text, changed, priority} of a sitemap, RSS or Atom document; null for null, empty for broken ones."""
    if xml is None:
        return None
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1].lower()
    out = []
    for e in root.iter():
        if local(e) not in ("url", "sitemap", "item", "entry"):
            continue
        row = dict.fromkeys(("loc", "title", "text", "changed", "priority"))
        for x in e:
            value = "".join(x.itertext()).strip()
            name = {"loc": "loc", "link": "loc", "title": "title", "description": "text", "summary": "text", "content": "text", "lastmod": "changed", "pubdate": "changed", "updated": "changed", "priority": "priority"}.get(local(x))
            if name:
                row[name] = row[name] or x.get("href") or value or None
        out.append(row)
    return out


_ENTRY = StructType([StructField(n, StringType()) for n in ("loc", "title", "text", "changed", "priority")])


@F.pandas_udf(ArrayType(_ENTRY))
def feed_entries(xml: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """parse_feed over a column."""
    for s in xml:
        yield s.map(parse_feed)


def parse_xml_sections(xml: str | None) -> dict[str, str] | None:
    """Text by dotted element path, and by path.attribute for attributes."""
    if xml is None:
        return None
    out: dict[str, str] = {}

    def walk(e, path):
        path = f"{path}.{e.tag.rsplit('}', 1)[-1].lower()}".lstrip(".")
        for k, v in e.attrib.items():
            out[f"{path}.{k.lower()}"] = (out.get(f"{path}.{k.lower()}", "") + " " + v).strip()
        text = " ".join(((e.text or "") + " " + " ".join(c.tail or "" for c in e)).split())
        if text:
            out[path] = (out.get(path, "") + " " + text).strip()
        for c in e:
            walk(c, path)

    try:
        walk(ElementTree.fromstring(xml), "")
    except (ElementTree.ParseError, RecursionError):
        pass
    return out


@F.pandas_udf(MapType(StringType(), StringType()))
def xml_sections(xml: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """parse_xml_sections over a column."""
    for s in xml:
        yield s.map(parse_xml_sections)


def media_tags(data: bytes | None) -> dict[str, str] | None:
    """Texts inside of media: ID3 tags (title, artist, album, year, comment) of version 1 or 2, or GIF comments."""
    if data is None:
        return None
    out: dict[str, str] = {}
    if data[:3] == b"ID3" and len(data) > 10:
        size = sum((b & 127) << (7 * (3 - i)) for i, b in enumerate(data[6:10]))
        old = data[3] == 2
        head, i = (6, 10) if old else (10, 10)
        names = {"TT2": "title", "TP1": "artist", "TAL": "album", "TYE": "year", "TIT2": "title", "TPE1": "artist", "TALB": "album", "TYER": "year", "TDRC": "year"}
        while i + head <= min(len(data), 10 + size):
            tag = data[i : i + (3 if old else 4)].decode("latin-1")
            n = int.from_bytes(data[i + 3 : i + 6], "big") if old else int.from_bytes(data[i + 4 : i + 8], "big") if data[3] == 3 else sum((b & 127) << (7 * (3 - k)) for k, b in enumerate(data[i + 4 : i + 8]))
            if not n or not tag.strip("\0"):
                break
            body = data[i + head : i + head + n]
            if tag in names and body:
                charset = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                out[names[tag]] = body[1:].decode(charset, "replace").strip("\0 ")
            i += head + n
    if len(data) >= 128 and data[-128:-125] == b"TAG":
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            value = data[-128 + a : -128 + b].split(b"\0")[0].decode("latin-1").strip()
            if value:
                out.setdefault(name, value)
    if data[:3] == b"GIF" and len(data) > 13:
        comments = list(_gif_comments(data))
        if comments:
            out["comment"] = " ".join(comments)
    return out


def _gif_comments(data: bytes) -> Iterator[str]:
    flags = data[10]
    i = 13 + (3 * (2 << (flags & 7)) if flags & 128 else 0)
    while i < len(data):
        kind = data[i]
        if kind == 0x21 and i + 1 < len(data):
            comment, i, parts = data[i + 1] == 0xFE, i + 2, []
        elif kind == 0x2C and i + 10 <= len(data):
            local = data[i + 9]
            comment, i, parts = False, i + 11 + (3 * (2 << (local & 7)) if local & 128 else 0), []
        else:
            return
        while i < len(data) and data[i]:
            parts.append(data[i + 1 : i + 1 + data[i]])
            i += 1 + data[i]
        i += 1
        if comment:
            yield b"".join(parts).decode("latin-1").strip()


@F.pandas_udf(MapType(StringType(), StringType()))
def media_sections(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """media_tags over a column of binaries."""
    for s in data:
        yield pd.Series([_safe(x) for x in s], dtype=object)


def _safe(x: bytes | None) -> dict[str, str] | None:
    try:
        return media_tags(x)
    except (IndexError, struct.error, UnicodeDecodeError):
        return {}


def section_kind(content_type: Column) -> Column:
    """Which parser a content type wants: html, xml, text, media or none."""
    t = F.lower(F.regexp_extract(content_type, r"^\s*([^;\s]*)", 1))
    return F.when(t.isin("text/html", "application/xhtml+xml"), "html").when(t.rlike(r"[/+]xml$|rss|atom"), "xml").when(t.startswith("text/"), "text").when(t.isin("audio/mpeg", "image/gif"), "media").otherwise("none")

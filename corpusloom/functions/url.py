"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, name: str) -> Column:
    """scheme, host (lower case), port, path, directory, file, query or fragment; empty where it is missing."""
    get = lambda i: F.regexp_extract(url, _URL, i)
    path = get(4)
    return {
        "scheme": F.lower(get(1)), "host": F.lower(get(2)), "port": get(3), "path": path,
        "directory": F.regexp_extract(path, r"^(.*/)[^/]*$", 1), "file": F.regexp_extract(path, r"([^/]*)$", 1),
        "query": get(5), "fragment": get(6),
    }[name]


def site_host(url: Column) -> Column:
    """The host without one leading www."""
    return F.regexp_replace(part(url, "host"), r"^www\.", "")


def site_key(url: Column, levels: int = 2) -> Column:
    """The last labels of the host, lower case, without www.; a short second label (co.uk) does not count. Negative levels take path directories."""
    host = site_host(url)
    if levels < 0:
        dirs = F.filter(F.split(part(url, "directory"), "/"), lambda x: x != "")
        return F.concat(host, F.lit("/"), F.array_join(F.slice(dirs, 1, -levels), "/"))
    labels = F.split(host, r"\.")
    short = F.length(F.try_element_at(labels, F.lit(-2))) <= 3
    n = F.least(F.size(labels), F.when(short & (F.size(labels) > 2), F.lit(levels + 1)).otherwise(F.lit(levels)))
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def normal_path(path: Column) -> Column:
    """The path without '.', '..' and empty inner segments; '..' does not climb above the root."""
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == ".") | (x == ""), acc).otherwise(F.concat(acc, F.array(x))))
    slash = F.when(path.rlike(r"(/|/\.|/\.\.)$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), slash)


def resolve(base: Column, link: Column) -> Column:
    """The absolute URL of a link on the page base, with a normal path."""
    scheme, host, port = part(base, "scheme"), part(base, "host"), part(base, "port")
    root = F.concat(scheme, F.lit("://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")))
    link = F.regexp_replace(F.trim(link), "#.*$", "")
    query = F.regexp_extract(link, r"(\?.*)$", 1)
    path = F.regexp_replace(link, r"\?.*$", "")
    full = F.when(path.startswith("/"), path).when(path == "", part(base, "path")).otherwise(F.concat(part(base, "directory"), path))
    absolute = F.concat(part(link, "scheme"), F.lit("://"), part(link, "host"), F.when(part(link, "port") != "", F.concat(F.lit(":"), part(link, "port"))).otherwise(F.lit("")), normal_path(part(link, "path")), query)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), absolute).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).otherwise(F.concat(root, normal_path(full), query))


def depth(url: Column) -> Column:
    """Number of directories in the path."""
    return F.size(F.filter(F.split(part(url, "directory"), "/"), lambda x: x != ""))

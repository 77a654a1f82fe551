"""Names of sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """The plain form of a section name: trimmed of white space, lower case, '_' as '-'."""
    return F.translate(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), "_", "-")

"""Cleaning and hashing of graph ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(c: Column | str) -> Column:
    """White space off both ends, back slashes read as slashes; a blank id becomes null. Case is kept."""
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.nullif(F.translate(trimmed, "\\", "/"), F.lit(""))


def digest(c: Column | str) -> Column:
    """16-byte key of a string, for shuffles that need not carry the string."""
    return F.unhex(F.md5(c))

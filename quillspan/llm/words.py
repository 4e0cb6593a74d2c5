"""Words of a text as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What lies between words, before and after lower-casing of A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, nothing else; by the faster lower() where the text is all ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """An empty array for a null text. split() is several times
    as fast as regexp_extract_all(), and only the ends can be empty strings."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), BETWEEN), "")

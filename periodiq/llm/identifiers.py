"""Serial numbers as columns: shape, checksum and placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def issn_digits(c: Column) -> Column:
    """Eight characters of a written ISSN, or null; notation does not matter."""
    d = F.upper(F.regexp_replace(c, r"[^0-9Xx]", ""))
    return F.when(d.rlike(r"^\d{7}[\dX]$") & ~d.rlike(r"^(\d)\1{6}"), d)


def issn_valid(d: Column) -> Column:
    """Whether the check character of eight characters is right (mod 11)."""
    total = F.lit(0)
    for i in range(8):
        ch = F.substring(d, i + 1, 1)
        total = total + F.when(ch == "X", 10).otherwise(ch.try_cast("int")) * (8 - i)
    return F.coalesce(total % 11 == 0, F.lit(False))


def issn_key(c: Column) -> Column:
    """issn_digits where the check character holds."""
    d = issn_digits(c)
    return F.when(issn_valid(d), d)

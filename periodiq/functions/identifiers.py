"""Identifiers and keys (FS-09, FS-19, FS-20, FS-37 to FS-40, FLT-14, FLT-19)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_issn(c: Column) -> Column:
    """NNNN-NNNC from eight alphanumerics, else null; no checksum (FS-19)."""
    d = F.upper(F.regexp_replace(c, r"[^0-9A-Za-z]", ""))
    return F.when(d.rlike(r"^\d{7}[0-9X]$"), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 4)))


def issn_checks(c: Column) -> Column:
    """Whether NNNN-NNNC has the right check character, mod 11 with weights 8 to 1 (FS-20)."""
    d = F.replace(F.upper(c), F.lit("-"), F.lit(""))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0), lambda a, i: a + F.when(F.substring(d, i, F.lit(1)) == "X", 10).otherwise(F.substring(d, i, F.lit(1)).try_cast("int")) * (9 - i))
    return c.rlike(r"^\d{4}-\d{3}[\dXx]$") & F.coalesce(F.when(c.rlike(r"^\d{4}-\d{3}[\dXx]$"), total % 11 == 0), F.lit(False))


def first_issn(c: Column) -> Column:
    """The first ISSN-shaped token of a text, hyphenated, else null (FS-09)."""
    a = F.regexp_extract(c, r"\b(\d{4})-?(\d{3}[\dX])\b", 1)
    return F.when(a != "", F.concat_ws("-", a, F.regexp_extract(c, r"\b(\d{4})-?(\d{3}[\dX])\b", 2)))


def first_doi(c: Column) -> Column:
    """The first DOI-like token of a text, else null (FS-09)."""
    d = F.regexp_extract(c, r"\b10\.\d{4,}\S*\b", 0)
    return F.when(d != "", d)


def issn_in(c: Column) -> Column:
    """The first eight characters in a noisy text that could be a serial number, hyphenated, unchecked (FS-42)."""
    d = F.upper(F.regexp_extract(c, r"(?:^|[^0-9])(\d{4}[\s\-‐-―]?\d{3}[\dXx])(?:[^0-9A-Za-z]|$)", 1))
    return F.when(d != "", F.concat_ws("-", F.substring(d, 1, 4), F.right(d, F.lit(4))))


def checked_issn(c: Column) -> Column:
    """Seven digits are filled with a leading zero, a lost hyphen comes back, and only a right check character passes (FS-43, SRC-01)."""
    d = F.upper(F.regexp_replace(c, r"[^0-9Xx]", ""))
    n = normal_issn(F.when(d.rlike(r"^\d{6}[\dX]$"), F.concat(F.lit("0"), d)).otherwise(d))
    return F.when(issn_checks(n), n)


def is_doi(c: Column) -> Column:
    """Whether the text is a DOI name (FLT-14)."""
    return F.coalesce(F.trim(c).rlike(r"^10\.\d{4,}/\S+$"), F.lit(False))


def is_email(c: Column) -> Column:
    """Whether the text has the form of a mail address (FS-21)."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), F.lit(False))


def url_host(c: Column) -> Column:
    """Host of an address in lower case, else null (FLT-19)."""
    h = F.lower(F.regexp_extract(F.trim(c), r"^(?i)[a-z][a-z0-9+.-]*://([^/?#:]+)", 1))
    return F.when(h != "", h)


def query_key(*parts: Column) -> Column:
    """md5 over the parts, nulls as empty, so it never moves with a missing one (FS-38)."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def dedupe_key(kind: Column, name: Column) -> Column:
    """Fixed-length key of type::name without case, 128 bits (FS-37)."""
    return F.left(F.sha2(F.concat_ws("::", F.coalesce(kind, F.lit("")), F.lower(F.coalesce(name, F.lit("")))), 256), F.lit(32))


def record_id(*parts: Column) -> Column:
    """file::key::venue (FS-39)."""
    return F.concat_ws("::", *[F.coalesce(p, F.lit("")) for p in parts])


def series_slug(c: Column, prefix: str) -> Column:
    """First path segment behind a prefix, else null (FS-40)."""
    return F.when(c.startswith(prefix), F.split_part(F.substring(c, F.lit(len(prefix) + 1), F.length(c)), F.lit("/"), F.lit(1)))

"""Several values packed in one field (problem 5).

A parsing expression grammar with ordered alternatives:

    list    <- item (delimiter item)* closing? end
    item    <- quoted / bracketed / bare          each must end at a delimiter
    quoted  <- '"' ('""' / [^"])* '"'
    bracket <- '{' (bracket / [^{}])* '}'
    bare    <- (!delimiter (bracket / .))+

An opening quote or brace without a partner fails its alternative and is read
again as part of a bare value, with an error flag. Which delimiter separates
the values is itself an ordered choice: the strong ones first; a comma only
between complete person names, because it also stands inside `Last, First`.

The grammar cannot be said in built-in expressions, so it runs over Arrow
batches of the rows that can hold more than one value.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(r"\s*")
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')
_BARE_TEXT = re.compile(r'[^\s{},;|/&\\"]+')
_CLOSING = re.compile(r"(?:^|(?<=[\s,;|/&]))(?:and\s+others|et\.?\s+al\.?|u\.\s?a\.)[\s.,;]*$", re.I)
_DELIMITERS: tuple[tuple[str, re.Pattern[str]], ...] = (
    ("semicolon", re.compile(r"\s*;\s*")),
    ("pipe", re.compile(r"\s*\|\s*")),
    ("and", re.compile(r"\s*,?\s+and\s+|\s*\n\s*(?:and\s+)?|^and\s+", re.I)),
    ("amp", re.compile(r"\s*,?\s*\\?&\s*")),
    ("slash", re.compile(r"\s+/\s*|\s*/\s+|/")),
)
_COMMA = re.compile(r"\s*,\s*")
_PARTICLE = frozenset("de la del della di da dos van von der den ten ter le du al el bin ibn zu zum zur".split())
_INITIALS = re.compile(r"^(?:[^\W\d_]\.?[-\s]?){1,4}$")
_SUFFIX = re.compile(r"^(?:jr|sr|ii|iii|iv)\.?$", re.I)


@lru_cache(maxsize=8)
def _ends(s: str) -> dict[int, int]:
    """End of every brace that closes, by where it opens: one pass, however malformed the text."""
    out, opened = {}, []
    for j, c in enumerate(s):
        if c == "{":
            opened.append(j)
        elif c == "}" and opened:
            out[opened.pop()] = j + 1
    return out


def _bracket(s: str, i: int) -> int:
    """End of the balanced braces that open at i, or -1."""
    return _ends(s).get(i, -1)


def _split(s: str, delimiter: re.Pattern[str]) -> tuple[list[tuple[str, bool]], bool]:
    """Items of s at the given delimiter, each with a flag whether it was enclosed; and an error flag."""
    if "{" not in s and '"' not in s:
        return [(x, False) for x in (p.strip() for p in delimiter.split(s)) if x], False
    out, error, i, n = [], False, _SPACE.match(s).end(), len(s)
    while i < n:
        end, text = -1, ""
        if s[i] == '"':
            m = _QUOTED.match(s, i)
            if m:
                end, text = m.end(), m.group(1).replace('""', '"')
            else:
                error = True
        elif s[i] == "{":
            end = _bracket(s, i)
            error |= end < 0
            text = s[i + 1 : end - 1]
        if end >= 0:
            j = _SPACE.match(s, end).end()
            d = delimiter.match(s, end) or delimiter.match(s, j)
            if j == n or (d and d.end() > end):
                if text.strip():
                    out.append((text.strip(), True))
                i = n if j == n else d.end()
                continue
            # the closed part is only the beginning of a longer value: bare reads it again
        start = i
        while i < n:
            d = delimiter.match(s, i)
            if d and d.end() > i and i > start:
                break
            if d and d.end() > i and i == start:
                break
            if s[i] == "{":
                e = _bracket(s, i)
                if e < 0:
                    error = True
                i = e if e > 0 else i + 1
            elif s[i] == '"':
                m = _QUOTED.match(s, i)
                if m:
                    i = m.end()
                else:
                    error, i = True, i + 1
            else:
                m = _BARE_TEXT.match(s, i)
                # a word is never cut by a delimiter made of letters
                i = m.end() if m else i + 1
        if s[start:i].strip():
            out.append((s[start:i].strip(), False))
        d = delimiter.match(s, i) if i < n else None
        if d:
            i = d.end()
    return out, error


def _complete(part: str) -> bool:
    """Whether part is a given name or initial followed by a surname."""
    words = part.split()
    if len(words) < 2 or words[0] in _PARTICLE or words[0].lower() in ("van", "von", "de"):
        return False
    return not (_INITIALS.match(part) and part == part.upper())


def _commas(item: str) -> list[str]:
    """A comma-separated run of persons, or the one person that it is."""
    parts, _ = _split(item, _COMMA)
    if len(parts) < 2:
        return [item]
    merged: list[tuple[str, bool]] = []
    for p, enclosed in parts:
        if merged and _SUFFIX.match(p):
            merged[-1] = (f"{merged[-1][0]}, {p}", True)
        else:
            merged.append((p, enclosed))
    whole = [enclosed or _complete(p) for p, enclosed in merged]
    if all(whole):
        return [p for p, _ in merged]
    if len(merged) == 2:
        return [item] if not whole[1] or not whole[0] else [p for p, _ in merged]
    # Last, First, Last, First: a surname takes the part behind it
    out, i = [], 0
    while i < len(merged):
        if whole[i] or i + 1 == len(merged) or whole[i + 1]:
            out.append(merged[i][0])
            i += 1
        else:
            out.append(f"{merged[i][0]}, {merged[i + 1][0]}")
            i += 2
    return out


def parse_persons(value: str) -> tuple[list[str], bool]:
    """Persons of an author field in order, and whether quotes or braces were malformed."""
    s = value.strip()
    closed = _CLOSING.search(s)
    if closed:
        s = s[: closed.start()].rstrip(" ,;|/&\n\t")
    error = False
    for _, delimiter in _DELIMITERS:
        items, bad = _split(s, delimiter)
        error |= bad
        if len(items) > 1 or (items and delimiter.search(s) and items[0][0] != s and not items[0][1]):
            out: list[str] = []
            for text, enclosed in items:
                if enclosed:
                    out.append(text)
                    continue
                # an item may hold weaker delimiters: `A B, C D and E F`
                inner, _ = parse_persons(text) if text != s else ([text], False)
                out.extend(inner)
            return out, error
    items, bad = _split(s, re.compile(r"(?!)"))
    if len(items) == 1 and items[0][1]:
        return [items[0][0]], error
    return [x for x in (_strip_outer(p) for p in _commas(s)) if x], error | bad


def _strip_outer(s: str) -> str:
    s = s.strip()
    while len(s) > 1 and ((s[0] == '"' and s[-1] == '"') or (s[0] == "{" and _bracket(s, 0) == len(s))):
        s = s[1:-1].strip()
    return s


_ISSN = re.compile(r"(?<![\dA-Za-z])(?:[a-z]{0,2})(\d{4})[-‐-― ]?(\d{3}[\dXx])(?![\dA-Za-z])")
_ISSN_SPLIT = re.compile(r"\s*(?:[,;|/\n]|\band\b|&)\s*", re.I)


def parse_issns(value: str) -> tuple[list[str], bool]:
    """ISSNs of a field in order, written NNNN-NNNC; a value that holds none stays as typed, flagged."""
    out, error = [], False
    for text, _ in _split(value, _ISSN_SPLIT)[0]:
        found = _ISSN.findall(text)
        if found:
            out.extend(f"{a}-{b.upper()}" for a, b in found)
        else:
            t = _strip_outer(text)
            if re.search(r"\d", t):
                out.append(t)
                error = True
    return out, error


def _explode_batches(field_parsers: dict[str, Callable[[str], tuple[list[str], bool]]], key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            keys = pdf[key].tolist()
            for name, parse in field_parsers.items():
                for k, v in zip(keys, pdf[name].tolist(), strict=True):
                    if not isinstance(v, str):
                        continue
                    items, error = parse(v)
                    if len(items) > 1:
                        rows.extend((k, name, i, x, error) for i, x in enumerate(items, 1))
            yield pd.DataFrame(rows, columns=["_key", "field_name", "pos", "item", "error"])

    return run


def split_values(df: DataFrame, key: str = "entry_id", authors: str = "authors", issn: str = "issn") -> DataFrame:
    """One row per value of fields that hold two or more: (key, field_name, pos, item, error).

    pos counts from 1 in the order typed; repeated values stay. Null, blank and
    single values give no rows. error marks malformed quotes, braces or ISSNs;
    their values still come out. Texts of any length are parsed whole. Other
    columns of df are not looked at. Rows that cannot hold a second value never
    leave the JVM. No shuffle.
    """
    d = df.select(F.col(key).alias("_key"), F.col(authors).alias("authors"), F.col(issn).alias("issn"))
    d = d.withColumn("authors", F.when(F.col("authors").rlike(r"(?i)[,;|/&\n]|\sand\s"), F.col("authors")))
    d = d.withColumn("issn", F.when(F.col("issn").rlike(r"(?is)[,;|/&\n]|\sand\s|\d[\dx]\W+\d|\d{4}.?\d{3}[\dx].*\d{4}.?\d{3}[\dx]"), F.col("issn")))
    d = d.where("authors is not null or issn is not null")
    kind = df.schema[key].dataType.simpleString()
    run = _explode_batches({"authors": parse_persons, "issn": parse_issns}, "_key")
    out = d.mapInPandas(run, f"_key {kind}, field_name string, pos int, item string, error boolean")
    return out.withColumnRenamed("_key", key)

"""A BibTeX data source: spark.read.format("bibtex").load(path) (SRC-20, FS-28 to FS-32).

One partition per file. A file is decoded as UTF-8, else Latin-1; entries are
cut by a brace-aware scan, and an entry that does not close costs only itself
in relaxed mode (the default) or fails the read with option("mode", "strict").
"""

from __future__ import annotations

import glob
import os
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_START = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")
_FIELD = re.compile(r"\s*,?\s*([A-Za-z][\w\-:.]*)\s*=\s*")
_MARKS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a"}
_ACCENT = re.compile(r"\\([`'^~\"=.])\s*\{?\s*(\\?[A-Za-z])\s*\}?|\\([cvuHkr])\s*(?:\{\s*(\\?[A-Za-z])\s*\}|\s(\\?[A-Za-z]))")
_LETTERS = {"\\ss": "ß", "\\ae": "æ", "\\AE": "Æ", "\\oe": "œ", "\\OE": "Œ", "\\aa": "å", "\\AA": "Å", "\\o": "ø", "\\O": "Ø", "\\l": "ł", "\\L": "Ł", "\\i": "i", "\\j": "j"}
_LETTER = re.compile(r"\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i|j)(?![A-Za-z])\s*(?:\{\})?")
_COMMAND = re.compile(r"\\(?:text\w+|emph|mbox|uppercase|lowercase|url|em|bf|it|sc|rm|tt)\b\s*(?:\{([^{}]*)\})?")

_SIGNS = "&%$#_{}\\~^"
_SIGN = re.compile(f"[\ue000-{chr(0xE000 + len(_SIGNS) - 1)}]")
_NAMED = {"textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^"}
_ESCAPED = re.compile(r"\\(textbackslash|textasciitilde|textasciicircum)(?![A-Za-z])\s*(?:\{\})?|\\([&%$#_{}])")


def latex_text(value: str) -> str:
    """Plain text of a LaTeX value: accents, letters, formatting commands, escapes, braces, blanks."""

    def accent(m: re.Match[str]) -> str:
        mark, letter = (m.group(1), m.group(2)) if m.group(1) else (m.group(3), m.group(4) or m.group(5))
        return unicodedata.normalize("NFC", letter.lstrip("\\") + _MARKS[mark])

    # signs written as such stay, whatever else is taken off
    s = _ESCAPED.sub(lambda m: chr(0xE000 + _SIGNS.index(m.group(2) or _NAMED[m.group(1)])), value)
    s = re.sub(r"\$\s*\^\s*\{?\s*(?:\\\w+\s*\{)?(st|nd|rd|th)\}*\s*\$", r"\1", s)
    s = _ACCENT.sub(accent, s)
    s = _LETTER.sub(lambda m: _LETTERS["\\" + m.group(1)], s)
    before = None
    while before != s:
        before, s = s, _COMMAND.sub(lambda m: m.group(1) or "", s)
    s = re.sub(r"\$[^$]*\$", "", s)
    s = " ".join(s.replace("~", " ").replace("--", "-").replace("{", "").replace("}", "").split())
    return _SIGN.sub(lambda m: _SIGNS[ord(m.group()) - 0xE000], s)


def _value(text: str, i: int, strings: dict[str, str]) -> tuple[str, int]:
    """A value that starts at i, and where it ends; parts joined by # are put together, names of strings replaced."""
    out = []
    while True:
        while i < len(text) and text[i].isspace():
            i += 1
        if i >= len(text):
            raise ValueError("value missing")
        if text[i] == "{":
            depth, j = 0, i
            while j < len(text):
                if text[j] == "\\":
                    j += 2
                    continue
                depth += text[j] == "{"
                depth -= text[j] == "}"
                j += 1
                if not depth:
                    break
            if depth:
                raise ValueError("brace not closed")
            out.append(text[i + 1 : j - 1])
            i = j
        elif text[i] == '"':
            depth, j = 0, i + 1
            while j < len(text) and (text[j] != '"' or depth):
                if text[j] == "\\":
                    j += 1
                else:
                    depth += (text[j] == "{") - (text[j] == "}")
                j += 1
            if j >= len(text):
                raise ValueError("quote not closed")
            out.append(text[i + 1 : j])
            i = j + 1
        else:
            m = re.compile(r"[^\s,#}{)]+").match(text, i)
            if not m:
                raise ValueError("value missing")
            out.append(strings.get(m.group().lower(), m.group()))
            i = m.end()
        m = re.compile(r"\s*#").match(text, i)
        if not m:
            return "".join(out), i
        i = m.end()


def parse_entries(text: str) -> Iterator[tuple[str, str | None, dict[str, str] | None, str | None]]:
    """(type, key, fields, error) of every entry; comments and preambles are passed over."""
    at = 0
    strings: dict[str, str] = {}
    while m := _START.search(text, at):
        kind, at = m.group(1).lower(), m.end()
        if kind in ("comment", "preamble"):
            continue
        try:
            key = None
            i = at
            if kind != "string":
                k = re.compile(r"\s*([^,\s{}()]*)\s*").match(text, i)
                key, i = k.group(1), k.end()
            fields: dict[str, str] = {}
            while f := _FIELD.match(text, i):
                v, i = _value(text, f.end(), strings)
                fields.setdefault(f.group(1).lower(), v)
            end = re.compile(r"\s*,?\s*[})]").match(text, i)
            if not end:
                raise ValueError("entry not closed")
            at = end.end()
            if kind == "string":
                strings.update({k.lower(): v for k, v in fields.items()})
            else:
                yield kind, key, fields, None
        except ValueError as e:
            yield kind, None, None, str(e)


def _rows(name: str, raw: bytes, strict: bool) -> Iterator[tuple]:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    for pos, (kind, key, fields, error) in enumerate(parse_entries(text)):
        if error and strict:
            raise ValueError(f"{name}, entry {pos}: {error}")
        yield name, pos, kind, key, None if fields is None else {k: latex_text(v) for k, v in fields.items()}, error


SCHEMA = "file string, pos int, entry_type string, entry_key string, fields map<string,string>, error string"


def read_bibtex(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Rows (file, pos, entry_type, entry_key, fields, error) of files on any file system that Spark reads (SRC-20, SRC-30)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            for name, raw in zip(pdf["path"].tolist(), pdf["content"].tolist(), strict=True):
                yield pd.DataFrame(list(_rows(name, raw, strict)), columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.strict = options["path"], options.get("mode", "relaxed") == "strict"

    def partitions(self) -> list[InputPartition]:
        p = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(p, "**", "*.bib"), recursive=True)) if os.path.isdir(p) else sorted(glob.glob(p))
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        with open(partition.value, "rb") as f:
            yield from _rows(partition.value, f.read(), self.strict)


class BibtexSource(DataSource):
    """Rows (file, pos, entry_type, entry_key, fields, error)."""

    @classmethod
    def name(cls) -> str:
        return "bibtex"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def venue_of(fields):
    """Venue name: journal, then for meetings series, booktitle, organization (PRJ-14, PRJ-13)."""
    from pyspark.sql import functions as F

    given = lambda k: F.when(F.trim(fields[k]) != "", F.trim(fields[k]))
    return F.coalesce(*[given(k) for k in ("journal", "journaltitle", "series", "booktitle", "organization")])

"""An XLSX data source over the standard library: option("sheet", substring) picks the sheet (SRC-03)."""

from __future__ import annotations

import glob
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(path: str, sheet: str = "") -> Iterator[list[str | None]]:
    """Rows of the first sheet whose name holds the text, cells as strings."""
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(f"{{{_NS['r']}}}id")]) for s in book.find("m:sheets", _NS)]
        chosen = next((t for n, t in sheets if sheet.lower() in n.lower()), None)
        if chosen is None:
            return
        with z.open("xl/" + chosen.removeprefix("/xl/")) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                cells: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    i = _column(c.get("r"))
                    cells += [None] * (i - len(cells))
                    v, kind = c.find("m:v", _NS), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else v.text if v is not None else None
                    cells.append(shared[int(text)] if kind == "s" and text is not None else text)
                yield cells
                row.clear()


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.sheet = options["path"], options.get("sheet", "")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        for n, cells in enumerate(sheet_rows(partition.value, self.sheet)):
            yield partition.value, n, cells


class XlsxSource(DataSource):
    """Rows (file, row_no, cells)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "file string, row_no int, cells array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

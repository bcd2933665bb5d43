"""Readers for list files: CSV, JSON, XML, flat text, HTML, sheets (SRC-*).

Each reader takes a path or glob, stays lazy and splits by file or by line. The
only driver work is choosing among file names.
"""

from __future__ import annotations

import zipfile
from collections.abc import Sequence
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodiq.functions.text import squeeze, strip_html, unescape_basic
from periodiq.sources.contract import ingest_rows, url_set

NAME_HEADERS = ("name", "journal_name", "title")
SHEET_HEADERS = ("journal", "journal name", "journal title", "title", "name", "publisher", "publisher name", "journals", "publishers", "conference")


def newest_file(folder: str, pattern: str) -> str | None:
    """The file that was changed last, ties to the later name (SRC-02)."""
    found = sorted(Path(folder).glob(pattern), key=lambda p: (p.stat().st_mtime, p.name))
    return str(found[-1]) if found else None


def discover(path: str, pattern: str = "*.bib", recursive: bool = True) -> list[str]:
    """Files of a path or folder, resolved, once each, sorted (SRC-30)."""
    p = Path(path)
    found = [p] if p.is_file() else (p.rglob(pattern) if recursive else p.glob(pattern))
    return sorted({str(f.resolve()) for f in found})


def extract_zip(archive: str, target: str) -> list[str]:
    """Members of an archive; one that would leave the target is refused (SRC-18)."""
    out = []
    with zipfile.ZipFile(archive) as z:
        for m in z.infolist():
            parts = PurePosixPath(m.filename).parts
            if m.filename.startswith("/") or ".." in parts or "\\" in m.filename or (parts and ":" in parts[0]):
                raise ValueError(f"unsafe member: {m.filename}")
        for m in z.infolist():
            out.append(z.extract(m, target))
    return out


def header_columns(columns: Sequence[str], wanted: dict[str, Sequence[Sequence[str]]]) -> dict[str, str]:
    """First column for each field whose header holds all words of one alternative (PRJ-04)."""
    found: dict[str, str] = {}
    for field, alternatives in wanted.items():
        for c in columns:
            if any(all(w in c.lower() for w in words) for words in alternatives):
                found[field] = c
                break
    return found


def first_given(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-empty value among the columns that are there, whatever their case (PRJ-05)."""
    by = {c.strip().lower(): c for c in df.columns}
    there = [F.when(F.trim(F.col(f"`{by[n]}`")) != "", F.trim(F.col(f"`{by[n]}`"))) for n in names if n in by]
    return F.coalesce(*there, F.lit(None).cast("string"))


def _rest(df: DataFrame, used: Sequence[str]) -> Column:
    """Other columns as a map of their non-empty values."""
    rest = [c for c in df.columns if c.strip().lower() not in used]
    if not rest:
        return F.create_map().cast("map<string,string>")
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in rest])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull() & (p["v"] != "")))


def read_directory_csv(spark: SparkSession, path: str) -> DataFrame:
    """A directory dump with a header: title, two ISSNs, publisher (SRC-01)."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    get = lambda *n: first_given(df, n)
    return ingest_rows(df, get("journal title", "title"), get("journal issn (print version)", "pissn", "issn"), get("journal eissn (online version)", "eissn"), get("publisher"), url_set(get("journal url", "url")))


def read_custom_csv(spark: SparkSession, path: str) -> DataFrame:
    """A user's list; unknown columns become metadata (SRC-19)."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return _custom(df)


def read_custom_json(spark: SparkSession, path: str) -> DataFrame:
    """A user's list as an array of objects; a malformed file yields no rows (SRC-19)."""
    df = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("primitivesAsString", True).json(path)
    return _custom(df) if df.columns else ingest_rows(df.select(F.lit("").alias("name")), F.col("name"))


def _custom(df: DataFrame) -> DataFrame:
    get = lambda *n: first_given(df, n)
    return ingest_rows(df, get(*NAME_HEADERS), get("issn"), get("eissn"), get("publisher"), url_set(get("url")), _rest(df, (*NAME_HEADERS, "issn", "eissn", "publisher", "url")))


def read_sheet_csv(spark: SparkSession, path: str) -> DataFrame:
    """A sheet export: the name from the first known header, else the first cell that looks like one (SRC-16)."""
    df = spark.read.option("header", True).csv(path)
    cells = F.array(*[F.trim(F.col(f"`{c}`").cast("string")) for c in df.columns])
    plausible = F.get(F.filter(cells, lambda c: (F.length(c) >= 3) & c.rlike(r"\p{L}{3}") & ~c.rlike(r"^(?i)https?://")), F.lit(0))
    return ingest_rows(df, F.coalesce(first_given(df, SHEET_HEADERS), plausible), first_given(df, ("issn",)), first_given(df, ("eissn",)), urls=url_set(first_given(df, ("url", "website", "link"))), least=3)


def read_acronyms_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Acronyms and their variants from an object with a list `acronyms`; blank ones are left out (SRC-28, SNK-10)."""
    schema = "acronyms array<struct<acronym string, entity_type string, canonical string, confidence_score double, issn array<string>, variants array<string>>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("acronyms")).where(F.trim("acronym") != "")
    return df.select("acronym", "entity_type", "canonical", "confidence_score"), df.select("acronym", "entity_type", F.explode("variants").alias("variant"))


def read_flat_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of `Key: value` lines between dashed lines, as maps; the last of equal keys wins (SRC-07)."""
    lines = spark.read.text(path, wholetext=True)
    records = lines.select(F.explode(F.split("value", r"(?m)^-{5,}\s*$")).alias("r"))
    pairs = F.transform(F.filter(F.split("r", r"\r?\n"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    d = records.select(pairs.alias("p")).where(F.size("p") > 0)
    kept = F.filter("p", lambda x, i: ~F.exists(F.slice("p", i + 2, F.size("p")), lambda y: y["k"] == x["k"]))
    return d.select(F.map_from_entries(kept).alias("record"))


def read_nlm(spark: SparkSession, path: str) -> DataFrame:
    """Title records of a library's flat file, on the contract, with the record's id (SRC-07)."""
    r = read_flat_records(spark, path).where(F.col("record")["JournalTitle"].isNotNull())
    meta = F.map_filter("record", lambda k, v: k.isin("NlmId", "MedAbbr", "IsoAbbr") & (v != ""))
    return ingest_rows(r, F.col("record")["JournalTitle"], F.col("record")["ISSN (Print)"], F.col("record")["ISSN (Online)"], metadata=meta)


def merge_catalogues(first: DataFrame, second: DataFrame, key: str = "NlmId") -> DataFrame:
    """The first catalogue and what only the second has; rows without an id stay (SRC-08, JN-06, SET-01)."""
    k = F.col("metadata")[key]
    known = first.select(k.alias("_known")).where("_known is not null").distinct()
    return first.withColumn("primary", F.lit(True)).unionByName(second.withColumn("primary", F.lit(False)).join(known, k == F.col("_known"), "left_anti"))


def read_bibliography_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Rows (key, year, venue, issn) of one tag of a bibliography dump, gzip included (SRC-05).

    A gzip file is one partition while it is read; callers that go on to wide
    operators repartition there.
    """
    schema = "_key string, year string, title string, booktitle string, journal string, issn string"
    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return df.select(F.col("_key").alias("key"), F.col("year").try_cast("int").alias("year"), squeeze(F.coalesce("booktitle", "journal", "title")).alias("venue"), F.col("issn"))


def sanitize_entities(c: Column) -> Column:
    """Named entities other than XML's own to blanks (SRC-06)."""
    return F.regexp_replace(c, r"&(?!(?:amp|lt|gt|apos|quot|#\d+|#x[0-9A-Fa-f]+);)[A-Za-z][A-Za-z0-9]*;", " ")


def html_table_rows(html: Column, row_class: str = "") -> Column:
    """Cells of every table row as text arrays, by the row's class if given (SRC-10, SRC-11, SRC-14)."""
    opening = rf'<tr[^>]*class="[^"]*(?:{row_class})[^"]*"[^>]*>' if row_class else r"<tr[^>]*>"
    rows = F.regexp_extract_all(html, F.lit(rf"(?is){opening}(.*?)</tr>"), 1)
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), strip_html))


def read_ranking_html(spark: SparkSession, path: str, ranks: Sequence[str], least_cells: int, title: int = 0, rank: int = 3) -> DataFrame:
    """Ranked rows of a listing: enough cells and a rank of the whitelist (SRC-10, SRC-11, FLT-07)."""
    d = spark.read.text(path, wholetext=True).select(F.explode(html_table_rows(F.col("value"), "evenrow|oddrow")).alias("c"))
    d = d.where((F.size("c") >= least_cells) & F.upper(F.trim(F.get("c", F.lit(rank)))).isin([r.upper() for r in ranks]))
    return ingest_rows(d, F.get("c", F.lit(title)), metadata=F.create_map(F.lit("rank"), F.trim(F.get("c", F.lit(rank)))))


# fixed values: items of site navigation
NAVIGATION = ("home", "about", "contact", "contacts", "blog", "login", "search", "menu", "news", "archive", "faq")


def read_list_html(spark: SparkSession, path: str) -> DataFrame:
    """Linked list items, the text in parentheses as publisher; navigation and odd lengths dropped (SRC-09, FLT-12, FS-36)."""
    html = spark.read.text(path, wholetext=True)
    items = html.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1)).alias("li"))
    d = items.select(
        F.regexp_replace(strip_html(F.regexp_extract("li", r"(?is)<a[^>]*>(.*?)</a>", 1)), r"[\u200b\u200c\u200d\ufeff“”\"]", "").alias("name"),
        F.regexp_extract("li", r'(?is)<a[^>]*href="([^"]*)"', 1).alias("url"),
        F.regexp_extract(strip_html(F.col("li")), r"\(([^()]*)\)\s*$", 1).alias("code"),
    )
    n = F.lower("name")
    d = d.where(F.length("name").between(3, 200) & ~n.isin(*NAVIGATION) & ~n.contains("hijacked") & ~n.startswith("how to"))
    return ingest_rows(d, F.col("name"), publisher=F.col("code"), urls=url_set(F.col("url")), least=3)


# fixed values: headings of a page's own furniture
PAGE_HEADINGS = ("visit website", "read more", "search", "categories", "recent posts", "archives", "tags", "follow us", "share this", "related posts")


def read_heading_pages(spark: SparkSession, path: str) -> DataFrame:
    """(name, url) of the headings of list pages, with the link that follows a heading before the next one (SRC-15).

    A heading without a link stays with a null address; headings of the page itself are no entries.
    """
    html = spark.read.text(path, wholetext=True)
    part = html.select(F.explode(F.slice(F.split("value", r"(?i)<h4[^>]*>"), 2, 1_000_000_000)).alias("p"))
    d = part.select(strip_html(F.regexp_extract("p", r"(?is)^(.*?)</h4>", 1)).alias("name"), F.regexp_extract("p", r'(?is)<a[^>]*href="([^"]*)"[^>]*>\s*visit website', 1).alias("url"))
    return d.where((F.length("name") >= 3) & ~F.lower("name").isin(*PAGE_HEADINGS)).select("name", F.when(F.col("url") != "", F.col("url")).alias("url"))


def read_paged(spark: SparkSession, folder: str, pages: int, total: int, per_page: int = 50, most: int = 200) -> DataFrame:
    """Lines of the pages 1, 2, ... of a listing that was fetched into a folder: as many as its total needs, never over `most` (SRC-12)."""
    wanted = [f"{folder}/page-{i}*" for i in range(1, min(pages, most, -(-total // per_page)) + 1)]
    return spark.read.text(wanted) if wanted else spark.createDataFrame([], "value string")


def read_clone_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(number, side, title, publisher, issn) of numbered `Title - ... Publisher ... ISSN ...` pairs (SRC-13)."""
    html = spark.read.text(path, wholetext=True)
    text = squeeze(unescape_basic(F.regexp_replace("value", r"<[^>]*>", " ")))
    pattern = r"(\d+)\s+Title\s*-\s*(.*?)\s+Publisher\s*-?\s*(.*?)\s+ISSN\s*-?\s*([\dXx-]*)"
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(rf"{pattern}(?=\s|$)"), i).alias(f"f{i}") for i in (1, 2, 3, 4)])
    d = html.select(F.posexplode(found).alias("pos", "f")).select("pos", F.col("f.f1").alias("number"), F.col("f.f2").alias("title"), F.col("f.f3").alias("publisher"), F.col("f.f4").alias("issn"))
    return d.withColumn("side", F.when(F.col("pos") % 2 == 0, "original").otherwise("cloned")).drop("pos")


def stitch_entries(lines: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, number, entry, urls) of numbered entries that run over lines (SRC-17)."""
    from periodiq.operators.keyed import record_segments

    d = record_segments(lines, group, order, F.col(text).rlike(r"^\d+\s+")).where("segment > 0")
    d = d.groupBy(group, "segment").agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("ls"))
    whole = squeeze(F.array_join(F.transform("ls", lambda x: x[text]), " "))
    d = d.select(group, whole.alias("w"))
    return d.select(group, F.regexp_extract("w", r"^(\d+)\s", 1).cast("int").alias("number"), squeeze(F.regexp_replace(F.regexp_replace("w", r"^\d+\s+", ""), r"https?://\S+", "")).alias("entry"), F.regexp_extract_all("w", F.lit(r"(https?://\S+)"), 1).alias("urls"))

"""Readers proven on whole tables: a table is written in the format, read back by the reader, and compared by SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodiq.session import shared_dir, table
from periodiq.sources import files
from periodiq.sources.bibtex import read_bibtex


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sources/{uuid.uuid4().hex}"


def source_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    d = table(spark, sf, "venue_acronym_variants").join(table(spark, sf, "venue_acronyms").select(F.col("id").alias("a"), "acronym"), F.col("venue_acronym_id") == F.col("a"))
    d.select(F.col("variant").alias("Title"), F.col("acronym").alias("Publisher"), F.col("id").cast("string").alias("ref")).write.option("header", True).option("escape", '"').csv(path)
    r = files.read_custom_csv(spark, path)
    return r.select(F.col("metadata")["ref"].cast("bigint").alias("id"), F.col("journal_name").alias("name"), "publisher")


def source_flat_records(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    d = table(spark, sf, "venue_acronyms")
    line = F.concat(F.lit("-" * 20 + "\nJrId: "), F.col("id"), F.lit("\nJournalTitle: "), F.col("canonical"), F.lit("\nMedAbbr: first\nMedAbbr: "), F.col("acronym"), F.lit("\nNlmId: "), F.col("id"))
    d.select(line).write.text(path)
    r = files.read_nlm(spark, path)
    return r.select(F.col("metadata")["NlmId"].cast("bigint").alias("id"), F.col("journal_name").alias("name"), F.col("metadata")["MedAbbr"].alias("abbreviation"))


def source_xml(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    d = table(spark, sf, "bibtex_entries")
    d.select(F.concat(F.lit("journals/e"), "entry_id").alias("_key"), F.col("pub_year").alias("year"), "title", "booktitle", F.col("journal_name").alias("journal"), "issn").write.format("xml").option("rootTag", "dblp").option("rowTag", "article").save(path)
    r = files.read_bibliography_xml(spark, path, "article").where(F.col("key").startswith("journals/"))
    return r.select(F.substring("key", 11, 20).cast("bigint").alias("entry_id"), "year", "venue")


def latex_escaped(c: Column) -> Column:
    """A text as a BibTeX value in braces whose every sign stands for itself."""
    c = F.regexp_replace(c, r"\\", "\u0001")
    c = F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")
    for sign, name in (("\u0001", "textbackslash"), ("~", "textasciitilde"), ("^", "textasciicircum")):
        c = F.replace(c, F.lit(sign), F.lit(f"\\{name}{{}}"))
    return F.concat(F.lit("{"), c, F.lit("}"))


_BIB = {"title": "title", "author": "authors", "journal": "journal_name", "booktitle": "booktitle", "year": "pub_year"}


def source_bibtex(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    d = table(spark, sf, "bibtex_entries")
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"  {k} = "), latex_escaped(F.col(c)))) for k, c in _BIB.items()]
    d.select(F.concat(F.lit("@"), F.coalesce("entry_type", F.lit("misc")), F.lit("{e"), "entry_id", F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}\n"))).write.text(path)
    r = read_bibtex(spark, path)
    return r.select(F.substring("entry_key", 2, 20).cast("bigint").alias("entry_id"), "entry_type", *[F.col("fields")[k].alias(c) for k, c in _BIB.items()])


def source_html(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    d = table(spark, sf, "venue_acronyms")
    title = F.col("canonical")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.replace(title, F.lit(sign), F.lit(entity))
    rank = F.when(F.col("confidence_score") >= 0.8, "A*").when(F.col("confidence_score") >= 0.6, "a").when(F.col("confidence_score") >= 0.4, "B").otherwise("c")
    row = F.concat(F.lit('<tr class="evenrow"><td><b>'), title, F.lit("</b></td><td>"), F.col("acronym"), F.lit("</td><td>x</td><td> "), rank, F.lit(" </td></tr>"))
    d.select(row).write.text(path)
    return files.read_ranking_html(spark, path, ("A*", "A", "B", "C"), 4).select(F.col("journal_name").alias("name"), F.upper(F.col("metadata")["rank"]).alias("rank"))


def source_pages(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    d = table(spark, sf, "venue_acronyms")
    head = F.concat(F.lit("<h4>"), F.replace("canonical", F.lit("&"), F.lit("&amp;")), F.lit("</h4>"))
    link = F.when(F.col("entity_type") == "journal", F.concat(F.lit('<p><a href="https://host.example/'), "id", F.lit('">Visit Website</a></p>'))).otherwise("<p>no link</p>")
    d.select(F.concat(head, link)).write.text(path)
    return files.read_heading_pages(spark, path).select("name", "url")


QUERIES = {f.__name__: f for f in (source_csv, source_flat_records, source_xml, source_bibtex, source_html, source_pages)}
ORACLE = {
    "source_csv": "SELECT v.id, trim(v.variant) AS name, a.acronym AS publisher FROM venue_acronym_variants v JOIN venue_acronyms a ON v.venue_acronym_id = a.id WHERE length(trim(v.variant)) >= 2",
    "source_flat_records": "SELECT id, trim(canonical) AS name, acronym AS abbreviation FROM venue_acronyms",
    "source_xml": """SELECT entry_id, TRY_CAST(CASE WHEN regexp_full_match(trim(pub_year), '[+-]?[0-9]+') THEN pub_year END AS INT) AS year,
  trim(regexp_replace(coalesce(booktitle, journal_name, title), '\\s+', ' ', 'g')) AS venue FROM bibtex_entries""",
    "source_bibtex": "SELECT entry_id, lower(coalesce(entry_type, 'misc')) AS entry_type, "
    + ", ".join(f"trim(regexp_replace(replace({c}, '--', '-'), '[\\s\\pZ]+', ' ', 'g')) AS {c}" for c in _BIB.values())
    + " FROM bibtex_entries",
    "source_html": "SELECT trim(regexp_replace(canonical, '\\s+', ' ', 'g')) AS name, CASE WHEN confidence_score >= 0.8 THEN 'A*' WHEN confidence_score >= 0.6 THEN 'A' WHEN confidence_score >= 0.4 THEN 'B' ELSE 'C' END AS rank FROM venue_acronyms",
    "source_pages": "SELECT trim(canonical) AS name, CASE WHEN entity_type = 'journal' THEN 'https://host.example/' || id END AS url FROM venue_acronyms",
}

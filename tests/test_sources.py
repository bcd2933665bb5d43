import gzip
import os
import time
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from periodiq.sources import files
from periodiq.sources.bibtex import BibtexSource, latex_text, parse_entries, venue_of
from periodiq.sources.contract import child_rows, unique_names
from periodiq.sources.xlsx import XlsxSource


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_directory_csv(spark, tmp_path):
    p = put(tmp_path, "d.csv", "﻿Journal title,Journal ISSN (print version),Journal EISSN (online version),Publisher,Journal URL\nAlpha,0317-8471,20493630,Pub,http://a.test\nB,1,,,\n\"Gamma, Letters\",12345678,,,\n")
    got = rows(files.read_directory_csv(spark, p).select("journal_name", "issn", "eissn", "publisher"))
    assert got == [("Alpha", "0317-8471", "2049-3630", "Pub"), ("Gamma, Letters", None, None, None)]


def test_custom_lists(spark, tmp_path):
    p = put(tmp_path, "c.csv", "Title,issn,note\nAlpha,0317-8471,odd\n,1,\n")
    r = files.read_custom_csv(spark, p).collect()
    assert [(x.journal_name, x.issn, x.metadata) for x in r] == [("Alpha", "0317-8471", {"note": "odd"})]
    p = put(tmp_path, "c.json", '[{"journal_name": "Beta", "eissn": "2049-3630", "n": 3}]')
    r = files.read_custom_json(spark, p).collect()
    assert [(x.journal_name, x.eissn, x.metadata) for x in r] == [("Beta", "2049-3630", {"n": "3"})]
    assert files.read_custom_json(spark, put(tmp_path, "bad.json", "[{")).count() == 0


def test_sheet_and_acronyms(spark, tmp_path):
    p = put(tmp_path, "s.csv", "No,Journal Name,Website\n1,Alpha Review,http://a.test\n2,,\n")
    assert rows(files.read_sheet_csv(spark, p).select("journal_name")) == [("Alpha Review",)]
    p = put(tmp_path, "t.csv", "a,b\n12,Found Name\n")
    assert rows(files.read_sheet_csv(spark, p).select("journal_name")) == [("Found Name",)]
    p = put(tmp_path, "a.json", '{"acronyms": [{"acronym": "ABC", "entity_type": "journal", "canonical": "A B C", "confidence_score": 0.9, "variants": ["abc", "a.b.c."]}, {"acronym": " "}]}')
    a, v = files.read_acronyms_json(spark, p)
    assert rows(a.select("acronym", "canonical")) == [("ABC", "A B C")]
    assert rows(v.select("variant")) == [("a.b.c.",), ("abc",)]


NLM = "-" * 20 + "\nJrId: 1\nJournalTitle: Alpha: one\nISSN (Print): 0317-8471\nISSN (Online): \nNlmId: 11\nNlmId: 12\n" + "-" * 20 + "\nJrId: 2\nJournalTitle: Beta\nISSN (Print): 0317-8470\nNlmId: \n" + "-" * 20 + "\n"


def test_flat_records(spark, tmp_path):
    first = files.read_nlm(spark, put(tmp_path, "n.txt", NLM))
    assert rows(first.select("journal_name", "issn", F.col("metadata")["NlmId"])) == [("Alpha: one", "0317-8471", "12"), ("Beta", None, None)]
    second = files.read_nlm(spark, put(tmp_path, "m.txt", NLM.replace("Alpha: one", "Same id").replace("Beta", "Gamma")))
    got = files.merge_catalogues(first, second)
    assert rows(got.select("journal_name", "primary")) == [("Alpha: one", True), ("Beta", True), ("Gamma", False)]


def test_bibliography_xml(spark, tmp_path):
    p = tmp_path / "d.xml.gz"
    with gzip.open(p, "wt") as f:
        f.write('<?xml version="1.0"?><dblp><article key="journals/abc/1"><title>T</title><journal>A  B</journal><year>2001</year></article><article key="x/1"><journal>N</journal><year>z</year></article></dblp>')
    got = rows(files.read_bibliography_xml(spark, str(p), "article").where(F.col("key").startswith("journals/")))
    assert got == [("journals/abc/1", 2001, "A B", None)]
    d = spark.createDataFrame([("a &uuml; &amp; &#252;",)], "t string")
    assert d.select(files.sanitize_entities(F.col("t"))).first()[0] == "a   &amp; &#252;"


def test_html(spark, tmp_path):
    p = put(tmp_path, "r.html", '<table><tr class="evenrow"><td>Alpha &amp; Co</td><td>AC</td><td>x</td><td>A*</td></tr><tr class="oddrow"><td>Unranked One</td><td>U</td><td>x</td><td>none</td></tr><tr><td>head</td></tr></table>')
    assert rows(files.read_ranking_html(spark, p, ("A*", "A", "B", "C"), 4).select("journal_name", F.col("metadata")["rank"])) == [("Alpha & Co", "A*")]
    p = put(tmp_path, "l.html", '<ul><li><a href="/">Home</a></li><li><a href="http://b.test">Beta Press</a> (BP)</li><li><a href="x">How to check</a></li></ul>')
    assert rows(files.read_list_html(spark, p).select("journal_name", "publisher", F.col("urls")[0])) == [("Beta Press", "BP", "http://b.test")]
    p = put(tmp_path, "c.html", "<p>1 Title - Real One<br>Publisher - P1 ISSN - 0317-8471</p><p>1 Title - Real One Publisher - Fake ISSN - 0317-8471</p>")
    assert rows(files.read_clone_pairs(spark, p).select("side", "title", "publisher", "issn")) == [("cloned", "Real One", "Fake", "0317-8471"), ("original", "Real One", "P1", "0317-8471")]


def test_stitched_lines(spark):
    d = spark.createDataFrame([("f", 1, "heading"), ("f", 2, "1 Alpha"), ("f", 3, "Journal http://a.test"), ("f", 4, "2 Beta")], "file string, n int, t string")
    got = rows(files.stitch_entries(d, "file", "n", "t"))
    assert [(g[1], g[2], list(g[3])) for g in got] == [(1, "Alpha Journal", ["http://a.test"]), (2, "Beta", [])]


def test_files(tmp_path):
    (tmp_path / "sub").mkdir()
    a, b = tmp_path / "sub" / "a.bib", tmp_path / "b.bib"
    for p in (a, b):
        p.write_text("x")
    os.utime(b, (time.time() - 100, time.time() - 100))
    assert files.discover(str(tmp_path)) == sorted([str(b), str(a)])
    assert files.newest_file(str(tmp_path), "**/*.bib") == str(a)
    bad = tmp_path / "z.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(ValueError, match="unsafe"):
        files.extract_zip(str(bad), str(tmp_path / "t"))
    assert files.header_columns(["Source Title", "Print ISSN", "E-ISSN"], {"title": [("title",)], "eissn": [("e-issn",)]}) == {"title": "Source Title", "eissn": "E-ISSN"}


BIB = """@comment{x}
@string{abc = "A Big Conf"}
@article{k1, title = {On {\\"U}ber \\& $x^2$}, journal = "J. of {X}", year = 2001}
@inproceedings(k2, booktitle = abc # " 2", title={T})
@article{broken, title = {never closed
@article{k3, journal = {Z{\\'e}ro}}
"""


def test_bibtex(spark, tmp_path):
    spark.dataSource.register(BibtexSource)
    put(tmp_path, "a.bib", BIB.replace("@article{broken, title = {never closed\n", ""))
    (tmp_path / "b.bib").write_bytes("@article{l1, journal = {Caf\xe9}}".encode("latin-1"))
    d = spark.read.format("bibtex").load(str(tmp_path))
    got = rows(d.select("entry_key", venue_of(F.col("fields"))))
    assert got == [("k1", "J. of X"), ("k2", "A Big Conf 2"), ("k3", "Zéro"), ("l1", "Café")]
    assert latex_text('On {\\"U}ber \\& $x^2$ \\emph{a {b}}') == "On Über & a b"
    assert [e[3] is None for e in parse_entries(BIB)].count(False) == 1
    put(tmp_path, "c.bib", "@article{x, title = {open")
    with pytest.raises(Exception, match="brace"):
        spark.read.format("bibtex").option("mode", "strict").load(str(tmp_path)).count()


def test_xlsx(spark, tmp_path):
    spark.dataSource.register(XlsxSource)
    p = tmp_path / "x.xlsx"
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Notes" sheetId="1" r:id="r1"/><sheet name="Sources 1" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>Title</t></si><si><r><t>Al</t></r><r><t>pha</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {m}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Active</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    got = [(r.row_no, r.cells) for r in spark.read.format("xlsx").option("sheet", "source").load(str(p)).collect()]
    assert got == [(0, ["Title", None, "Active"]), (1, ["Alpha", "7"])]


def test_contract_helpers(spark, tmp_path):
    p = put(tmp_path, "c.csv", "name,url\nAlpha,http://a.test\nalpha ,http://b.test\n")
    d = files.read_custom_csv(spark, p)
    assert unique_names(d.withColumn("n", F.monotonically_increasing_id()), F.col("n")).count() == 1
    names, listings, urls = child_rows(d, "journal_name", "mine", "predatory")
    assert (names.count(), listings.count(), urls.count()) == (2, 2, 2)

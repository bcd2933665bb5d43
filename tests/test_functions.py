from datetime import datetime

import pytest
from pyspark.sql import functions as F

from periodiq.functions import abbreviations as ab
from periodiq.functions import dates, identifiers, nested, numbers, text


def one(spark, column, **values):
    d = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return d.select(column).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Journal of Science (ISSN: 1234-5679)", "Journal of Science"),
        ("{{IEEE}} Conference on {{Cloud Computing}} ({{CLOUD}})", "IEEE Conference on Cloud Computing"),
        ("Acta: Optics &amp; Light [Online]", "Acta: Optics & Light"),
        ("Zeitschrift für Physik*", "Zeitschrift für Physik"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_name(spark, given, want):
    assert one(spark, text.clean_name(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("2018 IEEE 11th International Conference on Cloud Computing (CLOUD)", "IEEE International Conference on Cloud Computing"),
        ("Proceedings of the Twenty-First Symposium on Optics", "Symposium on Optics"),
        ("28e Journées", "Journées"),
        ("Acta Optica", None),
    ],
)
def test_series(spark, given, want):
    assert one(spark, text.conference_series(F.lit(given))) == want


def test_case_and_comparison(spark):
    assert one(spark, text.normal_case(F.lit("the IEEE journal OF mcgill ai"))) == "The IEEE Journal of Mcgill AI"
    assert one(spark, text.comparison_form(F.lit("The Journal of Bio-Optics, and &amp; Light"))) == "bio optics light"
    assert one(spark, text.name_aliases(F.lit("Journal of Optics"))) == ["Optics", "Jrnl of Optics"]


def test_acronyms(spark):
    c = F.lit("Neural Systems Conference (NeurIPS) (Online) (ISSN 1) (x)")
    assert one(spark, text.parenthesised_acronyms(c)) == ["NeurIPS"]
    assert one(spark, text.acronym_meaning(c)) == "Neural Systems Conference"
    assert one(spark, text.is_standalone_acronym(F.lit("AT&T"))) and not one(spark, text.is_standalone_acronym(F.lit("Nature")))


def test_similarity_kinds(spark):
    assert one(spark, text.jaccard(F.lit("a b c"), F.lit("b c d"))) == 0.5
    assert one(spark, text.jaccard(F.lit(""), F.lit("b"))) == 0.0
    assert one(spark, text.token_overlap(F.lit("A-b x"), F.lit("b"))) == 1.0
    assert one(spark, text.venue_kind(F.lit("inproceedings"), F.lit("Workshop at the Symposium"))) == "symposium"
    assert one(spark, text.venue_kind(F.lit("misc"), F.lit(None).cast("string"))) == "unknown"
    assert one(spark, text.is_preprint(F.lit("arXiv:2101.00001"))) and not one(spark, text.is_preprint(F.lit("Nature")))
    for nature, want in (("", True), ("Retraction", True), ("Correction", False), ("Expression of concern", False), ("Withdrawal", False), ("withdrawn", True), (None, True)):
        got = one(spark, text.is_retraction(F.lit(nature).cast("string")))
        assert got is (want or nature == "Withdrawal")


def test_identifiers(spark):
    assert one(spark, identifiers.normal_issn(F.lit("issn 1234567x"))) is None
    assert one(spark, identifiers.normal_issn(F.lit("1234 567x"))) == "1234-567X"
    for n, ok in (("0317-8471", True), ("0317-8470", False), ("2434-561X", True), ("0317847", False), ("", False)):
        assert one(spark, identifiers.issn_checks(F.lit(n))) is ok
    assert one(spark, identifiers.first_issn(F.lit("see 03178471 and 2434-561X"))) == "0317-8471"
    assert one(spark, identifiers.is_doi(F.lit("10.1234/ab"))) and not one(spark, identifiers.is_doi(F.lit("10.12/ab")))
    assert one(spark, identifiers.url_host(F.lit(" HTTPS://A.Test:8/x"))) == "a.test"
    assert one(spark, identifiers.is_email(F.lit("a@b.org"))) and not one(spark, identifiers.is_email(F.lit("a@b")))
    assert one(spark, identifiers.series_slug(F.lit("conf/abc/X1"), "conf/")) == "abc"
    assert one(spark, identifiers.query_key(F.lit("a"), F.lit(None).cast("string"))) == one(spark, F.md5(F.lit("a|")))


def test_dates(spark):
    now = F.lit(datetime(2025, 1, 1))
    assert one(spark, dates.notice_time(F.lit("1/2/2020 3:04"))) == datetime(2020, 1, 2, 3, 4)
    assert one(spark, dates.notice_time(F.lit("2/30/2020 3:04"))) is None
    assert one(spark, dates.recent_by_year(F.lit(datetime(2023, 1, 1)), now, 2))
    assert one(spark, dates.expiry(now, 720)) == datetime(2025, 1, 31)
    assert one(spark, dates.is_stale(F.lit(datetime(2024, 12, 1)), now, 30)) and one(spark, dates.is_stale(F.lit(None).cast("timestamp"), now, 30))
    assert one(spark, dates.plausible_year(F.lit(" 1999 "))) == 1999 and one(spark, dates.plausible_year(F.lit("99x"))) is None
    assert one(spark, dates.date_parts_iso(F.array(F.lit(2020), F.lit(1), F.lit(2)))) == "2020-01-02"
    assert one(spark, dates.years_active(F.lit(2001), F.lit(2000))) == 1


def test_numbers(spark):
    assert one(spark, numbers.clamp(F.lit(0.4), -0.25, 0.25)) == 0.25
    assert one(spark, numbers.guarded_ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, numbers.percentage(F.lit(1), F.lit(0))) is None
    assert one(spark, numbers.symmetric_ratio(F.lit(2), F.lit(4))) == 0.5
    assert one(spark, numbers.by_label(F.lit("b"), {"a": 1.0, "b": 0.5}, 0.0)) == 0.5
    assert one(spark, numbers.four_decimals(F.lit(0.12345))) in ("0.1235", "0.1234")
    assert one(spark, numbers.lenient_int(F.lit(" 7 "))) == 7 and one(spark, numbers.lenient_int(F.lit("7x"))) is None
    steps = [(3.0, "critical"), (1.5, "high")]
    assert [one(spark, numbers.ladder(F.lit(v).cast("double"), steps, "none")) for v in (3.0, 1.5, 1.49, None)] == ["critical", "high", "none", "none"]
    assert one(spark, numbers.flags((F.lit(True), "a"), (F.lit(False), "b"), (F.lit(None).cast("boolean"), "c"))) == ["a"]


def test_nested(spark):
    assert one(spark, nested.int_keys(F.lit('{"2001": 3, "x": 1}'))) == {2001: 3}
    assert one(spark, nested.polymorphic_count(F.lit('[{"count": "7"}]'))) == 7
    assert one(spark, nested.polymorphic_count(F.lit('{"citation_count": 8}'))) == 8
    assert one(spark, nested.encode(F.array().cast("array<string>"))) is None
    pairs = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)), F.array(F.lit(1), F.lit(5)))
    assert one(spark, nested.pairs_to_map(pairs)) == {1: 5}
    assert one(spark, nested.tagged(F.array(F.lit("x")), "A")) == ["A: x"]
    assert one(spark, nested.first_identifiers(F.lit("a"), F.array(F.lit("b"), F.lit("a"), F.lit("c")))) == ["a", "b"]
    assert one(spark, nested.joined_reasons(F.array(F.lit("x")), F.lit(None).cast("array<string>"))) == ["x"]
    assert one(spark, nested.decode(F.lit("{bad"), "k int")).k is None


def test_abbreviations(spark):
    assert ab.valid_abbreviation("inter.", "international") and ab.valid_abbreviation("ai", "artificial intelligence")
    assert ab.valid_abbreviation("colour", "color") and not ab.valid_abbreviation("system", "systems")
    assert ab.learned("int. conf. on optics", "international conference on optics") == [("int.", "international", 0.5), ("conf.", "conference", 0.7)]
    d = spark.createDataFrame([("int. optics", "international optics"), (None, "x")], "s string, l string")
    assert [tuple(r)[:2] for r in ab.learn_abbreviations(d, "s", "l").collect()] == [("int.", "international")]
    assert one(spark, ab.unescape_html(F.lit("a &eacute; b"))) == "a é b"

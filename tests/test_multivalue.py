import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from periodiq.operators.multivalue import parse_issns, parse_persons, split_values

PERSONS = [
    ("A. Bo AND C. Do", ["A. Bo", "C. Do"]),
    ("Bo, Ann and Do, Cy", ["Bo, Ann", "Do, Cy"]),
    ("Bo, A.; Do, C.;", ["Bo, A.", "Do, C."]),
    ("Ann Bo, Cy Do, & Eva Fo", ["Ann Bo", "Cy Do", "Eva Fo"]),
    ("A. Bo, C. Do and E. Fo", ["A. Bo", "C. Do", "E. Fo"]),
    ("A. Bo, C. Do, et al.", ["A. Bo", "C. Do"]),
    ("Bo, Ann and others", ["Bo, Ann"]),
    ("{Group on A, B and C} and Cy Do", ["Group on A, B and C", "Cy Do"]),
    ('"Inst. of A and B";C. Do', ["Inst. of A and B", "C. Do"]),
    ('A. Bo, "Inst. of A and B", C. Do, and E. Fo', ["A. Bo", "Inst. of A and B", "C. Do", "E. Fo"]),
    ("A. Bo; C. Do and E. Fo", ["A. Bo", "C. Do", "E. Fo"]),
    ("Bo, Ann\nand Do, Cy", ["Bo, Ann", "Do, Cy"]),
    ("Bo, Ann \\& Do, Cy", ["Bo, Ann", "Do, Cy"]),
    ("Ann Bo | Cy Do", ["Ann Bo", "Cy Do"]),
    ("Bo, Ann / Do, Cy", ["Bo, Ann", "Do, Cy"]),
    ("van Bo, Ann", ["van Bo, Ann"]),
    ("de la Bo, A. B.", ["de la Bo, A. B."]),
    ("Bo, A., Do, C.", ["Bo, A.", "Do, C."]),
    ("Ann Bo", ["Ann Bo"]),
    ("Alexander Anderson and Andy Sand", ["Alexander Anderson", "Andy Sand"]),
]


@pytest.mark.parametrize(("typed", "want"), PERSONS)
def test_persons(typed, want):
    assert parse_persons(typed) == (want, False)


def test_malformed_quotes_are_flagged():
    assert parse_persons('"Ann Bo and Cy Do') == (['"Ann Bo', "Cy Do"], True)
    items, error = parse_persons("{Ann Bo; Cy Do")
    assert error and items == ["{Ann Bo", "Cy Do"]


@pytest.mark.parametrize(
    ("typed", "want"),
    [
        ("ISSN 1234-5679 | e-ISSN 2049-363x", ["1234-5679", "2049-363X"]),
        ("12345679 and 2049363X, 1234-5679", ["1234-5679", "2049-363X", "1234-5679"]),
        ("p1234-5679;e2049-3630", ["1234-5679", "2049-3630"]),
        ('"12345679","2049-3630"', ["1234-5679", "2049-3630"]),
        ("1234-5679 2049-3630", ["1234-5679", "2049-3630"]),
        ("1234-5679 (print), 2049-3630 (online)", ["1234-5679", "2049-3630"]),
    ],
)
def test_issns(typed, want):
    assert parse_issns(typed) == (want, False)


name = st.builds(lambda a, b: f"{a.upper()}. {b.capitalize()}", st.sampled_from("abcdefgh"), st.text("bcdfgklmnop", min_size=3, max_size=8))


@settings(max_examples=150, deadline=None)
@given(st.lists(name, min_size=2, max_size=7), st.sampled_from([" and ", "; ", ", ", " | ", " & ", " / ", "\nand "]))
def test_round_trip(names, delimiter):
    assert parse_persons(delimiter.join(names)) == (names, False)


@settings(max_examples=300, deadline=None)
@given(st.text('ab"{},;| &\n', max_size=40))
def test_never_fails_and_keeps_no_blanks(s):
    items, _ = parse_persons(s)
    assert all(x == x.strip() and x for x in items)


def test_rows(spark):
    d = spark.createDataFrame(
        [(1, "A. Bo; C. Do", "1234-5679, 2049-3630", "p"), (2, None, None, "q"), (3, "", "", "r"), (4, "Bo, Ann", "1234-5679", "s"), (1, "A. Bo; C. Do", None, "t"), (5, "; ".join(["A. Bo"] * 5000), None, "u")],
        "entry_id bigint, authors string, issn string, pos string",
    )
    got = sorted((r.entry_id, r.field_name, r.pos, r.item) for r in split_values(d).collect())
    assert got[:6] == [(1, "authors", 1, "A. Bo"), (1, "authors", 1, "A. Bo"), (1, "authors", 2, "C. Do"), (1, "authors", 2, "C. Do"), (1, "issn", 1, "1234-5679"), (1, "issn", 2, "2049-3630")]
    assert [g[2] for g in got[6:]] == list(range(1, 5001))
    assert split_values(d.limit(0)).count() == 0


def test_labelled_numbers_without_delimiter_and_very_malformed_braces(spark):
    d = spark.createDataFrame([(1, None, "12345678 (print) 87654321 (online)"), (2, "{" * 40_000 + "A and B", None)], "entry_id bigint, authors string, issn string")
    got = [(r.entry_id, r.pos, r.item) for r in split_values(d).orderBy("entry_id", "pos").collect()]
    assert got[:2] == [(1, 1, "1234-5678"), (1, 2, "8765-4321")]
